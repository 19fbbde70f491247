"""Reviewed lists as tables: what is wrong with each entry, and what no record answers to.

Each check returns (id, errors) of the faulty entries, all errors joined by '; '.
A job that must not run on a faulty list raises where this is not empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rules import ACCESS_RANK

#: Kinds of import rules; what an official count compares with.
RULES = ("attribute-free", "name-pattern", "listed")
COMPARABLE = ("features", "sites")


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))


def _faults(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    twice = (F.count("*").over(W.partitionBy("id")) > 1) & ~_blank("id")
    every = [(_blank("id"), "no id"), (twice, "duplicate id"), *checks]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(message)) for c, message in every]))
    return rows.select("id", F.array_join(found, "; ").alias("errors")).where("errors <> ''")


def manager_faults(managers: DataFrame) -> DataFrame:
    """``managers``: id, name, manager, warning, source, retrieved, west, south, east, north, status."""
    sides = [F.col(c) for c in ("west", "south", "east", "north")]
    west, south, east, north = sides
    broken = F.exists(F.array(*sides), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return _faults(
        managers,
        [(_blank(c), f"no {c}") for c in ("name", "manager", "warning", "source", "retrieved")]
        + [
            (broken, "box is not four numbers"), ((F.abs(south) > 90) | (F.abs(north) > 90), "latitude outside 90, transposed?"),
            ((F.abs(west) > 180) | (F.abs(east) > 180), "longitude outside 180"), ((west >= east) | (south >= north), "inverted or empty box"),
            (~F.coalesce(F.col("status").isin(*ACCESS_RANK), F.lit(False)), "unknown status"),
        ],
    )


def rule_faults(rules: DataFrame) -> DataFrame:
    """``rules``: id, rule, countries, reason, west, south, east, north, pattern, ids, except (arrays may be null)."""
    west, south, east, north = (F.col(c) for c in ("west", "south", "east", "north"))
    some = F.coalesce(west, south, east, north).isNotNull()
    kind = F.col("rule")
    listed = lambda c: F.coalesce((F.size(c) == 0) | F.exists(c, lambda x: F.coalesce(x == "", F.lit(True))), F.lit(False))
    repeats = lambda c: F.size(F.array_distinct(c)) != F.size(c)
    return _faults(
        rules,
        [
            (~F.coalesce(kind.isin(*RULES), F.lit(False)), "unknown rule"), (F.coalesce(F.size("countries"), F.lit(0)) <= 0, "no countries"), (_blank("reason"), "no reason"),
            (some & (west.isNull() | south.isNull() | east.isNull() | north.isNull()), "box is not four numbers"), ((west >= east) | (south >= north), "box has its minimum above its maximum"),
            ((kind == "name-pattern") & _blank("pattern"), "needs a pattern"), ((kind != "name-pattern") & F.col("pattern").isNotNull(), "has a pattern its rule ignores"),
            ((kind == "listed") & (F.col("ids").isNull() | listed("ids")), "needs ids"), ((kind != "listed") & F.col("ids").isNotNull(), "has ids its rule ignores"),
            (listed("except"), "empty exceptions"), (repeats("ids") | repeats("except"), "repeats an id"),
        ],
    )


def inventory_faults(counts: DataFrame) -> DataFrame:
    """``counts``, one row an official count: id (of the count), country, publisher, title, url, as_of, reviewed, count, unit, compares, caveat, ours."""
    whole = F.coalesce((F.col("count") > 0) & (F.col("count") == F.floor("count")), F.lit(False))
    return _faults(
        counts,
        [(_blank(c), f"no {c}") for c in ("publisher", "title", "as_of", "reviewed", "unit", "caveat")]
        + [
            (~F.coalesce(F.col("country").rlike("^[A-Z]{2}$"), F.lit(False)), "country is no two-letter code"), (~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "url is no https link"),
            (~whole, "count is no positive whole number"), (~F.coalesce(F.col("compares").isin(*COMPARABLE), F.lit(False)), "compares with neither features nor sites"),
            (F.col("ours") & ~F.lower("caveat").contains("count"), "counts itself without saying so"),
        ],
    )


def unmatched_ids(rules: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, id): ids that rules (id, ids, except) list or except and no record has."""
    none = F.array().cast("array<string>")
    named = rules.select(F.col("id").alias("rule"), F.explode(F.concat(F.coalesce("ids", none), F.coalesce("except", none))).alias("id"))
    return named.join(records.select("id"), "id", "left_anti").select("rule", "id")


def suppressed(overlays: DataFrame, survivors: DataFrame) -> DataFrame:
    """The ids of overlays whose record did not survive, and nothing else of them."""
    return overlays.select("id").distinct().join(survivors.select("id"), "id", "left_anti")
