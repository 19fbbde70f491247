"""Fills from measurement mirrors: what a group of wells agrees on goes to empty fields.

A value is never averaged, an existing value never replaced, a claimed field
never touched.  What is not written for lack of agreement is returned with its
reason.  Wells and records each shuffle once, by their id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.minerals import classification_outcome
from ..functions.parse import fahrenheit

#: Why a field is withheld.
DISAGREE = "wells disagree or none stated"
NO_UNIT = "no agreed unit for the panel"
#: Fields that say something without the panel's unit.
UNITLESS = ("celsius", "ph")

#: Claim states that still hold a field.
_HELD = "state is null or state <> 'retracted'"


def _single(column: str) -> Column:
    """The one distinct value of a group, or null; no list of values is kept."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def agreed_panel(wells: DataFrame, order: Column, tolerances: Mapping[str, float]) -> DataFrame:
    """One row per id: each field's first value where all lie within its tolerance, else null.

    Empty texts say nothing, like nulls.

    ``wells``: id, unit, year, class and the fields.  ``p_unit`` needs exactly
    one distinct unit; ``p_year`` is the latest; ``p_classes`` holds the one
    distinct class, or two of them where wells differ.
    """
    wells = wells.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("unit", "year", "class")})
    first = lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), order))
    values = [F.when(F.max(f) - F.min(f) <= t, first(f)).alias(f"p_{f}") for f, t in tolerances.items()]
    some = F.when(F.min("class") == F.max("class"), F.array(F.min("class"))).when(F.min("class").isNotNull(), F.array(F.min("class"), F.max("class")))
    return wells.groupBy("id").agg(
        *values, _single("unit").alias("p_unit"), F.max("year").alias("p_year"), F.coalesce(some, F.array().cast("array<string>")).alias("p_classes")
    )


def held_fields(claims: DataFrame) -> DataFrame:
    """(id, held, held_types) from claims (id, field, value, state).

    ``held`` has the distinct fields that claims hold, as many as there are
    fields at most; ``held_types`` the claimed types, which '|' separates.
    """
    types = F.split(F.max(F.when(F.col("field") == "types", F.col("value"))), r"\|")
    return claims.where(_HELD).groupBy("id").agg(F.collect_set("field").alias("held"), types.alias("held_types"))


def fill_panel(records: DataFrame, panel: DataFrame, held: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``records`` with empty fields filled from the panel, ``written``, ``withheld`` and ``contest``.

    ``records``: id, the fields, types, unit, measured_at.  Records without a
    panel stay as they are, with both lists empty.  The panel's unit replaces
    the record's where a figure that needs one, or a type, was written; its
    year fills an empty ``measured_at`` where anything but the temperature was.
    ``contest`` has the types that claimed ones contradict, else null.
    """
    rows = records.join(panel, "id", "left").join(held, "id", "left")
    matched = F.col("p_classes").isNotNull()
    # a column of its own: several below are made of it, and each would read the classes again
    rows = rows.withColumn("_outcome", F.when(matched, classification_outcome(F.col("p_classes"), F.col("types"), F.col("held_types"))))
    claimed = lambda f: F.coalesce(F.array_contains("held", f), F.lit(False))
    reason, write = {}, {}
    for f in fields:
        lacks_unit = F.lit(False) if f in UNITLESS else F.col("p_unit").isNull()
        reason[f] = F.when(matched & lacks_unit, NO_UNIT).when(matched & F.col(f"p_{f}").isNull(), DISAGREE)
        write[f] = matched & reason[f].isNull() & F.col(f).isNull() & ~claimed(f)
    outcome = F.col("_outcome")
    write["types"] = outcome["write"].isNotNull() & ~claimed("types")
    # the verdicts come from the columns as they were, so they are settled first
    said = F.array_compact(F.array(*[F.when(reason[f].isNotNull(), F.struct(F.lit(f).alias("field"), reason[f].alias("reason"))) for f in fields],
                                   F.when(outcome["withheld"].isNotNull(), F.struct(F.lit("types").alias("field"), outcome["withheld"].alias("reason")))))
    done = F.array_compact(F.array(*[F.when(w, F.lit(f)) for f, w in write.items()]))
    united = F.size(F.array_except(done, F.array(*map(F.lit, UNITLESS)))) > 0
    chemical = F.size(F.array_except(done, F.array(F.lit("celsius")))) > 0
    unit = F.when(united & F.col("p_unit").isNotNull() & ~claimed("unit"), F.col("p_unit")).otherwise(F.col("unit"))
    dated = F.when(chemical & ~claimed("measured_at"), F.coalesce("measured_at", "p_year")).otherwise(F.col("measured_at"))
    return rows.select(
        "id", *[F.when(write[f], F.col(f"p_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(write["types"], outcome["write"]).otherwise(F.col("types")).alias("types"),
        unit.alias("unit"), dated.alias("measured_at"), done.alias("written"), said.alias("withheld"), outcome["contest"].alias("contest"),
    )


def withheld_rows(filled: DataFrame) -> DataFrame:
    """(id, field, reason) of what was withheld."""
    return filled.select("id", F.inline("withheld"))


def fill_temperature(records: DataFrame, readings: DataFrame, held: DataFrame) -> DataFrame:
    """``records`` (id, celsius, measured_at) with matched readings (id, reading, read_at) and an ``outcome``.

    ``filled``; ``deferred`` to a claim of the Celsius value; ``conflict`` where
    a known value differs; ``same``; null without a reading.  Readings with
    ``words`` for a temperature nobody measured give records a ``qualitative`` one
    where they have none: ``described``.
    """
    if "words" in readings.columns:
        return _with_words(records, readings, held)
    rows = records.join(readings, "id", "left").join(held, "id", "left")
    claimed = F.coalesce(F.array_contains("held", "celsius"), F.lit(False))
    outcome = F.when(F.col("reading").isNull(), None).when(claimed, "deferred").when(F.col("celsius").isNull(), "filled").when(F.col("celsius") != F.col("reading"), "conflict").otherwise("same")
    filled = outcome == "filled"
    celsius = F.when(filled, F.col("reading")).otherwise(F.col("celsius"))
    return rows.select(
        "id", celsius.alias("celsius"), fahrenheit(celsius).alias("fahrenheit"), F.when(filled, F.col("read_at")).otherwise(F.col("measured_at")).alias("measured_at"), outcome.alias("outcome")
    )


def _with_words(records: DataFrame, readings: DataFrame, held: DataFrame) -> DataFrame:
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    filled = fill_temperature(records.drop("qualitative"), readings.drop("words"), held)
    own = records.select("id", "qualitative").join(readings.select("id", "words", F.col("read_at").alias("_at")), "id", "left").join(held, "id", "left")
    own = own.withColumn("_claimed", F.coalesce(F.array_contains("held", "celsius"), F.lit(False))).drop("held")
    rows = filled.join(own, "id")
    worded = F.col("outcome").isNull() & said("words").isNotNull()
    described = worded & said("qualitative").isNull() & ~F.col("_claimed")
    return rows.select(
        "id", "celsius", "fahrenheit", F.when(described, F.col("words")).otherwise(said("qualitative")).alias("qualitative"),
        F.when(described, F.col("_at")).otherwise(F.col("measured_at")).alias("measured_at"),
        F.when(described, "described").when(worded & F.col("_claimed"), "deferred").otherwise(F.col("outcome")).alias("outcome"),
    )
