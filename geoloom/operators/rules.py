"""Priority rules, restrictions and privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_box
from .spatial import box_join, radius_join

#: Access statuses, least restrictive first.
ACCESS_RANK = ("unknown", "public", "permit", "view-only", "closed")


def first_rule(records: DataFrame, rules: DataFrame) -> DataFrame:
    """``records`` with ``rule``: the first in ``ord`` whose country, box, name pattern and exceptions fit.

    ``rules``: rule, ord, country, west, south, east, north (null: everywhere),
    pattern (null: any name), except (array of ids, may be null), and maybe kind:
    ``attribute-free`` takes records whose ``attribute_free`` is true, ``listed``
    those in ``ids``, ``name-pattern`` (and rules without a kind) goes by the
    pattern.  Rules are a reviewed list, joined on the country.
    """
    box = F.col("west").isNull() | in_box(F.col("lat"), F.col("lng"), F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    name = F.col("pattern").isNull() | F.rlike(F.coalesce("name", F.lit("")), F.col("pattern"))
    free = ~F.coalesce(F.array_contains("except", F.col("id")), F.lit(False))
    hits = records.join(rules.withColumnRenamed("country", "_country"), F.col("country") == F.col("_country")).where(box & _fits(records, rules, name) & free)
    first = hits.groupBy("id").agg(F.min_by("rule", "ord").alias("rule"))
    return records.join(first, "id", "left")


def _fits(records: DataFrame, rules: DataFrame, name: Column) -> Column:
    if "kind" not in rules.columns:
        return name
    bare = F.coalesce("attribute_free", F.lit(False)) if "attribute_free" in records.columns else F.lit(False)
    listed = F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)) if "ids" in rules.columns else F.lit(False)
    return F.when(F.col("kind") == "attribute-free", bare).when(F.col("kind") == "listed", listed).otherwise(name)


def restrict(records: DataFrame, boxes: DataFrame) -> DataFrame:
    """id, status, bathing, warnings of the records that boxes hold.

    The most restrictive status of the boxes and of the record's own; any
    refusal of bathing holds, else the record's own word, else the first box's
    that has one.  ``boxes``: manager, ord, status, bathing, warning, west, south,
    east, north; ``records``: id, lat, lng, and maybe status and bathing.
    """
    own = {c: F.col(c) if c in records.columns else F.lit(None) for c in ("status", "bathing")}
    mine = records.select("id", "lat", "lng", own["status"].cast("string").alias("own_status"), own["bathing"].cast("boolean").alias("own_bathing"))
    ranks = F.array(*[F.lit(s) for s in ACCESS_RANK])
    rank = F.greatest(F.max(F.array_position(ranks, F.col("status"))), F.coalesce(F.array_position(ranks, F.first("own_status")), F.lit(1)))
    refused = F.bool_or(~F.col("bathing")) | ~F.first("own_bathing")
    said = F.min_by("bathing", F.when(F.col("bathing").isNotNull(), F.col("ord")))
    return box_join(mine, boxes).groupBy("id").agg(
        F.element_at(ranks, F.greatest(rank, F.lit(1)).cast("int")).alias("status"),
        F.when(refused, False).otherwise(F.coalesce(F.first("own_bathing"), said)).alias("bathing"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "warning"))), lambda w: w["warning"]), "; ").alias("warnings"),
    )


def without_private(records: DataFrame, exclusions: DataFrame, radius_m: float = 1000.0) -> DataFrame:
    """Records that no exclusion names: by source reference, by distance, by name.

    ``exclusions``: ref, ex_lat, ex_lng, pattern; unset parts don't apply.
    """
    refs = records.select("id", F.explode_outer("refs").alias("ref")).join(exclusions.where("ref is not null").select("ref"), "ref", "left_semi").select("id")
    spots = exclusions.where("ex_lat is not null").select(F.col("ex_lat").alias("r_lat"), F.col("ex_lng").alias("r_lng"))
    near = radius_join(records.select("id", "lat", "lng"), spots, radius_m, how="broadcast").select("id")
    # a reviewed list of patterns becomes one alternation for one scan
    patterns = exclusions.where("pattern is not null").agg(F.array_join(F.array_sort(F.collect_set("pattern")), "|").alias("all_patterns"))
    named = records.select("id", "name").join(F.broadcast(patterns)).where((F.col("all_patterns") != "") & F.rlike("name", F.concat(F.lit("(?i)"), F.col("all_patterns")))).select("id")
    return records.join(refs.unionByName(near).unionByName(named), "id", "left_anti")
