"""Reviewed field-level claims over records: validation, application, contests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..functions.parse import sound_url

#: Claimable fields and their types; lists are joined by '|'.
FIELDS = {"temperature.celsius": "double", "temperature.kind": "string", "access.price": "string", "tags": "list"}
#: Disagreement below this is none, °C.
SLACK_C = 0.5


def errors(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(id, field, errors) of the claims that must not be applied.

    ``claims``: id, field, value, source, contributor; ``known``: id.
    """
    number = F.col("value").try_cast("double")
    checks = (
        (F.col("_known").isNull(), "unknown id"),
        (~F.col("field").isin(*FIELDS), "field not claimable"),
        (~sound_url(F.col("source")), "source is no public https URL"),
        (F.coalesce(F.trim("contributor"), F.lit("")) == "", "no contributor"),
        ((F.col("field") == "temperature.celsius") & (number.isNull() | F.isnan(number)), "not a number"),
        ((F.col("field") == "temperature.celsius") & ~number.between(-5, 130), "out of range"),
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(message)) for c, message in checks]))
    marked = claims.join(known.select("id", F.lit(True).alias("_known")), "id", "left")
    return marked.select("id", "field", F.array_join(found, "; ").alias("errors")).where("errors <> ''")


def _claim(field: str) -> Column:
    return F.max(F.when(F.col("field") == field, F.col("value")))


def apply(records: DataFrame, claims: DataFrame) -> DataFrame:
    """``records`` (id, celsius, price, tags) with active claims in place; tags are united, other fields replaced.

    The other unit of a claimed temperature is derived; ``curated`` tells
    whether any claim was applied.
    """
    wide = claims.where("state = 'active'").groupBy("id").agg(
        _claim("temperature.celsius").try_cast("double").alias("c_celsius"), _claim("access.price").alias("c_price"), _claim("tags").alias("c_tags")
    )
    joined = records.join(wide, "id", "left")
    celsius = F.coalesce("c_celsius", "celsius")
    more = F.when(F.col("c_tags").isNotNull(), F.split("c_tags", r"\|")).otherwise(F.array().cast("array<string>"))
    return joined.select(
        "id", celsius.alias("celsius"), half_up(celsius * 9 / 5 + 32, 1).alias("fahrenheit"), F.coalesce("c_price", "price").alias("price"),
        F.array_distinct(F.concat("tags", more)).alias("tags"), (F.coalesce("c_celsius", "c_price", "c_tags").isNotNull()).alias("curated"),
    )


def contests(records: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, field, ours, theirs): active claims that disagree with a known upstream value."""
    active = claims.where("state = 'active'").join(records, "id")
    theirs = F.when(F.col("field") == "temperature.celsius", F.col("celsius").cast("string")).when(F.col("field") == "access.price", F.col("price")).when(F.col("field") == "tags", F.array_join("tags", "|"))
    gap = F.abs(F.col("value").try_cast("double") - F.col("celsius")) > SLACK_C
    ours = F.split("value", r"\|")
    sets = (F.size(F.array_except(ours, "tags")) > 0) | (F.size(F.array_except("tags", ours)) > 0)
    differs = F.when(F.col("field") == "temperature.celsius", gap).when(F.col("field") == "tags", sets).otherwise(F.col("value") != theirs)
    return active.where((F.coalesce(theirs, F.lit("")) != "") & F.coalesce(differs, F.lit(False))).select("id", "field", F.col("value").alias("ours"), theirs.alias("theirs"))


def agreed(readings: DataFrame, key: str, value: str, order: str, tolerance: float) -> DataFrame:
    """(key, agreed, n): the first reading of a key if all lie within ``tolerance``, else null; never a mean."""
    spread = F.max(value) - F.min(value)
    return readings.groupBy(key).agg(F.when(spread <= tolerance, F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))).alias("agreed"), F.count(value).alias("n"))
