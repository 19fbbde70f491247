"""The interactive query: filters, text search, ranking, near-me."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_m, half_up


@dataclass(frozen=True)
class Filters:
    """What a user has chosen; empty choices don't filter."""

    least_c: float = 0.0
    most_c: float = 100.0
    unknown_temperature: bool = True
    price: str = "any"
    policies: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    country: str | None = None
    open_now: bool = False
    query: str = ""

    def predicate(self, columns: Collection[str] = ()) -> Column:
        """One predicate, never null; the upper bound is off at 100 and more.

        Words are looked for in name, country and region, and in nearest_town and
        tags (an array) where ``columns`` has them.
        """
        t = F.col("celsius")
        warm = t >= self.least_c if self.most_c >= 100 else t.between(self.least_c, self.most_c)
        out = F.when(t.isNull(), F.lit(self.unknown_temperature)).otherwise(warm)
        said = F.coalesce(F.nullif("price", F.lit("")), F.lit("?"))
        out &= {"any": F.lit(True), "free": said == "Free", "paid": ~said.isin("?", "Free"), "unknown": said == "?"}[self.price]
        if self.policies:
            out &= F.coalesce(F.col("policy").isin(*self.policies), F.lit(False))
        if self.types:
            out &= F.coalesce(F.col("kind").isin(*self.types), F.lit(False))
        if self.country:
            out &= F.coalesce(F.col("country") == self.country, F.lit(False))
        if self.open_now:
            out &= F.coalesce(F.col("hours") == "open", F.lit(False))
        if words := self.query.strip().lower():
            said = [F.nullif(c, F.lit("")) for c in ("name", "country", "region", "nearest_town") if c != "nearest_town" or c in columns]
            if "tags" in columns:
                said.append(F.filter("tags", lambda t: t != ""))
            text = F.lower(F.concat_ws(" ", *said))
            out &= F.contains(text, F.lit(words))
        return out


def search(springs: DataFrame, filters: Filters, near: tuple[float, float] | None = None, limit: int = 60) -> DataFrame:
    """The first ``limit`` springs: nearest first, or the most complete; ties by id."""
    found = springs.where(filters.predicate(springs.columns))
    if near:
        metres = half_up(distance_m(F.col("lat"), F.col("lng"), F.lit(near[0]), F.lit(near[1]))).cast("long")
        return found.withColumn("metres", metres).orderBy("metres", "id").limit(limit)
    return found.orderBy(F.desc("completeness"), "id").limit(limit)


def publish_order(records: DataFrame, country: str = "country", name: str = "name") -> DataFrame:
    """By country, then name, as a reader of any script expects; records without a name last.

    One sort by range.  A missing country counts as empty; U+FFFF collates
    after every name.
    """
    collated = lambda column, empty: F.collate(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(empty)), "UNICODE")
    return records.orderBy(collated(country, ""), collated(name, "\uffff"))
