"""Duplicates of the same spring: a greedy fold in input order within proximity clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_m
from .cluster import cell_links, components
from .spatial import radius_join

#: Fixed values, metres: same name; one name inside the other; the same with a short name or no names.
SAME_NAME_M, PART_NAME_M, SHORT_NAME_M, SHORT = 300.0, 60.0, 12.0, 4


def same_spring(a_name: Column, b_name: Column, a_kind: Column, b_kind: Column, metres: Column) -> Column:
    """Whether two records are one spring; names are normalised, '' if unknown."""
    both, one = (a_name != "") & (b_name != ""), (a_name != "") != (b_name != "")
    part = F.contains(a_name, b_name) | F.contains(b_name, a_name)
    near = F.when(F.least(F.length(a_name), F.length(b_name)) <= SHORT, SHORT_NAME_M).otherwise(PART_NAME_M)
    kinds = a_kind.isNotNull() & b_kind.isNotNull() & (a_kind != b_kind)
    return F.when(both & (a_name == b_name), metres <= SAME_NAME_M).when(both, part & (metres <= near)).when(one, kinds & (metres <= PART_NAME_M)).otherwise(metres <= SHORT_NAME_M)


def _metres(a: tuple, b: tuple) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def _same(a, b) -> bool:
    d = _metres((a.lat, a.lng), (b.lat, b.lng))
    x, y = a.norm, b.norm
    if x and y:
        return d <= SAME_NAME_M if x == y else (x in y or y in x) and d <= (SHORT_NAME_M if min(len(x), len(y)) <= SHORT else PART_NAME_M)
    if x or y:
        return a.kind is not None and b.kind is not None and a.kind != b.kind and d <= PART_NAME_M
    return d <= SHORT_NAME_M


def survivors(records: DataFrame) -> DataFrame:
    """(id, survivor): each record's survivor, itself if nothing replaced it.

    ``records``: id, ord, lat, lng, norm, kind, completeness.  In order of
    ``ord``, a record joins the first kept record that is the same spring; the
    more complete one stays, the earlier at a tie.  Records are the same spring
    only within 300 m under one name, or within 60 m: clusters of both kinds,
    joined where they share a record, fold alone.
    """
    named, by_name = cell_links(records.where("norm <> ''"), SAME_NAME_M, key="norm")
    close, nearby = cell_links(records, PART_NAME_M)
    edges = by_name.unionByName(nearby)
    for hubs in (named, close):
        edges = edges.unionByName(hubs.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    roots = components(edges, shuffled=True)
    # a cluster's root is no node of the table
    labelled = records.join(roots.hint("merge"), records["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    grouped = labelled.select("id", "ord", "lat", "lng", "norm", "kind", "completeness", "root")

    def fold(group: list) -> list[tuple[int, int]]:
        kept: list = []
        into: dict[int, int] = {}
        for r in group:
            for i, k in enumerate(kept):
                if _same(k, r):
                    stays, goes = (r, k) if r.completeness > k.completeness else (k, r)
                    into[goes.id] = stays.id
                    if stays is r:
                        del kept[i]
                        kept.append(r)
                    break
            else:
                kept.append(r)
        out = []
        for r in group:
            last = r.id
            while last in into:
                last = into[last]
            out.append((r.id, last))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for r in batch.itertuples(index=False):
                if group and group[0].root != r.root:
                    out += fold(group)
                    group = []
                group.append(r._replace(kind=None if pd.isna(r.kind) else r.kind))
            yield pd.DataFrame(out, columns=["id", "survivor"])
        yield pd.DataFrame(fold(group), columns=["id", "survivor"])

    # clusters are small and many: one sorted stream a task, not a call a cluster
    folded = grouped.repartition("root").sortWithinPartitions("root", "ord").mapInPandas(run, "id long, survivor long")
    return records.select("id").join(folded.hint("merge"), "id", "left").select("id", F.coalesce("survivor", "id").alias("survivor"))


def pairs_of_one_spring(records: DataFrame) -> DataFrame:
    """(a, b, metres): all pairs that are the same spring, without the fold.

    Records further apart than 60 m meet only under one name.
    """
    own = records.select(F.col("id").alias("a"), "lat", "lng", "norm", "kind")
    other = records.select(F.col("id").alias("b"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("norm").alias("r_norm"), F.col("kind").alias("r_kind"))
    once = F.col("a") < F.col("b")
    same_name = (F.col("norm") == F.col("r_norm")) & (F.col("norm") != "")
    d = distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    alike = radius_join(own.where("norm <> ''"), other, SAME_NAME_M, also=(F.col("norm") == F.col("r_norm")) & once)
    close = radius_join(own, other, PART_NAME_M, also=once).where(~same_name & same_spring(F.col("norm"), F.col("r_norm"), F.col("kind"), F.col("r_kind"), d))
    return alike.unionByName(close).select("a", "b", "metres")


def merged(pairs: DataFrame, columns: list[str], key: str = "survivor") -> DataFrame:
    """Fill-only survivorship: per ``key`` each column's first known value, the survivor's own before others'."""
    own = F.struct((F.col("id") != F.col(key)).cast("int"), "ord")
    return pairs.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), own)).alias(c) for c in columns], F.count("*").alias("merged"))
