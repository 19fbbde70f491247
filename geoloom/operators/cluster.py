"""Single-linkage clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, cell, cells_near, distance_m
from ..shared import written

MOST_ROUNDS = 60
#: Nodes that a task holds at once.
MOST_NODES = 1 << 20


def _forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: each task hangs the nodes of its own edges under their smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        def hung() -> Iterator[pa.RecordBatch]:
            pairs = [(x, y) for x in above if x != (y := top(x))]
            for i in range(0, len(pairs), 1 << 16):
                yield pa.record_batch([pa.array([p[k] for p in pairs[i : i + (1 << 16)]], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
            if len(above) > MOST_NODES:
                yield from hung()
                above.clear()
        yield from hung()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def _settled(stars: DataFrame) -> bool:
    """Whether each node has one edge, to a node without any: then its component is known."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).unionByName(stars.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf > 1 or leaf = 1 and hub = 1").isEmpty()


def components(edges: DataFrame, shuffled: bool = False, near: Sequence[str] = ()) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b; whole numbers) reaches.

    Each task first contracts its own edges (it holds one entry a node of
    theirs, about ``MOST_NODES`` at once); alternating large and small stars join what is left.  Rounds are
    written to the shared folder and grow with the logarithm of the longest
    chain; a run that doesn't settle in ``MOST_ROUNDS`` raises.  The files that
    hold them are a fraction of their rows; ``shuffled`` keeps joins from trusting Spark's estimate of the size.
    Edges of equal ``near`` meet in one task first (those of a very common value in several), which leaves rounds
    only for what reaches further; whatever these columns hold, the result is the same.
    """
    told = lambda df: df.hint("merge") if shuffled else df
    edges = edges.where("a <> b")
    stars = written(_forests(edges.hint("rebalance", *map(F.col, near)) if near else edges), "stars")
    for _ in range(MOST_ROUNDS):
        if _settled(stars):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(told(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(told(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = written(small.where("a <> b").distinct(), "stars")
    raise RuntimeError("the clusters did not settle")


#: Metres of room for rounding.
ROUNDING_M = 0.01
#: Each level of smaller cells is an eighth as wide.
SPLIT = 8


def _cells(rows: DataFrame, side_m: float) -> DataFrame:
    """``rows`` (lat, lng) with ``_y`` and ``_x``: cells at most ``side_m`` high and wide; columns are as wide as their row's latitude lets them be."""
    height = side_m / DEGREE_M
    y = F.floor(F.col("lat") / height)
    return rows.withColumn("_y", y).withColumn("_x", F.floor(F.pmod(F.col("lng") + 180, F.lit(360.0)) / _width(F.col("_y"), height)))


def _width(y: Column, height: float) -> Column:
    """Degrees of longitude of a row's cells."""
    equator = F.when((y <= 0) & (y >= -1), 0.0).otherwise(F.least(F.abs(y), F.abs(y + 1)) * height)
    return F.least(F.lit(360.0), height / F.greatest(F.cos(F.radians(F.least(equator, F.lit(90.0)))), F.lit(1e-9)))


def cell_links(points: DataFrame, radius_m: float, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hubs, links): a hub for each point, and pairs of hubs (a, b), with the clusters that all pairs within ``radius_m`` would give.

    ``points``: id, lat, lng and maybe ``key``; only points of one key are linked, and none without an id or a position.  Points of a cell, whose diagonal is shorter than the
    radius, are linked to the smallest id in it.  Two cells need one pair of points in reach: first one point of each is tried, then the
    points of one cell against the other cell's smaller and smaller ones, as far as the radius leaves open whether they reach; so no two
    points are compared but in cells of about a hundredth of the radius.
    """
    side = radius_m / 2**0.5 * 0.999
    named = points.withColumn("_k", F.col(key) if key else F.lit(0)).where("id is not null and lat is not null and lng is not null")
    spots = _cells(named.groupBy("_k", "lat", "lng").agg(F.min("id").alias("id")), side)
    spots = written(spots, "spots")
    cells = spots.groupBy("_k", "_y", "_x").agg(F.min(F.struct("id", "lat", "lng")).alias("r")).select("_k", "_y", "_x", F.col("r.id").alias("hub"), "r.lat", "r.lng")
    cells = written(cells, "cells")
    hubs = named.join(spots.select("_k", "lat", "lng", "_y", "_x").hint("merge"), ["_k", "lat", "lng"]).join(cells.select("_k", "_y", "_x", "hub").hint("merge"), ["_k", "_y", "_x"]).select(points["id"].alias("node"), "hub")

    # neighbours meet in a coarse grid; each pair once, from the smaller hub
    mine = cells.select("_k", "hub", "lat", "lng", "_y", "_x").withColumn("_cell", cell(F.col("lat"), F.col("lng"), 3 * radius_m))
    theirs = cells.select(F.col("_k").alias("_k2"), F.col("hub").alias("other"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("_y").alias("_y2"), F.col("_x").alias("_x2"), F.explode(cells_near(F.col("lat"), F.col("lng"), 3 * radius_m)).alias("_cell2"))
    d = distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    # the copies aren't in Spark's estimate of the size, nor what the files are compressed by: no side is broadcast
    met = mine.join(theirs.hint("merge"), (F.col("_k") == F.col("_k2")) & (F.col("_cell") == F.col("_cell2"))).where("hub < other").withColumn("_d", d)
    # a cell's points lie at most its diagonal, less than the radius, from its hub
    pairs = written(met.where(F.col("_d") <= 3 * radius_m).select("_k", "hub", "other", "_y", "_x", "_y2", "_x2", "_d"), "cell-pairs")
    sure = pairs.where(F.col("_d") <= radius_m).select(F.col("hub").alias("a"), F.col("other").alias("b"))
    unsure = pairs.where(F.col("_d") > radius_m)

    inner = spots.select("_k", "_y", "_x", "id", "lat", "lng")
    fine = [_cells(inner.select("_k", F.col("_y").alias("_y0"), F.col("_x").alias("_x0"), "lat", "lng"), side / SPLIT**i).withColumnsRenamed({"_y": f"_y{i}", "_x": f"_x{i}"}) for i in (1, 2)]
    one = fine[0].groupBy("_k", "_y0", "_x0", "_y1", "_x1").agg(F.min(F.struct("lat", "lng")).alias("r"))
    both = fine[0].join(fine[1].hint("merge"), ["_k", "_y0", "_x0", "lat", "lng"])
    two = both.groupBy("_k", "_y0", "_x0", "_y1", "_x1", "_y2", "_x2").agg(F.min(F.struct("lat", "lng")).alias("r"))
    near = unsure.join(inner.select("_k", "_y", "_x", "lat", "lng").hint("merge"), ["_k", "_y", "_x"]).select("_k", "hub", "other", F.col("_y2").alias("_y0"), F.col("_x2").alias("_x0"), "lat", "lng")
    links = sure
    for level, (table, keys) in enumerate(((one, ["_k", "_y0", "_x0"]), (two, ["_k", "_y0", "_x0", "_y1", "_x1"]), (both, ["_k", "_y0", "_x0", "_y1", "_x1", "_y2", "_x2"]))):
        told = table if level < 2 else table.withColumn("r", F.struct("lat", "lng")).drop("lat", "lng")
        tried = near.join(told.hint("merge"), keys).withColumn("_d", distance_m(F.col("lat"), F.col("lng"), F.col("r.lat"), F.col("r.lng")))
        links = links.unionByName(tried.where(F.col("_d") <= radius_m).select(F.col("hub").alias("a"), F.col("other").alias("b")).distinct())
        if level < 2:
            across = 2 * side / SPLIT ** (level + 1) + ROUNDING_M
            near = tried.where((F.col("_d") > radius_m) & (F.col("_d") - across <= radius_m)).drop("r", "_d")
            near = written(near, "open-cells")
    return hubs, links.distinct()


def linked(points: DataFrame, radius_m: float, key: str | None = None) -> DataFrame:
    """(node, root): every point with a position, and the smallest id of its cluster."""
    hubs, links = cell_links(points, radius_m, key)
    roots = components(links, shuffled=True)
    return hubs.join(roots.withColumnsRenamed({"node": "_hub"}).hint("merge"), F.col("hub") == F.col("_hub"), "left").select("node", F.coalesce("root", "hub").alias("root"))


def labelled(points: DataFrame, link_m: float = 500.0) -> DataFrame:
    """``points`` with ``site`` (least id of the cluster); a point without a position is alone."""
    roots = linked(points, link_m)
    return points.join(roots.hint("merge"), points["id"] == roots["node"], "left").withColumn("site", F.coalesce("root", "id")).drop("node", "root")


def sites(points: DataFrame, link_m: float = 500.0) -> DataFrame:
    """``labelled`` points with ``springs`` (the size of their cluster)."""
    found = labelled(points, link_m)
    sizes = found.groupBy("site").agg(F.count("*").alias("springs"))
    return found.join(sizes.hint("merge"), "site")
