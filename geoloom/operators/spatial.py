"""Spatial joins on an exploded grid: an equi-join on cells, then the exact distance.

Points have ``lat`` and ``lng``; columns that both sides share must be renamed
before.  One side's rows are copied to about five cells each; it should be the
smaller one.  Spark's estimate of a table's size doesn't count these copies, so
large tables would be broadcast through the driver: such joins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, cell, cells_near, crosses, distance_m, half_up, in_box
from ..shared import written


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, also: Column | None = None, spread: str = "right", how: str = "merge") -> DataFrame:
    """Pairs within ``radius_m``, with ``metres`` (whole), for which ``also`` holds too.

    ``right`` has ``r_lat`` and ``r_lng``.  Rows without a position pair with none.  An equality in ``also`` is part of the join's key.
    ``spread`` names the side whose rows are copied to their cells, ``how`` the join's hint: only a short reviewed list may be broadcast.
    """
    here, there = (F.col("lat"), F.col("lng"), radius_m), (F.col("r_lat"), F.col("r_lng"), radius_m)
    keyed = left.withColumn("_cell", F.explode(cells_near(*here)) if spread == "left" else cell(*here))
    near = right.withColumn("_r_cell", F.explode(cells_near(*there)) if spread == "right" else cell(*there))
    exact = distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    met = F.col("_cell") == F.col("_r_cell")
    joined = keyed.join(near.hint(how), met if also is None else met & also).withColumn("_d", exact).where(F.col("_d") <= radius_m)
    return joined.withColumn("metres", half_up(F.col("_d")).cast("long")).drop("_cell", "_r_cell", "_d")


def without_neighbour(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Rows of ``left`` with no row of ``right`` within ``radius_m`` (whole metres)."""
    near = right.select(F.explode(cells_near(F.col("r_lat"), F.col("r_lng"), radius_m + 1)).alias("_r_cell"), "r_lat", "r_lng")
    keyed = left.withColumn("_cell", cell(F.col("lat"), F.col("lng"), radius_m + 1))
    close = half_up(distance_m(keyed["lat"], keyed["lng"], near["r_lat"], near["r_lng"])) <= radius_m
    return keyed.join(near.hint("merge"), (keyed["_cell"] == near["_r_cell"]) & close, "left_anti").drop("_cell")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_order: Column, radius_m: float) -> DataFrame:
    """For each left row its nearest right row within ``radius_m``; ties keep the first of ``right_order``.

    A nearest row further away would be rejected for its distance anyway, so
    the grid loses nothing.  ``left`` should be the smaller table.
    """
    pairs = radius_join(left, right, radius_m, spread="left").withColumn("_exact", distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng")))
    rank = F.row_number().over(W.partitionBy(left_id).orderBy("_exact", right_order))
    return pairs.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_exact")


#: Cells of the first level are 45 degrees wide, those of each further one an eighth of that: the last about 150 m.
FIRST_DEG, SPLIT, LEVELS = 45.0, 8, 6
#: Metres of room for rounding.
ROUNDING_M = 0.01


def nearest_anywhere(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, metres): each left row's nearest right row at any distance; the smallest ``right_id`` at a tie.

    ``left`` has lat and lng, ``right`` r_lat and r_lng; rows without a position take no part, and without
    right rows there are none.  Branch and bound by levels of ever smaller cells: each cell with rows has one of
    them as its representative, so a point knows a row within reach, and cells that lie further away than that
    however their rows lie are dropped.  What is left is replaced by its smaller cells, by an
    equi-join a level; at the end the rows of the last cells are compared.
    """
    size = lambda level: FIRST_DEG / SPLIT**level
    turned = F.pmod(F.col("r_lng") + 180, F.lit(360.0))
    last = LEVELS - 1
    rows = right.where("r_lat is not null and r_lng is not null").select(
        F.col(right_id).alias("_rep"), F.col("r_lat").alias("_y1"), F.col("r_lng").alias("_x1"), F.floor((F.col("r_lat") + 90) / size(last)).alias("_y"), F.floor(turned / size(last)).alias("_x")
    )
    # every level above is made of these
    cells = {last: written(rows.groupBy("_y", "_x").agg(F.min(F.struct("_rep", "_y1", "_x1")).alias("r")).select("_y", "_x", "r.*"), "nearest-cells")}
    up = lambda c: F.floor(F.col(c) / SPLIT)
    for level in range(last - 1, -1, -1):
        cells[level] = cells[level + 1].groupBy(up("_y").alias("_y"), up("_x").alias("_x")).agg(F.min(F.struct("_rep", "_y1", "_x1")).alias("r")).select("_y", "_x", "r.*")
    # at most 5 x 8 cells
    first = [F.struct(*[F.lit(r[c]).alias(c) for c in ("_y", "_x", "_y1", "_x1")]) for r in cells[0].collect()]
    kind = dict(right.dtypes)[right_id]
    if not first:
        return left.select(left_id, F.lit(None).cast(kind).alias(right_id), F.lit(None).cast("long").alias("metres")).where("false")
    away = distance_m(F.col("lat"), F.col("lng"), F.col("_y1"), F.col("_x1"))
    open_cells = left.where("lat is not null and lng is not null").select(left_id, "lat", "lng", F.explode(F.array(*first)).alias("c")).select(left_id, "lat", "lng", "c.*")
    for level in range(LEVELS):
        # along a meridian, then a parallel: no two points of a cell are further apart
        south = F.col("_y") * size(level) - 90
        widest = F.when((south < 0) & (south + size(level) > 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(south), F.abs(south + size(level))))))
        across = size(level) * DEGREE_M * (1 + widest)
        reach = F.min("_d").over(W.partitionBy(left_id))
        near = open_cells.withColumn("_d", away).withColumn("_reach", reach).where(F.col("_d") - across <= F.col("_reach") + ROUNDING_M).select(left_id, "lat", "lng", "_y", "_x")
        if level == last:
            open_cells = near.join(rows.hint("merge"), ["_y", "_x"])
            break
        below = cells[level + 1].select(up("_y").alias("_py"), up("_x").alias("_px"), "_y", "_x", "_y1", "_x1")
        # the second level has at most 40 x 64 cells, the third 64 times as many; all others grow with the table
        below = F.broadcast(below) if level <= 1 else below.hint("merge")
        open_cells = near.withColumnsRenamed({"_y": "_py", "_x": "_px"}).join(below, ["_py", "_px"]).select(left_id, "lat", "lng", "_y", "_x", "_y1", "_x1")
    best = open_cells.withColumn("_d", away).groupBy(left_id).agg(F.min(F.struct("_d", "_rep")).alias("b"))
    return best.select(left_id, F.col("b._rep").alias(right_id), half_up(F.col("b._d")).cast("long").alias("metres"))


def gaps(left: DataFrame, right: DataFrame, radius_m: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, metres): left rows without a right row within ``radius_m`` (whole metres), and their nearest one, null if there is none.

    Only rows that the radius leaves over look further; they are found once and written.  A row without a position has no neighbour and no nearest one.
    """
    alone = written(without_neighbour(left, right, radius_m).select(left_id, "lat", "lng"), "alone")
    return alone.select(left_id).join(nearest_anywhere(alone, right, left_id, right_id).hint("merge"), left_id, "left")


def box_join(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with each box (west, south, east, north) that holds them.

    Boxes are keyed by whole-degree cells, so a world of small boxes stays an
    equi-join.
    """
    degrees = lambda a, b: F.sequence(F.floor(a), F.floor(b))
    keyed = boxes.withColumn("_y", F.explode(degrees("south", "north"))).withColumn("_x", F.explode(degrees("west", "east")))
    inside = in_box(F.col("lat"), F.col("lng"), F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    return points.withColumns({"_y": F.floor("lat"), "_x": F.floor("lng")}).join(keyed, ["_y", "_x"]).where(inside).drop("_y", "_x")


def polygon_of(points: DataFrame, edges: DataFrame, point_id: str) -> DataFrame:
    """The first polygon that holds each point, by the parity of edge crossings.

    ``edges``: poly, ord, ring (0 is the outer one), lat1, lng1, lat2, lng2, and
    the polygon's box (west, south, east, north).  Points outside all are left out.
    """
    boxes = edges.select("poly", "ord", "west", "south", "east", "north").distinct()
    near = box_join(points.select(point_id, "lat", "lng"), boxes).select(point_id, "lat", "lng", "poly", "ord")
    hit = crosses(F.col("lat"), F.col("lng"), F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    # only edges in a point's band of a degree can cross its ray; a polygon alone would be a hot key
    band = F.explode(F.sequence(F.floor(F.least("lat1", "lat2")), F.floor(F.greatest("lat1", "lat2"))))
    banded = edges.select("poly", "ring", "lat1", "lng1", "lat2", "lng2", band.alias("_band"))
    rings = near.withColumn("_band", F.floor("lat")).join(banded, ["poly", "_band"]).groupBy(point_id, "poly", "ord", "ring").agg((F.sum(hit.cast("int")) % 2 == 1).alias("inside"))
    whole = rings.groupBy(point_id, "poly", "ord").agg(F.bool_or((F.col("ring") == 0) & F.col("inside")).alias("outer"), F.bool_or((F.col("ring") > 0) & F.col("inside")).alias("hole"))
    return whole.where("outer and not hole").groupBy(point_id).agg(F.min_by("poly", "ord").alias("poly"))


def nearest_polygon(points: DataFrame, edges: DataFrame, point_id: str, most_deg: float = 0.5) -> DataFrame:
    """(point_id, poly) for points less than ``most_deg`` from an outer ring, in plain degrees; the first polygon at a tie.

    Edges are keyed by the whole-degree cells that their box, widened by
    ``most_deg``, touches, so a point meets only the boundary around it.
    """
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) - most_deg), F.floor(F.greatest(a, b) + most_deg))
    outer = edges.where("ring = 0").select("poly", "ord", "lat1", "lng1", "lat2", "lng2")
    keyed = outer.withColumn("_y", F.explode(span(F.col("lat1"), F.col("lat2")))).withColumn("_x", F.explode(span(F.col("lng1"), F.col("lng2"))))
    dx, dy = F.col("lng2") - F.col("lng1"), F.col("lat2") - F.col("lat1")
    x, y, long = F.col("lng") - F.col("lng1"), F.col("lat") - F.col("lat1"), dx * dx + dy * dy
    t = F.when(long == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x * dx + y * dy) / F.nullif(long, F.lit(0.0)))))
    near = points.select(point_id, "lat", "lng", F.floor("lat").alias("_y"), F.floor("lng").alias("_x")).join(keyed, ["_y", "_x"])
    away = near.withColumn("_d", F.hypot(x - t * dx, y - t * dy)).where(F.col("_d") < most_deg)
    return away.groupBy(point_id).agg(F.min_by("poly", F.struct("_d", "ord")).alias("poly"))


def country_of(points: DataFrame, edges: DataFrame, point_id: str, unknown: str = "XX") -> DataFrame:
    """(point_id, poly, exact) of every point: the polygon that holds it, else the nearest within half a degree, else ``unknown``."""
    inside = polygon_of(points, edges, point_id)
    nearest = nearest_polygon(points.join(inside, point_id, "left_anti"), edges, point_id)
    found = inside.withColumn("exact", F.lit(True)).unionByName(nearest.withColumn("exact", F.lit(False)))
    return points.select(point_id).join(found, point_id, "left").select(point_id, F.coalesce("poly", F.lit(unknown)).alias("poly"), F.coalesce("exact", F.lit(False)).alias("exact"))


def unique_both_ways(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """``pairs`` with a ``verdict``: matched, or why not.

    ``many_right``: the left row has several partners; ``claimed``: the partner
    is wanted by several of the left rows that have just one.
    """
    mine = F.count("*").over(W.partitionBy(left_id))
    first = pairs.withColumn("_mine", mine)
    theirs = F.count(F.when(F.col("_mine") == 1, 1)).over(W.partitionBy(right_id))
    verdict = F.when(F.col("_mine") > 1, "many_right").when(F.col("_theirs") > 1, "claimed").otherwise("matched")
    return first.withColumn("_theirs", theirs).withColumn("verdict", verdict).drop("_mine", "_theirs")
