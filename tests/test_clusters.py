"""Clusters without all pairs, against union-find over all pairs."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from geoloom.operators import cluster, dedupe, spatial
from geoloom.plans.queries import QUERIES


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def grouped(points, radius, key=lambda p: 0):
    above = {p[0]: p[0] for p in points}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if key(a) == key(b) and metres(a[1:3], b[1:3]) <= radius:
                x, y = top(a[0]), top(b[0])
                above[max(x, y)] = min(x, y)
    return {p[0]: top(p[0]) for p in points}


@pytest.mark.parametrize(("lat", "lng", "spread"), [(0.0, 0.0, 0.03), (-33.0, 179.99, 0.04), (64.0, -20.0, 0.04), (89.95, 0.0, 0.06), (47.0, 8.0, 0.012)])
def test_clusters_are_those_of_all_pairs(spark, lat, lng, spread):
    rng = random.Random(str((lat, lng)))
    wide = spread / max(0.01, math.cos(math.radians(lat)))
    points = [(i * 7 % 400, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (lng + rng.uniform(-wide, wide) + 180) % 360 - 180, rng.choice("ab")) for i in range(400)]
    points += [(500 + i, *p[1:]) for i, p in enumerate(points[:40])]
    frame = spark.createDataFrame(points, "id long, lat double, lng double, name string").repartition(4)
    for radius in (300.0, 500.0):
        assert {r["node"]: r["root"] for r in cluster.linked(frame, radius).collect()} == grouped(points, radius)
    assert {r["node"]: r["root"] for r in cluster.linked(frame, 400.0, key="name").collect()} == grouped(points, 400.0, key=lambda p: p[3])


def test_many_points_at_one_place(spark):
    """20,000 different positions within some hundred metres, and as many at one spot."""
    rng = random.Random(1)
    points = [(i, 10 + rng.uniform(0, 0.005), 20 + rng.uniform(0, 0.004)) for i in range(20_000)] + [(20_000 + i, 10.1, 20.1) for i in range(20_000)] + [(99_999, None, 1.0)]
    began = time.time()
    rows = cluster.sites(spark.createDataFrame(points, "id long, lat double, lng double"))
    assert sorted(tuple(r) for r in rows.groupBy("site").agg(F.max("springs"), F.count("*")).collect()) == [(0, 20_000, 20_000), (20_000, 20_000, 20_000), (99_999, 1, 1)]
    assert time.time() - began < 120


def broadcasts(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return "Broadcast" in plan


def test_copies_of_a_large_table_are_not_broadcast(spark):
    """Spark's estimate of a table's size leaves out the copies to cells: a small estimate says nothing of them."""
    points = spark.range(1000).select("id", F.col("id").alias("ord"), (F.col("id") * 0.001).alias("lat"), F.lit(1.0).alias("lng"), F.lit("n").alias("norm"), F.lit("way").alias("kind"), F.lit(1).alias("completeness"))
    other = points.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    for side in ("left", "right"):
        assert not broadcasts(spatial.radius_join(points, other, 500, spread=side))
    assert not broadcasts(spatial.without_neighbour(points, other, 500))
    assert not broadcasts(dedupe.pairs_of_one_spring(points))
    assert not broadcasts(cluster.sites(points))
    assert not broadcasts(dedupe.survivors(points))


def final_plan(frame):
    """The plan as it ran, with what Spark changed by the sizes it met."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_sites_are_counted_without_their_sizes(spark):
    """Counting clusters needs no size of each: the rows meet their labels in one join, in no broadcast, and no row without an id counts."""
    frame = QUERIES["distinct_sites"](spark, "/root/testdata/sf0.001")
    plan = final_plan(frame)
    # points with their cells, cells with their hubs, hubs with their roots, points with their roots
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.001, 20.0), (3, None, 20.0), (None, 10.0, 20.0), (None, 10.0005, 20.0)], "id long, lat double, lng double")
    assert sorted((r["id"], r["site"]) for r in cluster.labelled(points).where("id is not null").collect()) == [(1, 1), (2, 1), (3, 3)]


def test_mates_meet_without_a_broadcast(spark):
    """The points that ask are a share of the table, so they grow with it."""
    assert "Broadcast" not in final_plan(QUERIES["place_mates"](spark, "/root/testdata/sf0.001"))


def test_gaps_are_found_once(spark):
    """The rows that the radius leaves over are not found anew to be named; only cells of the first levels are broadcast."""
    plan = final_plan(QUERIES["gap_worklist"](spark, "/root/testdata/sf0.001"))
    assert "LeftAnti" not in plan
    assert plan.count("BroadcastExchange") <= 2


@pytest.mark.parametrize(("lat", "lng"), [(0.0, 0.0), (-33.0, 179.999), (64.0, -20.0), (89.9, 0.0), (89.995, 0.0), (47.0, 8.0)])
def test_either_side_can_be_spread(spark, lat, lng):
    rng = random.Random(str((lat, lng)))
    wide = 0.03 / max(0.001, math.cos(math.radians(lat)))
    places = [(i, min(90.0, lat + rng.uniform(-0.03, 0.03)), (lng + rng.uniform(-wide, wide) + 180) % 360 - 180) for i in range(300)]
    left = spark.createDataFrame(places, "id long, lat double, lng double")
    right = left.selectExpr("id as r_id", "lat as r_lat", "lng as r_lng")
    for radius in (200, 1500):
        exact = sorted((a[0], b[0]) for a in places for b in places if metres(a[1:], b[1:]) <= radius)
        for side in ("left", "right"):
            assert sorted((r["id"], r["r_id"]) for r in spatial.radius_join(left, right, radius, spread=side).collect()) == exact
