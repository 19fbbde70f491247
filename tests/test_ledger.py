"""The ledger, in batches and as a stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from geoloom.operators import admission, ledger
from geoloom.streaming import ledger as states

PUTS = "key string, at timestamp, claims long, expected long"


def day(n, hour=0):
    return datetime.datetime(2026, 1, n, hour)


def test_stream_compares_versions_and_expires(spark, tmp_path):
    batches = [
        [("a", day(1), 3, 0), ("a", day(1, 1), 4, 0), ("b", day(1), 5, None), (None, day(1), 1, 0), ("c", None, 1, 0), ("d", day(1), -1, 0)],
        [("a", day(2), 6, 1), ("a", day(1, 12), 7, None), ("b", day(3), 1, 9)],
        [("x", day(8, 12), 1, 0)],  # b's seven days are over once this is seen
        [("b", day(8, 13), 2, 0), ("late", day(2), 1, 0)],
        [("x", day(20), 1, 1)],
        [("x", day(20, 1), 1, 2)],
    ]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    try:
        source = str(tmp_path / "in")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, PUTS).coalesce(1).write.mode("append").parquet(source)
            stream = states.ledger_states(spark.readStream.schema(PUTS).parquet(source))
            query = stream.writeStream.foreachBatch(lambda df, _, i=i: seen.extend((i, r["key"], r["claims"], r["version"], r["outcome"]) for r in df.collect())).outputMode("update")
            query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        bad = spark.read.schema(PUTS).parquet(source)
    finally:
        spark.conf.set(provider, before)
    told = sorted(x[1:] for x in seen)
    assert told == sorted([
        ("a", 3, 1, "put"), ("a", 4, 1, "lost the race"), ("a", 7, 2, "put"), ("a", 6, 2, "lost the race"), ("a", 7, 2, "expired"),
        ("b", 5, 1, "put"), ("b", 1, 1, "lost the race"), ("b", 5, 1, "expired"), ("b", 2, 1, "put"), ("b", 2, 1, "expired"),
        ("x", 1, 1, "put"), ("x", 1, 2, "put"), ("x", 1, 3, "put"),
    ])
    assert {(r["key"], r["reason"]) for r in states.refused(bad).collect()} == {(None, "no key"), ("c", "no date"), ("d", "negative claims")}


def test_upsert_keeps_the_batch(spark):
    """The batch's entry stays whatever its date; an undated or old one removes the key."""
    schema = "key string, at timestamp, claims long"
    old = spark.createDataFrame([("a", day(9), 1), ("b", day(9), 2), ("c", day(1), 3), ("d", day(9), 4)], schema)
    batch = spark.createDataFrame([("a", day(8), 10), ("b", None, 20), ("e", day(9), 50)], schema)
    got = {(r["key"], r["claims"]) for r in admission.upsert(old, batch, F.lit(day(10)).cast("timestamp")).collect()}
    assert got == {("a", 10), ("d", 4), ("e", 50)}


@pytest.mark.parametrize(
    ("pr", "sha", "author", "claims", "verdict"),
    [(1, "s1", "ann", 1, "already reviewed"), (2, "s1", "ann", 26, "too many claims (26 > 25)"), (2, "s1", "ann", 25, "ok"), (2, "s1", "bob", 11, "author cap"), (2, "s1", "bob", 10, "ok"),
     (2, "s1", "cat", 0, "ok"), (2, "s1", None, None, "ok")],
)
def test_eligible(spark, pr, sha, author, claims, verdict):
    rows = [("review/1/s1", day(5), 20), ("author/ann/1/s1", day(4), 30), ("author/bob/3/x", day(5), 20), ("review/3/x", day(5), 40), ("review/4/x", day(4), 90), ("review/5/x", None, 90), ("reviews/6", day(5), 90)]
    have = spark.createDataFrame(rows, "key string, at timestamp, claims long")
    asked = spark.createDataFrame([(pr, sha, author, claims)], "pr int, sha string, author string, claims long")
    assert ledger.eligible(asked, have, F.lit(day(5, 7)).cast("timestamp")).first()["verdict"] == verdict
    full = have.unionByName(spark.createDataFrame([("review/7/x", day(5), 40)], have.schema))
    if verdict == "ok" and claims:
        assert ledger.eligible(asked, full, F.lit(day(5, 7)).cast("timestamp")).first()["verdict"] == "over budget"
