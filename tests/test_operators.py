"""Operators on small inputs, against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import parse, text
from geoloom.functions.geo import distance_m
from geoloom.operators import cluster, dedupe, registry, rules, spatial
from geoloom.sources import readers, writers
from geoloom.streaming import events as stream


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("where", [(0, 0), (51, 179.9995), (-80, -179.9995), (89.2, 10), (10, 0)])
def test_radius_join_is_exact(spark, where):
    rng = random.Random(repr(where))
    spread = 0.02 / max(0.02, math.cos(math.radians(where[0])))
    wrap = lambda x: (x + 180) % 360 - 180
    points = [(i, where[0] + rng.uniform(-0.02, 0.02), wrap(where[1] + rng.uniform(-spread, spread))) for i in range(150)]
    left = spark.createDataFrame(points, "id long, lat double, lng double")
    right = left.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    found = {(r["id"], r["r_id"]) for r in spatial.radius_join(left, right, 500).collect()}
    assert found == {(a[0], b[0]) for a in points for b in points if metres(a[1:], b[1:]) <= 500}


def test_distance_across_the_antimeridian(spark):
    d = one(spark, distance_m(F.lit(10.0), F.lit(179.999), F.lit(10.0), F.lit(-179.999)))
    assert abs(d - metres((10, 179.999), (10, -179.999))) < 1e-6


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(500, 501)], "a long, b long")
    found = {r["node"]: r["root"] for r in cluster.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {501: 500}
    assert cluster.components(edges.where("a < 0")).count() == 0


def test_dedupe_is_the_sequential_fold(spark):
    rng = random.Random(3)
    rows = [(i, i, 40 + rng.uniform(0, 0.004), 10 + rng.uniform(0, 0.004), rng.choice(["", "blue", "bluelagoon", "geo", "geoa"]), rng.choice(["node", "way", None]), rng.randrange(0, 100, 17)) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, ord long, lat double, lng double, norm string, kind string, completeness int")
    kept, into = [], {}
    for r in rows:
        for i, k in enumerate(kept):
            d, x, y = metres(k[2:4], r[2:4]), k[4], r[4]
            if x and y:
                same = d <= 300 if x == y else (x in y or y in x) and d <= (12 if min(len(x), len(y)) <= 4 else 60)
            elif x or y:
                same = k[5] is not None and r[5] is not None and k[5] != r[5] and d <= 60
            else:
                same = d <= 12
            if same:
                stays, goes = (r, k) if r[6] > k[6] else (k, r)
                into[goes[0]] = stays[0]
                if stays is r:
                    del kept[i]
                    kept.append(r)
                break
        else:
            kept.append(r)
    expected = {}
    for r in rows:
        last = r[0]
        while last in into:
            last = into[last]
        expected[r[0]] = last
    assert {r["id"]: r["survivor"] for r in dedupe.survivors(frame).collect()} == expected


@pytest.mark.parametrize(
    ("raw", "celsius", "is_range", "word"),
    [("45", 45, False, None), ("45 C", 45, False, None), ("40-45", 45, True, None), ("113 F", 45, False, None), ("~42", 42, False, None), ("hot", None, False, "hot"),
     ("very hot", None, False, "very hot"), ("37,5 °C", 37.5, False, None), ("400", None, False, None), ("-3", -3, False, None), ("", None, False, None), (None, None, False, None)],
)
def test_temperature(spark, raw, celsius, is_range, word):
    got = one(spark, parse.parse_temperature(F.lit(raw).cast("string")))
    assert (got["celsius"], got["is_range"], got["qualitative"]) == (celsius, is_range, word)


@pytest.mark.parametrize(
    ("value", "where", "found"),
    [(40.0, "it is 2400 m", False), (42.5, "42,5 degrees", True), (42.5, "42.50 C", True), (42.5, "42,500 people", False), (38.0, "38-40", True), (40.0, "38-40", True),
     (2000.0, "2,000 yen", True), (2000.0, "2.000 Ft", True), (40.0, "38°C-40°C", True), (108.0, "89°F-108°F", True), (40.0, "at –40", False), (42.5, "42,50", False),
     (40.0, "40.0 degrees", True), (42.5, "42.55", False), (40.0, "sub-40", False), (40.0, "at -40", False), (-40.0, "at -40", True), (108.0, "89°-108°F", True), (7.0, "v7.1", False), (7.0, None, False)],
)
def test_value_in_text(spark, value, where, found):
    assert one(spark, text.value_appears(F.lit(value), F.lit(where).cast("string"))) is found


@pytest.mark.parametrize(("url", "sound"), [("https://a.org/x", True), ("http://a.org", False), ("https://u:p@a.org", False), ("https://10.0.0.1/", False), ("https://localhost/", False), ("https://x.test/", False), (None, False)])
def test_urls(spark, url, sound):
    assert one(spark, parse.sound_url(F.lit(url).cast("string"))) is sound


def test_names(spark):
    assert one(spark, text.norm_name(F.lit("Café  No. 1"))) == one(spark, text.norm_name(F.lit("Café no 1"))) == "caféno1"
    assert one(spark, text.norm_name(F.lit(None).cast("string"))) == ""
    agreeing = [("Bijah Spring", "Bijah Springs"), ("WILBUR SPRINGS", "Wilbur Hot Springs"), (None, "Blue"), ("Hot Springs", "Warm Springs and Hot Springs")]
    apart = [("The Hot Springs", "Blue"), ("SPRING (HOT)", "Lightfeather"), ("Gila Hot", "Lightfeather Warm")]
    for names, same in [*((x, True) for x in agreeing), *((x, False) for x in apart)]:
        assert one(spark, text.names_agree(*[F.lit(n).cast("string") for n in names])) is same, names
    assert one(spark, text.word_appears(F.lit("pool"), F.lit("a hot_pool"))) is True
    assert one(spark, text.word_appears(F.lit(" "), F.lit("a b"))) is False
    assert one(spark, text.names_agree(F.lit("Red"), F.lit("Blue"))) is False


def test_html(spark):
    page = "<p>a&amp;b</p><script>if (x) y = \"</p>\"</script><style>p{}</style>c <b>d</b><script>open"
    assert one(spark, text.html_text(F.lit(page))) == "a&b c d"


def test_html_entities(spark):
    assert one(spark, text.html_text(F.lit("40&amp;deg;C <> 5 &deg;"))) == "40&deg;C <> 5 °"


def test_restrict_own_status(spark):
    boxes = spark.createDataFrame([("a", 1, "view-only", None, "w1", 0.0, 0.0, 2.0, 2.0), ("b", 2, "permit", True, "w2", 0.0, 0.0, 1.0, 1.0)], "manager string, ord int, status string, bathing boolean, warning string, west double, south double, east double, north double")
    records = spark.createDataFrame([(1, 0.5, 0.5, "unknown", None), (2, 0.5, 0.5, "closed", False), (3, 1.5, 1.5, "public", True), (4, 5.0, 5.0, "public", None)], "id long, lat double, lng double, status string, bathing boolean")
    got = {r["id"]: (r["status"], r["bathing"], r["warnings"]) for r in rules.restrict(records, boxes).collect()}
    assert got == {1: ("view-only", True, "w1; w2"), 2: ("closed", False, "w1; w2"), 3: ("view-only", True, "w1")}


def test_resolve_in_three_phases(spark):
    """By reference, then by place and name in record order, then minted; against serving records one by one."""
    entries = [("s1", 1, ["node/1"], "Alpha", 10.0, 20.0), ("s2", 2, ["node/2"], "Beta", 10.0, 20.001), ("s3", 3, ["node/3"], "Beta", 10.0005, 20.001)]
    have = spark.createDataFrame([(*e, "onsen") for e in entries], "spring string, entry int, refs array<string>, name string, lat double, lng double, kind string")
    rows = [(1, ["way/9", "node/1"], "Alpha", 10.0, 20.0), (2, ["node/1"], "Alpha", 10.0, 20.0), (3, ["way/20"], "Beta", 10.0, 20.001), (4, ["way/21"], "beta", 10.0001, 20.001), (5, ["way/22"], "Beta", 10.0, 20.001), (6, ["way/23"], "Alpha", 10.0, 20.0)]
    records = spark.createDataFrame([(*r, "onsen") for r in rows], "key int, refs array<string>, name string, lat double, lng double, kind string")
    got = {r["key"]: (r["spring"], r["how"]) for r in registry.resolve(records, have).collect()}
    mint = lambda ref: one(spark, parse.mint_id(F.lit(ref)))
    assert got == {1: ("s1", "known"), 2: ("s1", "known"), 3: ("s2", "moved"), 4: ("s3", "moved"), 5: (mint("way/22"), "minted"), 6: (mint("way/23"), "minted")}


def test_mint_id(spark):
    assert one(spark, parse.mint_id(F.lit("node/1078652088"))) == "whs_8448a909f48b"


def test_private_addresses(spark):
    for address, private in (("10.1.2.3", True), ("172.20.0.1", True), ("172.40.0.1", False), ("8.8.8.8", False), ("169.254.1.1", True)):
        assert one(spark, parse.private_ipv4(F.lit(address))) is private


def test_new_events(spark):
    schema = "event_id long, ts string, type string, spring long, path string, `to` string"
    history = spark.createDataFrame([(1, "a", "claim", 5, None, "x")], schema)
    batch = spark.createDataFrame([(2, "b", "claim", 5, None, "x"), (3, "c", "claim", 5, "p", "x"), (4, "d", "claim", 5, "p", "x")], schema)
    assert [r["event_id"] for r in registry.new_events(batch, history).collect()] == [3]


def test_tiles_and_writers(spark, tmp_path):
    first = {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "A"}}, {"type": "way", "id": 1, "center": {"lat": 3.0, "lon": 4.0}}]}
    (tmp_path / "tile-1.json").write_text(json.dumps(first))
    (tmp_path / "tile-2.json").write_text(json.dumps({"elements": [first["elements"][0] | {"lat": 9.0}]}))
    rows = readers.tiles(spark, str(tmp_path)).collect()
    assert sorted((r["type"], r["lat"], r["lng"]) for r in rows) == [("node", 1.0, 2.0), ("way", 3.0, 4.0)]
    out = spark.createDataFrame([(1, 1.5, 2.5, "a\tb")], "id long, lat double, lng double, name string")
    feature = json.loads(writers.features(out).first()["value"])
    assert feature["geometry"]["coordinates"] == [2.5, 1.5]
    writers.write_tsv(out, str(tmp_path / "tsv"))
    assert readers.tsv(spark, str(tmp_path / "tsv"), "id long, lat double, lng double, name string").first()["name"] == "a b"


def test_pinned_text(spark, tmp_path):
    import hashlib

    (tmp_path / "a.tsv").write_text("x\r\ny")
    path = str(tmp_path / "a.tsv")
    assert [r["value"] for r in readers.pinned_text(spark, path, hashlib.sha256(b"x\r\ny").hexdigest()).collect()] == ["x", "y"]
    with pytest.raises(Exception, match="not the pinned one"):
        readers.pinned_text(spark, path, "0" * 64).collect()


def test_streams(spark, tmp_path):
    schema = "ts timestamp, type string, spring long, path string, `to` string, day string"
    import datetime

    at = datetime.datetime(2026, 1, 1, 12)
    rows = [(at, "claim", 1, "p", "x", "2026-01-01"), (at, "claim", 1, "p", "x", "2026-01-02"), (at, "claim", 2, "p", "x", "2026-01-03")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream.appended(source(), str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    query = stream.registry_states(source()).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["spring"], r["first_seen"], r["last_seen"], r["n"]) for r in spark.table("states").collect()} == {("1", "2026-01-01", "2026-01-02", 2), ("2", "2026-01-03", "2026-01-03", 1)}
