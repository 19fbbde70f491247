"""Matchers, admission, claims and lists on small inputs, against stated answers."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import display
from geoloom.operators import admission, claims, lists, matching, spatial

READING = "station string, ord int, name string, lat double, lng double, celsius double, measured_at string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "said"),
    [
        ("秩父満願の湯", "秩父温泉 満願の湯", "exact"), ("天然温泉 平和島", "平和島温泉", None), ("Blue Lagoon", "blue lagoon 温泉", "exact"), ("abcd", "abcdef", "substring"),
        ("abc", "abcdef", None), (None, "abc", None), ("温泉", "温泉", None), ("abcd", "bcde", None),
    ],
)
def test_name_agreement(spark, a, b, said):
    assert one(spark, matching.name_agreement(F.lit(a).cast("string"), F.lit(b).cast("string"))) == said


def test_stations(spark):
    rows = [("a", 1, None, 1.0, 1.0, 40.0, "2001"), ("a", 0, "first", 1.0, 1.0, 41.0, None), ("a", 2, "x", 1.0, 1.0, 42.0, "2001"), ("a", 3, "x", 1.0, 1.0, 101.0, "2009"),
            ("", 4, "x", 1.0, 1.0, 40.0, None), (None, 5, "x", 1.0, 1.0, 40.0, None), ("b", 6, "x", None, 1.0, 40.0, None), ("b", 7, "x", 1.0, 1.0, float("nan"), None)]
    found = matching.group_stations(spark.createDataFrame(rows, READING)).collect()
    assert [tuple(r) for r in found] == [("a", "first", 1.0, 1.0, 3, 40.0, 42.0, 40.0, "2001")]


def test_station_contention(spark):
    degree = 1 / 111_195
    rows = [("lone", 0, "", 0.0, 0.0, 40.0, None), ("near", 1, "", 1.0, 0.0, 40.0, None), ("near2", 2, "", 1.0 + 50 * degree, 0.0, 41.0, None),
            ("shared", 3, "", 2.0, 0.0, 40.0, None), ("apart", 4, "", 3.0, 0.0, 40.0, None), ("apart", 5, "", 3.0, 0.0, 43.0, None)]
    springs = [(1, 100 * degree, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, 2.0, 0.0), (5, 3.0, 0.0), (6, 9.0, 0.0)]
    found = matching.match_stations(spark.createDataFrame(springs, "id long, lat double, lng double"), spark.createDataFrame(rows, READING))
    said = {r["id"]: (r["station"], r["metres"], r["celsius"], r["reason"]) for r in found.collect()}
    assert said == {
        1: ("lone", 100, 40.0, None), 2: (None, None, None, "2 stations within 200 m"), 3: (None, None, None, "station shared is within 200 m of 2 springs"),
        4: (None, None, None, "station shared is within 200 m of 2 springs"), 5: (None, None, None, "station readings span 3.0 C"),
    }
    assert matching.match_stations(springs := spark.createDataFrame([], "id long, lat double, lng double"), spark.createDataFrame([], READING)).count() == springs.count() == 0


def test_one_place_holds_most(spark):
    """4,000 springs and 4,000 stations at one spot are one pair of the join."""
    springs = spark.range(4000).select("id", F.lit(5.0).alias("lat"), F.lit(5.0).alias("lng"))
    n = F.col("id").cast("string")
    readings = springs.select(n.alias("station"), F.col("id").alias("ord"), n.alias("name"), "lat", "lng", F.lit(40.0).alias("celsius"), F.lit(None).cast("string").alias("measured_at"))
    found = matching.match_stations(springs, readings)
    assert {tuple(r) for r in found.groupBy("reason").count().collect()} == {("4000 stations within 200 m", 4000)}


def test_groups_refuse_both_ways(spark):
    wells = [(1, "Alpha", None, 0.0, 0.0), (2, "Alpha", None, 0.0, 0.001), (3, "Gamma", None, 1.0, 0.0), (4, None, "Gamma", 1.0, 0.0), (5, "Delta", None, 2.0, 0.0), (6, "Other", "Kappa", 3.0, 0.0)]
    records = [(1, "alpha", 0.0, 0.0), (3, "gamma", 1.0, 0.0), (5, "delta", 2.0, 0.0), (6, "Delta", 2.0, 0.0005), (7, "kappa", 3.0, 0.0), (8, None, 3.0, 0.0)]
    found = matching.match_groups(spark.createDataFrame(wells, "ser int, onsen string, source string, lat double, lng double"), spark.createDataFrame(records, "id long, name string, lat double, lng double"))
    several, contested = "one group, several springs", "several groups, one spring"
    assert {tuple(r) for r in found.collect()} == {
        ("Alpha", 1, 0, "exact", None), ("Gamma", 3, 0, "exact", contested), ("__ser:4", 3, 0, "exact", contested), ("Delta", None, None, None, several), ("Other", 7, 0, "exact", None)
    }


def test_admission(spark):
    rows = [(1, "Soda Dam Mudpots", 40.123, -110.123), (2, "Mud Volcano Hot Springs", 40.123, -110.123), (3, "Hot Springs (hot)", 40.123, -110.123), (4, None, 40.123, -110.123),
            (5, "Good Spring", 40.12, -110.123), (6, "Good Spring", 40.123, -110.123), (7, "Good Spring", 44.0, -110.123), (8, "Good Spring", 50.123, -110.123)]
    boxes = spark.createDataFrame([(-111.0, 50.0, -110.0, 51.0, False), (-111.0, 40.0, -110.0, 41.0, True)], "west double, south double, east double, north double, bathing boolean")
    judged = admission.admit(spark.createDataFrame(rows, "id int, name string, lat double, lng double"), boxes)
    coarse, generic = "coordinates coarser than 3 dp", "generic or absent name"
    assert {r["id"]: r["reason"] for r in judged.collect()} == {1: "view-only feature", 2: None, 3: generic, 4: generic, 5: coarse, 6: None, 7: coarse, 8: "inside a no-bathing boundary"}
    admitted, refused = admission.quarantine(judged)
    assert (admitted.count(), refused.count()) == (2, 6)
    assert [tuple(r) for r in admission.reject_counts(judged, most=1).collect()] == [(coarse, 2)]
    with pytest.raises(Exception, match="nothing is written"):
        admission.refuse(judged, F.col("id") < 8, "nothing is written").collect()


def test_catalogue_and_new_pins(spark):
    lines = ["# note", "", "state\tlat\tlng\tname\tf\tc", "CA\t40.5\t-120\tBlue\t212\t100", "CA\t41\t-120\t\t\tB", "CA\tx\t-120\tBad\t1\t1", "CA\t40\t-120\tOff\t100\t100", "CA\t40\t-120\tNone\t1\tn/a"]
    read = admission.read_catalogue(spark.createDataFrame([(x,) for x in lines], "value string"))
    said = [(r["lat"], r["name"], r["celsius"], r["qualitative"], r["reason"]) for r in read.collect()]
    assert said == [(40.5, "Blue", 100.0, None, None), (41.0, None, None, "boiling", None), (None, "Bad", None, None, "unparseable coordinate"),
                    (40.0, "Off", None, None, "Fahrenheit and Celsius disagree: 100F vs 100C"), (40.0, "None", None, None, "no usable temperature")]
    records = spark.createDataFrame([(["ncei"], ["CA/41/-120"]), (["osm", "ncei"], ["CA/40.5/-120"])], "provenance array<string>, refs array<string>")
    pins = admission.new_pins(read.where("reason is null"), records)
    assert {r["lat"]: r["became_pin"] for r in pins.collect()} == {40.5: False, 41.0: True}


@pytest.mark.parametrize(("name", "more", "held"), [("C-12", {}, True), ("１２", {}, True), ("12c", {"ele": "3"}, False), ("12", {"addr:city": ""}, False), ("12", {"note": ""}, True), ("Blue 12", {}, False)])
def test_suspected_borehole(spark, name, more, held):
    tags = F.create_map(*[F.lit(x) for pair in ({"natural": "hot_spring", "name": name} | more).items() for x in pair])
    assert (one(spark, admission.suspected_borehole(tags)) is not None) == held


def test_country_fallback(spark):
    edges = [("A", 1, 0, *s, 0.0, 0.0, 1.0, 1.0) for s in [(0.0, 0.0, 0.0, 1.0), (0.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 0.0), (1.0, 0.0, 0.0, 0.0)]]
    shapes = spark.createDataFrame(edges, "poly string, ord int, ring int, lat1 double, lng1 double, lat2 double, lng2 double, west double, south double, east double, north double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.4, 0.5), (3, 1.5, 0.5), (4, 1.4, 1.4), (5, 1.2, -0.2)], "id int, lat double, lng double")
    found = {r["id"]: (r["poly"], r["exact"]) for r in spatial.country_of(points, shapes, "id").collect()}
    assert found == {1: ("A", True), 2: ("A", False), 3: ("XX", False), 4: ("XX", False), 5: ("A", False)}


def test_claims(spark):
    made = [(1, "minerals.ph", "7.4", "u1", "active"), (1, "minerals.tds", "9", "u1", None), (2, "minerals.ph", "7", "u2", None), (3, "minerals.ph", "7", "gone", None), (4, "access.price", "5", "u1", None), (5, "minerals.ph", "7", "u1", "retracted"), (6, "minerals.ph", "7", "u3", None)]
    pages = [("u1", "ok", "the pH is 7,4 here"), ("u2", "not-found", None), ("u3", "source-too-large", None)]
    results = claims.verify(spark.createDataFrame(made, "id int, field string, value string, source string, state string"), spark.createDataFrame(pages, "url string, outcome string, body string"))
    assert {(r["id"], r["field"]): r["verdict"] for r in results.collect()} == {
        (1, "minerals.ph"): "verified", (1, "minerals.tds"): "refuted", (2, "minerals.ph"): "refuted", (3, "minerals.ph"): "unreachable", (4, "access.price"): "needs-semantic-review", (6, "minerals.ph"): "unreachable"
    }
    assert claims.summary(results).first()["code"] == 1
    assert claims.summary(results.where("verdict <> 'refuted'")).first()["code"] == 2
    assert claims.summary(results.where("1 = 0")).first()["code"] == 0


@pytest.mark.parametrize(
    ("note", "left"),
    [(None, ""), ("see [this](http://x.y) and <b>that</b>", "see this and that"), ("rated 5 < 7 and 9 > 2", "rated 5 7 and 9 2"), ("C#12 is fine, me@evil.com @you #tag", "C#12 is fine, me@evil.com"), ("go http://a.b/c now\nplease", "go now please"), ("x" * 300, "x" * 280)],
)
def test_strip_note(spark, note, left):
    assert one(spark, claims.strip_note(F.lit(note).cast("string"))) == left


def test_excerpts_and_queries(spark):
    text = "a" * 50 + "42,5" + "b" * 50
    assert one(spark, claims.source_excerpt(F.lit(text), F.lit("42.5"), 20)) == "a" * 10 + "42,5" + "b" * 6
    assert one(spark, claims.source_excerpt(F.lit(text), F.lit("none"), 20)) == "a" * 20
    assert one(spark, claims.search_query(F.lit(" --hot  -springs 38-40 "))) == "hot springs 38-40"
    assert one(spark, claims.search_query(F.lit(" - "))) is None


def test_lists(spark):
    rules = [("a", "listed", ["C1"], "why", None, None, None, None, None, ["x", "x"], None), ("b", "name-pattern", [], "", 1.0, 0.0, 0.0, 1.0, None, ["y"], []), ("c", "attribute-free", ["C1"], "why", None, None, None, None, None, None, ["z"])]
    frame = spark.createDataFrame(rules, "id string, rule string, countries array<string>, reason string, west double, south double, east double, north double, pattern string, ids array<string>, except array<string>")
    found = {r["id"]: r["errors"] for r in lists.rule_faults(frame).collect()}
    assert found == {"a": "repeats an id", "b": "no countries; no reason; box has its minimum above its maximum; needs a pattern; has ids its rule ignores; empty exceptions"}
    assert {tuple(r) for r in lists.unmatched_ids(frame, spark.createDataFrame([("x",)], "id string")).collect()} == {("b", "y"), ("c", "z")}
    counts = [("i", "JP", "p", "t", "https://x", "2020", "2021", 3.0, "springs", "sites", "a count of ours", True), ("j", "jp", "p", "t", "http://x", "2020", "2021", 0.5, "springs", "other", "differs", True)]
    faults = lists.inventory_faults(spark.createDataFrame(counts, "id string, country string, publisher string, title string, url string, as_of string, reviewed string, count double, unit string, compares string, caveat string, ours boolean"))
    assert [r["id"] for r in faults.collect()] == ["j"]


def test_words(spark):
    said = [r[0] for r in spark.range(0, 101).select(display.number_words(F.col("id"))).collect()]
    assert (said[0], said[1], said[19], said[20], said[21], said[99], said[100]) == (None, "one", "nineteen", "twenty", "twenty-one", "ninety-nine", None)
    assert one(spark, display.springs_in_words(F.lit(0.81))) == "Four springs in five"
    assert one(spark, display.springs_in_words(F.lit(0.1))) == "One spring in ten"
