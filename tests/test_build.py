"""The build end to end on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from geoloom.operators import registry
from geoloom.plans import build as plan

TODAY = "2026-03-01"


def mint(ref):
    return "whs_" + hashlib.sha256(ref.encode()).hexdigest()[:12]


def square(poly, order, name, w, s, e, n):
    corners = [(s, w), (s, e), (n, e), (n, w), (s, w)]
    return [(poly, order, name, 0, *a, *b, w, s, e, n) for a, b in zip(corners, corners[1:], strict=False)]


@pytest.fixture(scope="module")
def inputs(spark):
    elements = [
        ("node", 1, 40.1234567, -115.5, {"natural": "hot_spring", "name": "Alpha Hot Spring", "temperature": "42 C", "fee": "no"}),
        ("way", 2, 40.1235, -115.5001, {"natural": "hot_spring", "name": "Alpha Hot Spring", "opening_hours": "24/7", "description": "deep"}),
        ("node", 3, 41.0, -115.0, {"natural": "hot_spring", "name": "Beta Spring"}),
        ("node", 4, 41.5, -115.0, {"natural": "hot_spring", "name": "C-12"}),
        ("node", 5, 42.0, -115.0, {"natural": "hot_spring", "access": "private"}),
        ("node", 6, None, None, {"natural": "hot_spring"}),
        ("node", 7, 42.5, -115.0, {"natural": "hot_spring", "name": "Secret Spring"}),
        ("node", 8, 43.0, -115.0, {"natural": "hot_spring", "name": "Park Spring", "temperature": "50"}),
        ("node", 9, 43.5, -115.0, {"natural": "hot_spring", "name": "Bad Import 7", "website": "http://x"}),
    ]
    lines = ["state\tlat\tlng\tname\tf\tc", "NV\t41.0005\t-115.0005\tBETA SPRINGS\t104\t40", "NV\t44.1234\t-116.5678\tLONELY SPRING\t113\t45", "NV\t45.1\t-116.5\tCOARSE SPRING\t113\t45", "NV\t44.9999\t-116.0001\tOLD GEYSER\t200\t93.3", "NV\tx\t-116\tBROKEN\t1\t1"]
    frame = spark.createDataFrame
    old = [("whs_00000000000a", 0, ["osm:node/3"], 41.0, -115.0, "Beta", "2025-01-01", "2025-12-01", None, None), ("whs_00000000000b", 1, ["osm:node/99"], 10.0, 10.0, "Gone", "2025-01-01", "2025-12-01", None, None)]
    claims = [("whs_00000000000a", "access.price", '"7 USD"'), (mint("node/1"), "temperature.celsius", "44.5"), (mint("node/7"), "description", '"hidden"')]
    return plan.Inputs(
        elements=frame(elements, "type string, id long, lat double, lng double, tags map<string,string>"),
        edges=frame(square("US", 1, "United States of America", -120.0, 38.0, -110.0, 50.0), "poly string, ord int, name string, ring int, lat1 double, lng1 double, lat2 double, lng2 double, west double, south double, east double, north double"),
        bad_rules=frame([("imports", 1, "US", None, None, None, None, "(?i)bad import", None)], "rule string, ord int, country string, west double, south double, east double, north double, pattern string, except array<long>"),
        catalogue=frame([(x,) for x in lines], "value string").coalesce(1),
        boxes=frame([("park", 1, "closed", False, "No bathing here", -115.1, 42.9, -114.9, 43.1)], "manager string, ord int, status string, bathing boolean, warning string, west double, south double, east double, north double"),
        overlays=frame([(*c, "https://a.museum/x", "ann", "active", None) for c in claims], "id string, field string, value string, source string, contributor string, state string, measuredAt string"),
        exclusions=frame([(None, 42.5, -115.0, None)], "ref string, ex_lat double, ex_lng double, pattern string"),
        registry=frame(old, "spring string, entry long, refs array<string>, lat double, lng double, name string, first_seen string, last_seen string, missing_since string, merged_into string"),
        history=frame([("whs_00000000000a", "spring.appeared", None, "2025-01-01")], "spring string, type string, to string, ts string"),
        today=TODAY,
    )


def test_build_and_publish(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    plan.publish(plan.build(spark, inputs), out)
    got = {name: spark.read.parquet(path) for name, path in plan.published(spark, out).items()}
    records = {r["id"]: r for r in got["records"].collect()}
    alpha, beta, lonely, park = mint("node/1"), "whs_00000000000a", mint("ncei:NV/44.1234/-116.5678"), mint("node/8")
    assert set(records) == {alpha, beta, lonely, park}
    a = records[alpha]
    assert (a["temperature"]["celsius"], a["temperature"]["fahrenheit"], a["access"]["price"], a["hours"]["open"], a["description"]) == (44.5, 112.1, "Free", "24/7", "deep")
    assert set(a["refs"]) == {"osm:node/1", "osm:way/2"} and "https://www.openstreetmap.org/way/2" in a["sources"] and a["quality"]["curated"] and a["location"]["lat"] == 40.123457
    b = records[beta]
    assert (b["temperature"]["celsius"], b["temperature"]["measuredAt"], b["quality"]["provenance"], b["access"]["price"]) == (40.0, "1981", ["ncei", "osm"], "7 USD")
    assert (records[lonely]["name"], records[lonely]["temperature"]["celsius"], records[lonely]["location"]["country"]) == ("LONELY SPRING", 45.0, "US")
    p = records[park]
    assert (p["access"]["status"], p["access"]["bathingAllowed"], p["warnings"][-1]) == ("closed", False, "No bathing here")
    assert {(r["id"], r["reason"].split(" (")[0]) for r in got["suspects"].collect()} == {(4, "identifier-style name"), (9, "rule imports")}
    assert {r["reason"] for r in got["candidates"].collect()} == {"unparseable coordinate", "coordinates coarser than 3 dp", "view-only feature"}
    assert {(r["outcome"], r["id"]) for r in got["match_report"].collect()} == {("matched", beta), ("became a record", None), ("unmatched", None)}
    assert {(r["reason"], r["n"]) for r in got["rejects"].collect()} == {("no geometry", 1), ("access=private/no", 1)}
    state = {r["spring"]: r for r in got["registry"].collect()}
    assert state["whs_00000000000b"]["missing_since"] == TODAY and state[beta]["last_seen"] == TODAY and mint("node/7") in state
    told = {(r["spring"], r["type"]) for r in got["events"].collect()}
    assert told == {(beta, "spring.appeared"), (alpha, "spring.appeared"), (lonely, "spring.appeared"), (park, "spring.appeared"), (mint("node/7"), "spring.appeared"), ("whs_00000000000b", "spring.disappeared"), (alpha, "claim.contested")}
    assert [r["id"] for r in got["suppressed"].collect()] == [mint("node/7")]
    doc = json.loads(got["summary"].first()["value"])
    assert (doc["total"], doc["sites"], doc["coverage"]["temperature"], doc["byCountry"]) == (4, 4, 4, {"United States of America": 4})
    # the same state again: nothing new happens
    again = plan.Inputs(**{**inputs.__dict__, "registry": got["registry"], "history": got["events"], "today": "2026-03-02"})
    second = plan.build(spark, again)
    assert second["events"].count() == got["events"].count()
    aliases = registry.current_ids(spark.createDataFrame([("whs_00000000000b", beta)], "old string, new string"))
    assert plan.detail(got["records"], "whs_00000000000b", aliases).first()["id"] == beta
    assert plan.detail(got["records"], alpha).count() == 1


def test_a_failing_invariant_publishes_nothing(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    name = plan.publish({"records": spark.range(1), "summary": spark.range(1)}, out)
    bad = {"records": spark.range(3), "summary": spark.range(2).select(F.raise_error(F.lit("broken")).alias("x"))}
    with pytest.raises(Exception, match="broken"):
        plan.publish(bad, out)
    assert plan.published(spark, out)["records"] == f"{out}/{name}/records"
    wrong = inputs.overlays.withColumn("value", F.lit("1"))
    with pytest.raises(ValueError, match="access.price: value must be a string|description"):
        plan.build(spark, plan.Inputs(**{**inputs.__dict__, "overlays": wrong}))
    lost = inputs.overlays.withColumn("id", F.lit("whs_999999999999"))
    with pytest.raises(ValueError, match="belongs to no spring|claimed twice"):
        plan.build(spark, plan.Inputs(**{**inputs.__dict__, "overlays": lost}))
