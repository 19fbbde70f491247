"""Files with corrupt lines, changed columns and duplicate ids, and small functions that only files reach."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from geoloom.functions import display, parse
from geoloom.operators import admission, lists, matching, summary
from geoloom.sources import readers, writers
from geoloom.streaming import events as stream


def test_a_corrupt_line_fails_with_its_number(spark, tmp_path):
    """Also in the third split of a file; where the log is a hint it is skipped."""
    lines = [json.dumps({"ts": f"t{i}", "type": "claim", "springId": f"s{i}", "to": "x" * 50}) for i in range(3000)]
    lines[17] = ""
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.jsonl").write_text("\n".join(lines) + "\n")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        assert spark.read.text(str(good)).rdd.getNumPartitions() >= 4
        assert readers.events(spark, str(good)).count() == 2999
        numbers = readers.numbered_lines(spark, str(good)).where("value like '%\"s2345\"%' or value like '%\"s0\"%'").select("line").collect()
        assert sorted(r["line"] for r in numbers) == [1, 2346]
        lines[2500] = '{"ts": "t'
        lines[2700] = "no json"
        (good / "b.jsonl").write_text("\n".join(lines))
        with pytest.raises(ValueError, match="b.jsonl line 2501 is not valid JSON"):
            readers.events(spark, str(good))
        assert readers.events(spark, str(good), strict=False).count() == 2999 + 2997
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_overlay_files(spark, tmp_path):
    one = {"id": "whs_000000000001", "claims": {"temperature.celsius": {"value": 40.5, "source": "https://a.museum", "contributor": "ann", "state": "active"}, "tags": {"value": ["a", "b"], "source": "https://a.museum", "contributor": "ann"}}}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps(one | {"id": "whs_000000000002", "claims": {"name": {"value": "5"}}}))
    rows = {(r["id"][-1], r["field"]): (r["at"], json.loads(r["value"])) for r in readers.overlay_claims(spark, str(tmp_path)).collect()}
    assert rows == {("1", "temperature.celsius"): (0, 40.5), ("1", "tags"): (1, ["a", "b"]), ("2", "name"): (0, "5")}
    (tmp_path / "c.json").write_text(json.dumps(one))
    with pytest.raises(ValueError, match="c.json declares id whs_000000000001, which .*a.json already claims"):
        readers.overlay_claims(spark, str(tmp_path))


def test_columns_by_header(spark, tmp_path):
    """Two files, columns swapped and one missing, a quoted line end: the same rows."""
    stations = tmp_path / "stations"
    stations.mkdir()
    (stations / "a.csv").write_text('MonitoringLocationIdentifier,MonitoringLocationName,LatitudeMeasure,LongitudeMeasure,Other\nS1,"Hot, ""big""\nwell",40.5,-110.25,x\nS2,No place,,oops,x\n,None,1,1,x\n')
    (stations / "b.csv").write_text("Other,LongitudeMeasure,LatitudeMeasure,MonitoringLocationIdentifier\ny,-111,41, S3 \n")
    got = {r["station"]: (r["name"], r["lat"], r["lng"]) for r in readers.stations(spark, str(stations)).collect()}
    assert got == {"S1": ('Hot, "big"\nwell', 40.5, -110.25), "S3": ("", 41.0, -111.0)}
    results = tmp_path / "results"
    results.mkdir()
    (results / "a.csv").write_text("ResultMeasureValue,ResultMeasure/MeasureUnitCode,MonitoringLocationIdentifier,ActivityStartDate\n104,deg F,S1,2020-01-02\n40,K,S1,2020\nnone,deg C,S1,2020\n41.5,deg C,S9,2020\n")
    (results / "b.csv").write_text("MonitoringLocationIdentifier,ResultMeasure/MeasureUnitCode,ResultMeasureValue,ActivityStartDate\nS3, C ,55.25,2021\n")
    joined = matching.join_readings(readers.stations(spark, str(stations)), readers.results(spark, str(results)))
    assert sorted((r["station"], r["celsius"], r["measured_at"]) for r in joined.collect()) == [("S1", 40.0, "2020-01-02"), ("S3", 55.25, "2021")]


def test_analyses_by_place(spark, tmp_path):
    def row(**own):
        cells = [""] * 82
        for i, v in {"0": "7", "3": "Yu", "7": "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "8": "1987/05", "11": "42.5", "14": "N/A", "70": "mg/L", "73": "simple", **{k[1:]: v for k, v in own.items()}}.items():
            cells[int(i)] = v
        return '"' + '","'.join(cells) + '"'

    (tmp_path / "a.csv").write_text("\n".join([",".join(f"h{i}" for i in range(82)), row(), row(_7="POINT (1 1)"), "1,2,3", row(_11="hot", _4="spring")]) + "\n")
    rows, rejected = readers.analyses(spark, str(tmp_path))
    got = [(r["ser"], r["onsenName"], r["sourceName"], r["lat"], r["lng"], r["measuredAt"], r["celsius"], r["ph"], r["unit"], r["senshitsu"]) for r in rows.orderBy("celsius").collect()]
    assert got == [("7", "Yu", "spring", 1.0, 1.0, "1987", None, None, "mg/l", "simple"), ("7", "Yu", None, 1.0, 1.0, "1987", 42.5, None, "mg/l", "simple")]
    assert sorted(r["reason"] for r in rejected.collect()) == ["short row", "unparseable geometry"]


def test_registry_and_exclusion_files(spark, tmp_path):
    entries = {"whs_b": {"osmRefs": ["node/2", "way/1"], "centroid": [10.5, 60.0], "name": None, "firstSeen": "2025-01-01", "lastSeen": "2025-01-02", "missingSince": None}, "whs_a": {"osmRefs": [], "sourceRefs": [{"provider": "ncei", "externalId": "CA/1"}], "centroid": [1, 2], "name": "A", "mergedInto": "whs_b"}}
    (tmp_path / "registry.json").write_text(json.dumps(entries))
    got = [(r["spring"], r["entry"], r["refs"], r["lat"], r["lng"], r["merged_into"]) for r in readers.registry(spark, str(tmp_path / "registry.json")).orderBy("entry").collect()]
    assert got == [("whs_b", 0, ["osm:node/2", "osm:way/1"], 60.0, 10.5, None), ("whs_a", 1, ["ncei:CA/1"], 2.0, 1.0, "whs_b")]
    path = str(tmp_path / "exclusions.json")
    assert readers.exclusions(spark, path).count() == 0
    (tmp_path / "exclusions.json").write_text(json.dumps({"entries": [{"osmId": "node/7"}, {"lat": 1, "lng": 2, "radiusMeters": 50}, {"namePattern": "x"}]}))
    assert sorted((r["ref"] or "", r["ex_radius"] or 0, r["pattern"] or "") for r in readers.exclusions(spark, path).collect()) == [("", 0, "x"), ("", 50.0, ""), ("node/7", 0, "")]
    (tmp_path / "exclusions.json").write_text('{"entries": [')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.exclusions(spark, path).collect()


def test_features_and_quoted_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"id": 2, "name": "b"}}, {"properties": {"id": 1, "name": None}}]}))
    assert [tuple(r) for r in readers.geojson(spark, str(tmp_path / "f.json"), "id: long, name: string", order="id").collect()] == [(1, None), (2, "b")]
    (tmp_path / "q.csv").write_text('a,b\n"x ""y"", z","two\nlines"\n')
    assert tuple(readers.quoted_csv(spark, str(tmp_path / "q.csv"), "a string, b string").first()) == ('x "y", z', "two\nlines")


def test_small_functions(spark):
    rows = spark.createDataFrame([(1, "sha", "r"), (2, "sha", "q"), (3, "other", "r"), (4, "other", "r")], "pr int, sha string, repo string")
    assert sorted(r["pr"] for r in admission.sole(rows, ["sha", "repo"]).collect()) == [1, 2]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert [r["id"] for r in lists.suppressed(ids(1, 2, 2, 3), ids(1, 3)).collect()] == [2]
    souths = spark.createDataFrame([(40.0, 0), (10.0, 1), (70.0, 2), (-20.0, 3), (-60.0, 4)], "south double, want int")
    assert all(r["got"] == r["want"] for r in souths.select("want", display.tile_priority(F.col("south"), 10).alias("got")).collect())
    springs = spark.createDataFrame([("a", 50, "2026-01-02"), ("b", 300, "soon"), ("c", 0, None)], "id string, completeness int, verified_on string")
    assert [tuple(r) for r in writers.sitemap_entries(springs, "https://x/").orderBy("loc").collect()] == [("https://x/a", "0.55", "2026-01-02"), ("https://x/b", "0.80", None), ("https://x/c", "0.30", None)]
    values = spark.createDataFrame([(None, -9999.0, 3.0), (float("nan"), 2.0, 3.0)], "a double, b double, c double")
    assert [r["x"] for r in values.select(readers.first_known(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [3.0, 2.0]
    assert readers.panels(spark.createDataFrame([(1, None, 2.0), (2, None, None)], "id int, ph double, iron double"), ["ph", "iron"]).count() == 1


def test_rates_by_window(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1, 12, 0, s)
    spark.createDataFrame([("u", at(1)), ("u", at(8)), ("v", at(9)), ("u", at(31))], "user string, ts timestamp").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    query = stream.rates(source, "user", "20 seconds", "10 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["window"]["start"].minute, r["window"]["start"].second, r["user"]): r["n"] for r in spark.table("rates").collect()}
    assert got == {(59, 50, "u"): 2, (0, 0, "u"): 2, (59, 50, "v"): 1, (0, 0, "v"): 1, (0, 20, "u"): 1, (0, 30, "u"): 1}


def test_summary_document_and_refutations(spark):
    schema = "country string, country_name string, type string, site long, celsius double, price string, hours_open string, policy string"
    rows = [("JP", "Japan", "onsen", 1, 40.0, "Free", None, "unknown"), ("JP", "Japan", "onsen", 1, None, "", "daily", "mixed"), ("US", "States", "pool", 2, 35.0, None, None, "unknown"), ("CA", "Canada", "pool", 2, None, None, None, "unknown")]
    doc = json.loads(summary.document(summary.counts(spark.createDataFrame(rows, schema)), siteLinkMeters=F.lit(500)).first()["value"])
    assert doc == {"total": 4, "sites": 2, "countries": 3, "coverage": {"clothing": 1, "hours": 1, "price": 1, "temperature": 2}, "byType": {"onsen": 2, "pool": 2}, "byCountry": {"Japan": 2, "Canada": 1, "States": 1}, "sitesByCountry": {"Canada": 1, "Japan": 1, "States": 1}, "siteLinkMeters": 500}
    assert list(doc["byCountry"]) == ["Japan", "Canada", "States"]
    plan = summary.counts(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    empty = json.loads(summary.document(summary.counts(spark.createDataFrame([], schema))).first()["value"])
    assert (empty["total"], empty["sites"], empty["countries"], empty["byCountry"]) == (0, 0, 0, {})
    told = "spring string, field string, proposed string, source string, proposer string, verifier string, stage string, outcome string, note string"
    good = spark.createDataFrame([("s", "f", "1", None, "p", None, "verify", "refuted-by-verifier", "see [x](http://a) <b>now</b> @you")], told)
    assert summary.refutations(good, F.lit("t")).first()["note"] == "see x now"
    with pytest.raises(Exception, match="outcome must be one of"):
        summary.refutations(good.withColumn("outcome", F.lit("perhaps")), F.lit("t")).collect()


def test_route_ids_and_addresses(spark):
    for address, private in (("::1", True), ("fe80::1", True), ("fd12:3456::1", True), ("::ffff:10.0.0.1", True), ("2001:4860:4860::8888", False), ("::", True), ("0.1.2.3", True), ("224.0.0.1", True), ("300.1.1.1", True), ("1:2:3", True), ("1::2::3", True), ("8.8.8.8", False), ("ff02::1", False), ("nonsense", True)):
        assert spark.range(1).select(parse.private_address(F.lit(address)).alias("x")).first()["x"] is private, address


def test_a_claim_without_a_field_needs_review(spark):
    from geoloom.operators import claims

    rows = spark.createDataFrame([("a", None, "1", "u", None), ("b", "temperature.celsius", "41", "u", "active")], "id string, field string, value string, source string, state string")
    pages = spark.createDataFrame([("u", "ok", "it is 41 C")], "url string, outcome string, body string")
    assert {(r["id"], r["verdict"]) for r in claims.verify(rows, pages).collect()} == {("a", "needs-semantic-review"), ("b", "verified")}
