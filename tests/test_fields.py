"""Fields read from tags, classifications, measurement cells and workbooks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from geoloom.functions import measures, minerals, tags
from geoloom.operators import fills
from geoloom.plans.search import publish_order
from geoloom.sources import sheets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def tag_map(**values):
    pairs = [F.lit(x) for k, v in values.items() for x in (k.replace("__", ":"), v)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(
    ("given", "policy", "schedule"),
    [({}, "unknown", None), ({"nudism": "Obligatory"}, "required", None), ({"nudism": "permissive"}, "optional", None), ({"nudism": "no", "clothing_optional": "yes"}, "textile-only", None),
     ({"clothing_optional": "no"}, "textile-only", None), ({"bath__sex": "separated"}, "mixed", "Bathing areas: separated"), ({"bath__sex": ""}, "unknown", None), ({"female": "yes"}, "unknown", tags.SEPARATED)],
)
def test_clothing(spark, given, policy, schedule):
    got = one(spark, tags.parse_clothing(tag_map(**given)))
    assert (got["policy"], got["schedule"]) == (policy, schedule)


@pytest.mark.parametrize(
    ("given", "status"),
    [({}, "unknown"), ({"opening_hours": "24/7"}, "open"), ({"opening_hours": "May-Oct 09:00"}, "seasonal"), ({"opening_hours": "Maybe"}, "open"), ({"seasonal": "summer"}, "seasonal"), ({"opening_hours": "24/7", "disused__natural": "hot_spring"}, "closed")],
)
def test_hours(spark, given, status):
    assert one(spark, tags.parse_hours(tag_map(**given)))["status"] == status


@pytest.mark.parametrize(
    ("given", "kind"),
    [({}, "unknown"), ({"amenity": "public_bath", "name": "Grand Hotel"}, "resort"), ({"bath__type": "onsen"}, "developed"), ({"natural": "hot_spring"}, "wild"), ({"natural": "hot_spring", "website": "x"}, "natural"),
     ({"natural": "hot_spring", "operator": "x"}, "developed"), ({"natural": "hot_spring", "fee": "yes"}, "developed"), ({"tourism": "hotel"}, "unknown")],
)
def test_kind(spark, given, kind):
    assert one(spark, tags.parse_kind(tag_map(**given))) == kind


def test_labels_and_warnings(spark):
    given = tag_map(bath__type="Foot Bath", outdoor="yes", note="smells of Sulphur", natural="Geyser", hazard="steam", drinking_water="no", access="permissive")
    assert one(spark, tags.derive_tags(given, F.lit(40.0))) == ["foot-bath", "open-air", "soakable", "sulfur"]
    assert one(spark, tags.derive_tags(tag_map(), F.lit(None).cast("double"))) == []
    assert one(spark, tags.derive_warnings(given, F.lit(50.0), F.lit("wild"))) == [tags.SCALDING, tags.UNDEVELOPED, tags.PERMISSIVE, "Mapped hazard: steam.", tags.GEYSER, tags.NO_DRINKING]
    kept = F.array(F.lit("slippery"), F.lit(tags.SCALDING))
    assert one(spark, tags.reconciled_warnings(kept, F.lit(44.0))) == [tags.VERY_HOT, "slippery"]
    assert one(spark, tags.reconciled_warnings(kept, F.lit(None).cast("double"))) == ["slippery"]
    assert one(spark, tags.temperature_warnings(F.lit(float("nan")))) == []


@pytest.mark.parametrize(
    ("value", "types"),
    [("単純硫黄冷鉱泉", ["sulfur"]), ("Na-Cl・HCO3泉", ["chloride", "bicarbonate"]), ("含Fe(II)-Na-Cl", ["chloride", "iron"]), ("単純温泉", ["simple"]), ("酸性・含硫黄-アルミニウム-硫酸塩温泉", ["sulfate", "acidic", "sulfur", "aluminium"]),
     ("ナトリウム-炭酸水素塩泉", ["bicarbonate"]), ("謎の温泉", None), ("N/A", []), ("", []), (None, []), ("　含I-食塩泉 ", ["chloride", "iodine"])],
)
def test_classification(spark, value, types):
    assert one(spark, minerals.mineral_types(F.lit(value).cast("string"))) == types


def test_classification_outcome(spark):
    schema = "id int, values array<string>, upstream array<string>, claim array<string>"
    rows = [(0, ["硫黄泉"], [], None), (1, ["硫黄泉", "食塩泉"], [], None), (2, ["硫黄泉"], ["iron"], None), (3, ["謎泉"], [], None), (4, ["酸性泉"], [], ["sulfur"]), (5, ["酸性泉"], [], ["acidic", "simple"]), (6, [], [], None), (7, ["温泉"], None, None)]
    got = spark.createDataFrame(rows, schema).select("id", minerals.classification_outcome(F.col("values"), F.col("upstream"), F.col("claim")).alias("o")).collect()
    assert {r["id"]: tuple(r["o"]) for r in got} == {
        0: (["sulfur"], None, None), 1: (None, None, "wells disagree on 泉質"), 2: (None, None, None), 3: (None, None, '泉質 not fully understood: "謎"'),
        4: (None, ["acidic"], None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None),
    }


def test_measures(spark):
    for x, known in ((-9999.0, None), (float("nan"), None), (float("inf"), None), (0.0, 0.0), (-5.5, -5.5), (None, None)):
        assert one(spark, measures.known_number(F.lit(x).cast("double"))) == known
    for ms, year in ((0.0, None), (-2208988800000.0, None), (-1.0, "1969"), (1.5e12, "2017"), (-9999.0, None), (9e15, None), (5e12, None), (None, None)):
        assert one(spark, measures.year_of_millis(F.lit(ms).cast("double"))) == year
    for raw, year in (("1998-05", "1998"), ("c. 1750", None), ("N/A", None), ("98", None), (None, None)):
        assert one(spark, measures.sampled_year(F.lit(raw).cast("string"))) == year
    for raw, found in ((" mg/L ", "mg/l"), ("mg/ℓ", "mg/l"), ("MG/KG", "mg/kg"), ("ppm", None)):
        assert one(spark, measures.unit(F.lit(raw))) == found
    refs = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, measures.accuracy_m(refs(), refs("a", "cat"), "cat")) == 500
    assert one(spark, measures.accuracy_m(refs("node/1"), refs("cat"), "cat")) is None


@pytest.mark.parametrize(
    ("wkt", "centre"),
    [("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", (2, 1)), ("polygon((10 10,13 10,10 13,10 10))", (11, 11)), ("POLYGON((1 1, 3 3, 1 1))", (2, 2)), ("POLYGON((1 1, 2 2))", None), ("POINT(1 2)", None), ("", None), (None, None)],
)
def test_centroid(spark, wkt, centre):
    got = one(spark, measures.ring_centroid(F.lit(wkt).cast("string")))
    assert (got and tuple(got)) == (None if centre is None else pytest.approx(centre))


def test_workbook(spark, tmp_path):
    strings = ["NV", "SPRING 1 (RENO)", " A &amp; B ", "null", "H"]
    rows = [
        '<c r="A1" t="s"><v>0</v></c><c r="B1"><v>39.1</v></c><c r="C1"><v>-119.2</v></c><c r="D1" t="s"><v>1</v></c><c r="E1" s="1"/><c r="F1"><v>120</v></c><c r="G1"><v>49</v></c><c r="H1"><v>7</v></c>',
        '<c r="A2" t="s"><v>0</v></c><c r="B2"><v>39.1</v></c><c r="C2"><v>-119.2</v></c><c r="D2" t="s"><v>2</v></c><c r="E2"><v>12</v></c><c r="F2" t="s"><v>4</v></c><c r="G2" t="s"><v>4</v></c>',
        '<c r="A3" t="s"><v>0</v></c><c r="B3"><v>39.1</v></c><c r="C3"><v>-119.2</v></c><c r="D3" t="s"><v>1</v></c><c r="E3" t="s"><v>3</v></c><c r="F3" t="s"><v>3</v></c>',
        '<c r="A4"><v>5</v></c>',
        "",
    ]
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", "<sst xmlns='x'>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        body = "".join(f'<row r="{i}">{r}</row>' for i, r in enumerate(rows, 1))
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='x'><sheetData>{body}</sheetData></worksheet>")
    got = sheets.workbook_rows(spark, str(tmp_path)).select("row", "cells", sheets.reading_of_row(F.col("cells")).alias("r")).orderBy("row").collect()
    assert [r["row"] for r in got] == [1, 2, 3, 4]
    assert [r["r"] and (r["r"]["name"], r["r"]["tf"], r["r"]["tc"]) for r in got] == [("SPRING 1 (RENO)", "120", "49"), ("A & B 12", "H", "H"), ("SPRING 1 (RENO)", "null", "null"), None]


def test_publish_order(spark):
    rows = [("b", "Z"), ("a", None), ("a", "zoo"), ("a", "Éclair"), ("a", "eagle"), (None, "x"), ("a", "")]
    got = publish_order(spark.createDataFrame(rows, "country string, name string")).collect()
    assert [tuple(r) for r in got][:4] == [(None, "x"), ("a", "eagle"), ("a", "Éclair"), ("a", "zoo")]
    assert {r["name"] for r in got[4:6]} == {None, ""} and got[6]["country"] == "b"


def test_classes_are_read_once_a_row(spark):
    """A filled panel names the outcome of its classes several times; the words must be looked for once."""
    k = F.col("id")
    panel = spark.range(4).select("id", F.lit(1.0).alias("p_ph"), F.lit("mg/l").alias("p_unit"), F.lit("2000").alias("p_year"), F.array(F.concat(F.lit("硫黄泉"), k.cast("string"))).alias("p_classes"))
    records = spark.range(4).select("id", F.lit(None).cast("double").alias("ph"), F.lit(None).cast("array<string>").alias("types"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("measured_at"))
    held = spark.range(1).select("id", F.array(F.lit("ph")).alias("held"), F.lit(None).cast("array<string>").alias("held_types"))
    filled = fills.fill_panel(records, panel, held, ("ph",))
    # one for the words, one inside it for the noise
    assert filled._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
