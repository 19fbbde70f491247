"""Claims on every field, against the cases that define them."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.operators import fields

CLAIM = "id string, field string, value string, source string, contributor string, state string, measuredAt string"
ID = "whs_a1b2c3d4e5f6"
RECORD = (
    "id string, name string, type string, temperature struct<celsius: double, fahrenheit: double, kind: string, source: string, measuredAt: string>, access struct<price: string, currency: string, notes: string>, "
    "clothing struct<policy: string, schedule: string, notes: string>, hours struct<open: string, seasonalNotes: string, status: string>, description string, tags array<string>, warnings array<string>, "
    "location struct<elevation: double, region: string, nearestTown: string>, minerals struct<ph: double, tds: double, sulfate: double, bicarbonate: double, chloride: double, calcium: double, magnesium: double, "
    "sodium: double, potassium: double, silica: double, iron: double, types: array<string>, notes: string, measuredAt: string, unit: string>, sources array<string>, quality struct<completeness: int, known: array<string>, curated: boolean>"
)


def claims(spark, *rows):
    return spark.createDataFrame([(ID, f, v if v is None else json.dumps(v), "https://springs.museum/p", "ann", state, None) for f, v, state in rows], CLAIM)


def record(spark, **own):
    base = {"id": ID, "name": "Spring", "type": "onsen", "temperature": {"celsius": 40.0, "fahrenheit": 104.0, "kind": "unknown", "source": "map", "measuredAt": "2001"}, "access": {"price": "5 USD"}, "clothing": {"policy": "unknown"},
            "hours": {"status": "unknown"}, "tags": ["a", "b"], "warnings": ["hot"], "location": None, "minerals": None, "sources": ["https://map.museum"], "quality": {"completeness": 0, "known": [], "curated": False}}
    return spark.createDataFrame([base | own], RECORD)


def value_for(field):
    f = fields.FIELDS[field]
    if f.bounds:
        return f.bounds[0] + 50
    return {"number": 7.5, "option": f.options[-1] if f.options else "", "string": "text", "any": "text", "strings": ["new"], "types": ["iron", "acidic"]}[f.kind]


def test_the_table_of_fields():
    assert len(fields.FIELDS) == 34 and "type" not in fields.FIELDS and "location.lat" not in fields.FIELDS
    assert {n for n, f in fields.FIELDS.items() if not f.agent} == {"name", "warnings", "tags", "location.nearestTown"}
    assert {n for n, f in fields.FIELDS.items() if f.risk == "low"} == {"hours.open", "access.price", "access.currency", "description", "tags", "location.region", "location.nearestTown", "location.elevation"}
    assert all(fields.FIELDS[n].risk == "high" for n in ("temperature.celsius", "temperature.fahrenheit", "clothing.policy", "warnings", "minerals.ph", "minerals.types"))


def test_every_field_is_claimable_and_lands(spark):
    wanted = {f: value_for(f) for f in fields.FIELDS if f != "temperature.fahrenheit"}
    rows = claims(spark, *((f, v, None) for f, v in wanted.items()))
    assert fields.errors(rows).count() == 0
    done = fields.apply(record(spark), rows).first().asDict(recursive=True)
    for field, value in wanted.items():
        at = done
        for part in field.split("."):
            at = at[part]
        if fields.FIELDS[field].kind == "strings":
            assert at[-1] == "new" and len(at) > 1
        else:
            assert at == (["iron", "acidic"] if isinstance(value, list) else value), field
    assert done["temperature"]["fahrenheit"] == 113.0 and done["temperature"]["source"] == "Curated claim by ann: https://springs.museum/p" and done["temperature"]["measuredAt"] is None
    assert done["sources"] == ["https://map.museum", "https://springs.museum/p"] and done["quality"]["curated"] is True


def test_claims_that_change_nothing(spark):
    before = record(spark)
    superseded = fields.apply(before, claims(spark, ("temperature.celsius", 50, "superseded"))).first()
    assert superseded["temperature"] == before.first()["temperature"] and superseded["sources"] == ["https://map.museum"] and superseded["location"] is None
    assert superseded["quality"]["completeness"] == 67 and superseded["quality"]["known"] == ["name", "temperature", "price", "type"]
    other = claims(spark, ("name", "x", None)).withColumn("id", F.lit("whs_000000000000"))
    assert fields.apply(before, other).first() == before.first()


def test_fahrenheit_keeps_its_number(spark):
    done = fields.apply(record(spark), claims(spark, ("temperature.fahrenheit", 108, None))).first()["temperature"]
    assert (done["fahrenheit"], done["celsius"]) == (108.0, 42.2)


@pytest.mark.parametrize(
    ("field", "old", "claimed", "contested"),
    [("temperature.celsius", 40.0, 40.5, False), ("temperature.celsius", 40.0, 40.6, True), ("temperature.fahrenheit", 104.0, 104.8, False), ("temperature.fahrenheit", 104.0, 105, True), ("access.price", "5 USD", "6 USD", True),
     ("access.price", "5 USD", "5 USD", False), ("access.notes", None, "x", False), ("tags", None, ["z"], False), ("minerals.ph", None, 7, False)],
)
def test_contests(spark, field, old, claimed, contested):
    found = fields.contests(record(spark), claims(spark, (field, claimed, None))).collect()
    assert bool(found) is contested
    if found:
        assert (json.loads(found[0]["from"]), json.loads(found[0]["to"])) == (old, claimed)


def test_types_contest_as_sets(spark):
    own = record(spark, minerals={"types": ["iron", "acidic"], "ph": 2.0, "tds": 5.0})
    assert fields.contests(own, claims(spark, ("minerals.types", ["acidic", "iron"], None))).count() == 0
    assert fields.contests(own, claims(spark, ("minerals.types", ["acidic"], None))).count() == 1
    assert own.select(fields.needs_unit(F.col("minerals")).alias("x")).first()["x"] is True
    assert record(spark).select(fields.needs_unit(F.col("minerals")).alias("x")).first()["x"] is False


def test_faults_of_whole_records(spark):
    twice = claims(spark, ("description", "x", None), ("description", "y", None))
    assert [r["error"] for r in fields.errors(twice).collect()] == ["description is claimed twice"]
    bad = claims(spark, ("description", None, None)).withColumn("id", F.lit("7"))
    assert sorted(r["error"] for r in fields.errors(bad).collect()) == ["description: value is required", "id must look like whs_a1b2c3d4e5f6, got 7"]
    assert fields.errors(claims(spark, ("temperature.celsius", 40, "retracted"), ("temperature.fahrenheit", 104, None))).count() == 0
    assert fields.errors(claims(spark, ("tags", [], None))).count() == 0
    with pytest.raises(ValueError, match="no such path"):
        fields.with_paths(record(spark), {"temperature.kelvin": F.lit(1)})
