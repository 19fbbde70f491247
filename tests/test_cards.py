"""What cards say, excerpts, sitemap and collection files."""

import json
import xml.etree.ElementTree as xml

import pytest
from pyspark.sql import functions as F

from geoloom.functions import card, parse
from geoloom.operators import claims
from geoloom.plans.search import Filters
from geoloom.sources import writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def number(x):
    return F.lit(x).cast("double")


def test_formatters(spark):
    cases = [
        (card.temperature(number(40.0), number(104.0), "c"), "40°C"), (card.temperature(number(40.5), number(None), "f"), "104.9°F"), (card.temperature(number(None), number(None), "c"), "Unknown"),
        (card.whole_degrees(number(37.5), "c"), "38°C"), (card.whole_degrees(number(-0.5), "c", False), "0"), (card.whole_degrees(number(None), "f"), "Unknown"),
        (card.band_range(F.lit("cool"), "c"), "<30°C"), (card.band_range(F.lit("warm"), "c", False), "30–38"), (card.band_range(F.lit("scalding"), "f"), "122°F+"), (card.band_range(F.lit("unknown"), "c"), None),
        (card.elevation(number(1200), "c"), "1200 m"), (card.elevation(number(1200), "f"), "3937 ft"), (card.elevation(number(None), "f"), "Unknown"),
        (card.coordinates(number(-33.03125), number(0.0)), "33.0313°S, 0.0000°E"), (card.coordinates(number(1.00005), number(-120.5)), "1.0001°N, 120.5000°W"),
        (card.short_distance(number(12), "c"), "10 m"), (card.short_distance(number(1250), "c"), "1.3 km"), (card.short_distance(number(100), "f"), "330 ft"), (card.short_distance(number(2000), "f"), "1.2 mi"),
        (card.distance(number(9.96), "c"), "10.0 km"), (card.distance(number(10.5), "c"), "11 km"), (card.distance(number(5), "f"), "3.1 mi"), (card.distance(number(100), "f"), "62 mi"),
        (card.accuracy(number(190), "c"), "located to about 190 m"), (card.accuracy(number(1500), "c"), "located to about 1.5 km"), (card.accuracy(number(190), "f"), "located to about 620 ft"),
        (card.accuracy(number(3000), "f"), "located to about 1.9 miles"), (card.accuracy(number(None), "c"), None), (card.accuracy(number(float("nan")), "c"), None),
        (card.label(F.lit("textile-only"), card.CLOTHING), "Swimwear required"), (card.label(F.lit(None).cast("string"), card.HOURS), None),
    ]
    for column, said in cases:
        assert one(spark, column) == said


def test_mineral_panel(spark):
    figures = {"ph": number(7.0), "tds": number(None), "sulfate": number(302.0), "iron": number(0.25)}
    for unit, tail in (("mg/l", " mg/L"), ("grains", ""), (None, "")):
        unit = F.lit(unit).cast("string")
        rows = card.mineral_rows(figures, unit)
        assert [tuple(r) for r in one(spark, rows)] == [("ph", "pH", "7"), ("sulfate", "Sulfate", "302" + tail), ("iron", "Iron", "0.25" + tail)]
        note = one(spark, card.minerals_footnote(rows, unit, F.lit("1998")))
        assert note.startswith("Analysed 1998 ") and note.endswith(card.NOT_TESTED) and (card.NO_UNIT in note) == (not tail)
    only_ph = card.mineral_rows({"ph": number(7.5)}, F.lit(None).cast("string"))
    assert one(spark, card.minerals_footnote(only_ph, F.lit(None).cast("string"), F.lit(None).cast("string"))) == f"{card.UNDATED} {card.NOT_TESTED}"
    none = F.array().cast("array<string>")
    assert one(spark, card.has_minerals(only_ph, none, F.lit(None).cast("string"))) and not one(spark, card.has_minerals(card.mineral_rows({}, F.lit("mg/l")), none, F.lit(None)))


def test_temperature_display_and_notice(spark):
    text = lambda x: F.lit(x).cast("string")
    shown = lambda c, q, d, k, u: tuple(one(spark, card.temperature_display(number(c), number(None if c is None else c * 1.8 + 32), text(q), text(d), text(k), text("s"), u)))
    assert shown(40.0, "hot", "1981", "source", "c") == ("40°C", "104°F", None, "Measured 1981 according to the source below.", "at source", "s")
    assert shown(40.0, None, None, "bathing", "f") == ("104°F", "40°C", None, None, "bathing water", "s")
    assert shown(None, "hot", None, "unknown", "c") == ("Unknown", None, "described as hot", None, None, "s")
    allowed = lambda x: F.lit(x).cast("boolean")
    assert tuple(one(spark, card.prohibition(allowed(False), F.lit("view-only")))) == (True, "Bathing is not permitted here. The site may be viewed but not entered.")
    assert tuple(one(spark, card.prohibition(allowed(None), F.lit("closed")))) == (False, "") == tuple(one(spark, card.prohibition(allowed(True), F.lit("closed"))))


def test_routes(spark):
    told = lambda path, base="": tuple(one(spark, parse.route(F.lit(path), base)))
    assert told("/s/whs_0123456789ab") == ("spring", "whs_0123456789ab", None) == told("/app/s/whs_0123456789ab/", "/app/")
    assert told("/terms") == ("page", None, "terms")
    for path in ("/", "/s/whs_0123456789AB", "/s/whs_0123456789ab\n", "/s/whs_0123456789ab/x", "/s/", "/secret"):
        assert told(path) == ("map", None, None)


def test_field_excerpts(spark):
    """Against every place of every word, counted window by window."""
    rule = "Swimwear, a bathing suit and clothing are required. "
    long = "Swimwear menu. " + "x " * 4000 + rule + "y " * 3000
    cases = [(long, "clothing.policy", 600), ("ticketicketicket " * 3 + "z" * 100, "access.price", 40), ("opening hours " + "q" * 90 + " open", "hours.open", 30), ("short price", "access.price", 100), ("n" * 50, "name", 20), (None, "name", 20), ("", "no.field", 0), ("near " * 30, "no.field", 9)]
    for text, field, most in cases:
        got = one(spark, claims.field_excerpt(F.lit(text).cast("string"), F.lit(field), most))
        text = text or ""
        low, words = text.lower(), claims.FIELD_WORDS.get(field, ())
        expected = (text[:most], 0, None, 0) if len(text) > most else (text, 0, next((w for w in words if w in low), None), 0)
        if len(text) > most:
            hits = [(i, w) for w in words for i in range(len(low)) if low.startswith(w, i)]
            for i, w in hits:
                start = max(0, min(i - most // 2, len(text) - most))
                score = sum(start <= j < start + most for j, _ in hits)
                if score > expected[3]:
                    expected = (text[start : start + most], start, w, score)
        assert tuple(got) == expected
    assert rule.strip() in one(spark, claims.field_excerpt(F.lit(long), F.lit("clothing.policy"), 600))["text"]


def test_sitemap_file(spark, tmp_path, monkeypatch):
    records = spark.createDataFrame([("b&<", 50, "2026-01-02T10:00"), ("a", None, "soon"), (None, 3, None), ("", 3, None)], "id string, completeness int, verified_on string")
    writers.write_sitemap(records, "https://x/", str(tmp_path / "map"))
    files = list((tmp_path / "map").glob("part-*"))
    root = xml.fromstring(files[0].read_bytes())
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    found = [{e.tag.removeprefix(space): e.text for e in url} for url in root]
    assert len(files) == 1 and [u["loc"] for u in found] == ["https://x/", *[f"https://x/{p}" for p in writers.SITEMAP_PAGES], "https://x/s/a", "https://x/s/b&<"]
    assert found[0] == {"loc": "https://x/", "changefreq": "weekly", "priority": "1.0"} and found[5] == {"loc": "https://x/s/a", "changefreq": "monthly", "priority": "0.30"}
    assert found[6]["lastmod"] == "2026-01-02" and found[6]["priority"] == "0.55"
    monkeypatch.setattr(writers, "SITEMAP_MOST", 6)
    with pytest.raises(ValueError, match="more than 6"):
        writers.write_sitemap(records, "https://x", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_collection_is_one_document(spark, tmp_path):
    licence = {"license": "L 1.0", "licenseUrl": "https://l/", "licenseNote": "share \"alike\"", "sources": [{"provider": "a", "attribution": "© A"}, {"provider": "b", "attribution": "B"}]}
    for n in (0, 1, 300):
        path = tmp_path / str(n)
        writers.write_collection(spark.range(n).select(F.format_string("r%04d", "id").alias("id"), F.lit(1.5).alias("lat"), F.col("id").cast("double").alias("lng")).repartition(5), str(path), "atlas", "2026-01-01", licence)
        whole = json.loads("".join(f.read_text() for f in sorted(path.glob("part-*"))))
        assert whole["metadata"] | {"count": n} == whole["metadata"] and whole["metadata"]["attribution"] == "© A; B" and len(whole["metadata"]["sources"]) == 2
        assert [f["id"] for f in whole["features"]] == [f"r{i:04d}" for i in range(n)]
        assert all(f["geometry"]["coordinates"] == [float(i), 1.5] for i, f in enumerate(whole["features"]))


def test_search_words_in_tags_and_town(spark):
    rows = spark.createDataFrame([(1, None, "", "R", "Lee", ["", "wild"]), (2, "A", "C", None, None, None), (3, "x", "y", "z", "", [])], "id int, name string, country string, region string, nearest_town string, tags array<string>").withColumns({c: F.lit(None).cast("string") for c in ("price", "policy", "kind", "hours")} | {"celsius": number(None)})
    ids = lambda words: [r["id"] for r in rows.where(Filters(query=words).predicate(rows.columns)).orderBy("id").collect()]
    assert ids("r lee WILD") == [1] and ids("a c") == [2] and ids("lee") == [1] and ids("x y z") == [3] and ids("nothing") == []
