"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line


#: What one sitemap may hold, and its pages beside the map.
SITEMAP_MOST = 50_000
SITEMAP_PAGES = ("about", "safety", "terms", "privacy")


def _feature(records: DataFrame) -> Column:
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    named = [F.col("id").alias("id")] if "id" in records.columns else []
    feature = F.struct(F.lit("Feature").alias("type"), *named, geometry.alias("geometry"), F.struct(*records.columns).alias("properties"))
    return F.to_json(feature, {"ignoreNullFields": "false"})


def features(records: DataFrame) -> DataFrame:
    """One GeoJSON feature a record, as text."""
    return records.select(_feature(records).alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """Parquet is the truth; JSON lines and features are for readers."""
    records.write.parquet(f"{path}/parquet")
    records.write.option("ignoreNullFields", False).json(f"{path}/json")
    features(records).write.text(f"{path}/geojson")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header; tabs and line ends in text become blanks."""
    text = [name for name, kind in rows.dtypes if kind == "string"]
    rows.withColumns({c: one_line(F.col(c)) for c in text}).write.option("sep", "\t").option("header", True).csv(path)


def sitemap_entries(records: DataFrame, base: str) -> DataFrame:
    """(loc, priority, lastmod) of the records with an id: priority 0.3 to 0.8 by completeness (unknown: 0.3); lastmod only if it starts as a date."""
    known = F.coalesce(F.col("completeness"), F.lit(0)) / 100
    day = F.when(F.col("verified_on").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring("verified_on", 1, 10))
    ident = F.col("id").cast("string")
    rows = records.where(F.coalesce(ident, F.lit("")) != "")
    return rows.select(F.concat(F.lit(base), ident).alias("loc"), F.format_number(0.3 + F.least(F.lit(1.0), known) * 0.5, 2).alias("priority"), day.alias("lastmod"))


def write_sitemap(records: DataFrame, origin: str, path: str) -> None:
    """One XML file of the map, its pages and all records; ValueError for more addresses than it may hold, before anything is written."""
    origin = origin.rstrip("/")
    own = [(0, f"{origin}/", "1.0", None, "weekly")] + [(i + 1, f"{origin}/{page}", "0.3", None, "yearly") for i, page in enumerate(SITEMAP_PAGES)]
    found = sitemap_entries(records, f"{origin}/s/").select(F.lit(len(own)).alias("ord"), "*", F.lit("monthly").alias("changefreq"))
    entries = records.sparkSession.createDataFrame(own, "ord int, loc string, priority string, lastmod string, changefreq string").unionByName(found)
    if entries.limit(SITEMAP_MOST + 1).count() > SITEMAP_MOST:
        raise ValueError(f"more than {SITEMAP_MOST} addresses in one sitemap")
    safe = F.col("loc")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(entity))
    field = lambda name, value: F.concat(F.lit(f"    <{name}>"), value, F.lit(f"</{name}>"))
    # concat_ws leaves out fields that are null
    entry = F.concat_ws("\n", F.lit("  <url>"), field("loc", safe), *[field(c, F.col(c)) for c in ("lastmod", "changefreq", "priority")], F.lit("  </url>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    frame = records.sparkSession.createDataFrame([(-1, "", head), (99, "", "</urlset>")], "ord int, loc string, value string")
    # at most SITEMAP_MOST rows, so one file is one small task
    entries.select("ord", "loc", entry.alias("value")).unionByName(frame).repartition(1).sortWithinPartitions("ord", "loc").select("value").write.text(path)


def write_collection(records: DataFrame, path: str, name: str, source_date: str, licence: dict, note: str | None = None) -> None:
    """A GeoJSON collection with its terms: the files of the folder, joined in the order of their names, are one document.

    ``licence`` (license, licenseUrl, licenseNote, sources as a list of dicts
    with attribution and more) goes into the metadata, with the line of all
    attributions.  Records are sorted by id by range, so any number of tasks
    writes them.
    """
    line = "; ".join(s["attribution"] for s in licence.get("sources", ()))
    terms = {**{k: v for k, v in licence.items() if k != "sources"}, "attribution": line, "sources": licence.get("sources", [])}
    known = records.agg(F.count("*").alias("n"), F.min("id").alias("first")).first()
    metadata = {"name": name, "sourceDate": source_date, "count": known["n"], **terms} | ({"note": note} if note else {})
    opening = '{"type":"FeatureCollection","metadata":' + json.dumps(metadata, ensure_ascii=False) + ',"features":['
    comma = F.when(F.col("id") == known["first"], "").otherwise(",")
    lines = records.select(F.lit(1).alias("ord"), F.col("id").alias("_id"), F.concat(comma, _feature(records)).alias("value"))
    kind = lines.schema["_id"].dataType
    ends = records.sparkSession.createDataFrame([(0, opening), (2, "]}")], "ord int, value string").select("ord", F.lit(None).cast(kind).alias("_id"), "value")
    lines.unionByName(ends).repartitionByRange("ord", "_id").sortWithinPartitions("ord", "_id").select("value").write.text(path)
