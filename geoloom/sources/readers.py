"""Readers for the upstream formats, always with an explicit schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.measures import known_number, ring_centroid, sampled_year, unit

ELEMENT = "type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>"
#: Columns of the stations' and the results' tables, by their headers.
STATION_COLUMNS = {"station": "MonitoringLocationIdentifier", "name": "MonitoringLocationName", "lat": "LatitudeMeasure", "lng": "LongitudeMeasure"}
RESULT_COLUMNS = {"station": "MonitoringLocationIdentifier", "measured_at": "ActivityStartDate", "value": "ResultMeasureValue", "unit": "ResultMeasure/MeasureUnitCode"}
#: Columns of the national table of analyses, by their places; a row has at least 71 cells.
ANALYSIS_TEXTS = {"ser": 0, "onsenName": 3, "sourceName": 4, "prefecture": 5, "senshitsu": 73}
ANALYSIS_NUMBERS = {
    "celsius": 11, "ph": 14, "tds": 17, "sodium": 20, "potassium": 21, "calcium": 23, "magnesium": 24, "iron": 25, "chloride": 31, "sulfate": 33, "bicarbonate": 36, "silica": 51,
}
ANALYSIS_WKT, ANALYSIS_YEAR, ANALYSIS_UNIT, ANALYSIS_CELLS, ANALYSIS_LEAST = 7, 8, 70, 82, 71
EVENT = "ts string, type string, springId string, claimPath string, `from` string, `to` string, actor string"
CLAIM = "struct<value: string, source: string, contributor: string, state: string, measuredAt: string>"


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all tile files, each (type, id) once: tiles share their edges, the first file wins."""
    raw = spark.read.schema(f"elements array<struct<{ELEMENT}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = raw.select(F.input_file_name().alias("_file"), F.posexplode("elements").alias("_pos", "e")).select("_file", "_pos", "e.*")
    first = F.row_number().over(W.partitionBy("type", "id").orderBy("_file", "_pos"))
    place = F.struct(F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"))
    return rows.withColumn("_rank", first).where("_rank = 1").select("type", "id", place["lat"].alias("lat"), place["lng"].alias("lng"), "tags")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A mirror with a header line, # comments and empty fields as null."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("comment", "#").option("mode", "FAILFAST").csv(path)


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180: quotes, doubled quotes, commas and line ends inside fields."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def overlays(spark: SparkSession, path: str) -> DataFrame:
    """(id, field, value, source, contributor, state, measuredAt), one row a claim; bad JSON fails."""
    raw = spark.read.schema(f"id string, claims map<string,{CLAIM}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select("id", F.explode("claims").alias("field", "c")).select("id", "field", "c.*")


def overlay_claims(spark: SparkSession, path: str) -> DataFrame:
    """(id, at, field, value, source, contributor, state, measuredAt), one row a claim; ``value`` is JSON text, ``at`` its place in its file.

    Bad JSON fails, and so do two files with one id; the message names both.
    """
    claim = CLAIM.replace("value: string", "value: variant")
    raw = spark.read.schema(f"id string, claims map<string,{claim}>").option("multiLine", True).option("mode", "FAILFAST").json(path).select("id", "claims", F.col("_metadata.file_path").alias("file"))
    twice = raw.groupBy("id").agg(F.count("*").alias("n"), F.min("file").alias("a"), F.max("file").alias("b")).where("n > 1").orderBy("id").first()
    if twice:
        raise ValueError(f"{twice['b']} declares id {twice['id']}, which {twice['a']} already claims")
    return raw.select("id", F.posexplode("claims").alias("at", "field", "c")).select("id", "at", "field", F.to_json("c.value").alias("value"), "c.source", "c.contributor", "c.state", "c.measuredAt")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1, also where a file is read in several splits.

    Lines are numbered in each split, and a split starts after the lines of those before it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("_id", F.monotonically_increasing_id())
    here = F.row_number().over(W.partitionBy("file", "block").orderBy("_id"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = raw.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", before.alias("before"))
    return raw.withColumn("_at", here).join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("_at")).alias("line"), "value")


def _parsed(value: Column, schema: str) -> Column:
    """A line of JSON as a struct, with ``_bad`` for lines that are none."""
    return F.from_json(value, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})


def events(spark: SparkSession, path: str, strict: bool = True, schema: str = EVENT) -> DataFrame:
    """The event log; a corrupt line fails with its file and number, or is skipped where the log is only a hint.

    Blank lines are none.  Lines are numbered only if one is corrupt.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(_parsed(F.col("value"), schema).alias("e"))
    if strict and not lines.where("e._bad is not null").isEmpty():
        bad = numbered_lines(spark, path).where(F.trim("value") != "").where(_parsed(F.col("value"), schema)["_bad"].isNotNull()).orderBy("file", "line").first()
        raise ValueError(f"{bad['file']} line {bad['line']} is not valid JSON")
    return lines.where("e._bad is null").select("e.*").drop("_bad")


def by_header(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Texts of ``columns`` (new name: header) from CSV files, each by its own header line; columns a file lacks are ''.

    Files with equal headers are one scan; there is a scan for each order of columns, not for each file.
    """
    heads = numbered_lines(spark, path).where("line = 1").select("file", F.regexp_replace("value", "^\ufeff", "").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    found = None
    for g in sorted(groups, key=lambda g: g["head"]):
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(g["files"])
        have = {name.strip().lstrip("\ufeff"): F.col(f"`{name}`") for name in raw.columns}
        rows = raw.select(*[F.coalesce(F.trim(have[head]), F.lit("")).alias(name) if head in have else F.lit("").alias(name) for name, head in columns.items()])
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def _finite(text: Column) -> Column:
    """A cell as a number, a blank one as zero; null if it is none."""
    x = F.when(text == "", 0.0).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def stations(spark: SparkSession, path: str) -> DataFrame:
    """(station, name, lat, lng) of monitoring stations, the last row of each; rows without an id or a position are left out."""
    rows = by_header(spark, path, STATION_COLUMNS).withColumns({"lat": _finite(F.col("lat")), "lng": _finite(F.col("lng"))})
    sound = rows.where("station <> '' and lat is not null and lng is not null").withColumn("_id", F.monotonically_increasing_id())
    return sound.groupBy("station").agg(F.max_by(F.struct("name", "lat", "lng"), "_id").alias("s")).select("station", "s.*")


def results(spark: SparkSession, path: str) -> DataFrame:
    """(station, measured_at, value, unit) of measurements; rows without a station or a finite value are left out."""
    rows = by_header(spark, path, RESULT_COLUMNS).where("station <> '' and value <> ''")
    return rows.withColumn("value", _finite(F.col("value"))).where("value is not null")


def analyses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of the national table of analyses, a CSV with a header whose columns go by place.

    Rejected: (reason, cells) of rows too short or without an outline; rows of blank cells only are neither.
    """
    names = [f"c{i}" for i in range(ANALYSIS_CELLS)]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    cell = lambda i: F.col(f"c{i}")
    text = lambda i: F.when(~F.trim(cell(i)).isin("", "N/A"), F.trim(cell(i)))
    filled = F.exists(F.array(*names), lambda x: F.coalesce(x != "", F.lit(False)))
    # the reader gives cells that a row lacks as nulls, and empty ones too: the last cell a full row must have is its unit's
    reason = F.when(cell(ANALYSIS_UNIT).isNull() & F.forall(F.array(*names[ANALYSIS_LEAST - 1 :]), lambda x: x.isNull()), "short row").when(ring_centroid(cell(ANALYSIS_WKT)).isNull(), "unparseable geometry")
    judged = raw.where(filled).withColumn("reason", reason)
    middle = ring_centroid(cell(ANALYSIS_WKT))
    number = lambda i: F.when(F.abs(text(i).try_cast("double")) < float("inf"), text(i).try_cast("double"))
    rows = judged.where("reason is null").select(
        *[text(i).alias(n) for n, i in ANALYSIS_TEXTS.items()], middle["lat"].alias("lat"), middle["lng"].alias("lng"), sampled_year(cell(ANALYSIS_YEAR)).alias("measuredAt"), unit(cell(ANALYSIS_UNIT)).alias("unit"),
        *[number(i).alias(n) for n, i in ANALYSIS_NUMBERS.items()],
    )
    return rows, judged.where("reason is not null").select("reason", F.array(*names).alias("cells"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(entry, spring, refs, lat, lng, name, first_seen, last_seen, missing_since, merged_into) of a registry, one JSON object.

    Entries from before references had providers list ``osmRefs`` only; order is kept.  A reference is ``provider:id``.
    """
    ref = "struct<provider: string, externalId: string>"
    entry = f"struct<osmRefs: array<string>, sourceRefs: array<{ref}>, centroid: array<double>, name: string, firstSeen: string, lastSeen: string, missingSince: string, mergedInto: string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{entry}>", {"mode": "FAILFAST"}).alias("m"))
    qualified = F.transform("e.sourceRefs", lambda r: F.concat(r["provider"], F.lit(":"), r["externalId"]))
    legacy = F.transform(F.coalesce("e.osmRefs", F.array().cast("array<string>")), lambda r: F.concat(F.lit("osm:"), r))
    return raw.select(F.posexplode("m").alias("entry", "spring", "e")).select(
        F.col("entry").cast("long").alias("entry"), "spring", F.coalesce(qualified, legacy).alias("refs"), F.get("e.centroid", F.lit(1)).alias("lat"), F.get("e.centroid", F.lit(0)).alias("lng"), "e.name",
        F.col("e.firstSeen").alias("first_seen"), F.col("e.lastSeen").alias("last_seen"), F.col("e.missingSince").alias("missing_since"), F.col("e.mergedInto").alias("merged_into"),
    )


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(ref, ex_lat, ex_lng, ex_radius, pattern) of the private list; a missing file is an empty list, one that can't be read fails."""
    names = {"osmId": "ref", "lat": "ex_lat", "lng": "ex_lng", "radiusMeters": "ex_radius", "namePattern": "pattern"}
    entry = "osmId: string, lat: double, lng: double, radiusMeters: double, namePattern: string"
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string")
    parsed = raw.select(F.from_json("value", f"entries array<struct<{entry}>>", {"mode": "FAILFAST"}).alias("x"))
    return parsed.select(F.explode("x.entries").alias("e")).select("e.*").withColumnsRenamed(names)


def geojson(spark: SparkSession, path: str, properties: str, order: str | None = None) -> DataFrame:
    """The properties of all features, sorted by one of them if ``order`` names it."""
    raw = spark.read.schema(f"features array<struct<properties: struct<{properties}>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("features").alias("f")).select("f.properties.*")
    return rows.orderBy(order) if order else rows


def first_known(*values: Column) -> Column:
    """The first value that is not null, NaN or a sentinel for "no value"."""
    return F.coalesce(*[known_number(v) for v in values])


def panels(rows: DataFrame, analytes: list[str]) -> DataFrame:
    """``rows`` that have at least one of the analytes."""
    return rows.where(F.coalesce(*analytes).isNotNull())


def pinned_text(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Lines of one file whose content must have the given hash."""
    whole = spark.read.text(path, wholetext=True)
    checked = whole.select(F.when(F.sha2("value", 256) == sha256, F.col("value")).otherwise(F.raise_error(F.lit("the file is not the pinned one"))).alias("v"))
    return checked.select(F.explode(F.split("v", "\r?\n")).alias("value"))
