"""What may become a record: rejects and refusals with one reason each, quarantine, and the split of what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.display import shortest
from ..functions.text import nfkc
from .spatial import box_join

#: Features to look at, those with water, and names that name nothing.
VIEW_NAMES = (
    r"(?i)\b(FUMAROLE|FUMAROLES|GEYSER|GEYSERS|MUDPOT|MUDPOTS|MUDKETTLE|PAINTPOT|PAINTPOTS|SOLFATARA)\b"
    r"|\b(MUD|STEAM|GAS|PAINT)\s+(POT|POTS|VENT|VENTS|VOLCANO|VOLCANOES|CAVE|CAVES)\b"
)
WATER_NAMES = r"(?i)\b(SPRING|SPRINGS|POOL|POOLS|LAGOON|BATHS?|HOT\s+WELLS?)\b"
GENERIC_NAMES = r"(?i)^(HOT|WARM|THERMAL)?\s*(SPRING|SPRINGS|POOL|POOLS|SEEP|SEEPS)?\s*(\(HOT\)|\(WARM\))?$"
LEAST_DECIMALS = 3
#: A name that is a well's number, and tags that show something else is known.
IDENTIFIER_NAME = r"^[\s\-_.#]*[cC]?[\s\-_.#]*[0-9]+[\s\-_.#]*[cC]?[\s\-_.#]*$"
EVIDENCE_KEYS = (
    "temperature", "operator", "website", "contact:website", "wikidata", "wikipedia", "fee", "charge", "opening_hours", "description",
    "tourism", "amenity", "leisure", "building", "bath:type", "access", "ele", "source", "note", "check_date",
)
#: A catalogue's words for temperatures nobody measured; how far its °F and °C may lie apart.
CATALOGUE_CODES = {"B": "boiling", "H": "hot", "W": "warm"}
SCALES_APART_C = 1.5


def _said(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def element_reject(tags: Column, lat: Column, lng: Column) -> Column:
    """Why a map element is no record, or null."""
    geyser = (tags["natural"] == "geyser") & ~_said(tags["bath:type"])
    return F.when(lat.isNull() | lng.isNull(), "no geometry").when(tags["access"].isin("private", "no"), "access=private/no").when(geyser, "geyser, not bathable")


def suspected_borehole(tags: Column) -> Column:
    """Why a hot spring's name looks like a borehole's number, or null."""
    raw = F.coalesce(tags["name"], F.lit(""))
    plain = raw.rlike("^[\\x00-\\x7F]*$")
    # only other names go through Python
    name = F.regexp_replace(F.when(plain, raw).otherwise(nfkc(F.when(~plain, raw))), r"^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$", "")
    told = F.exists(F.array(*[_said(tags[k]) for k in EVIDENCE_KEYS]), lambda x: x) | F.exists(F.map_keys(tags), lambda k: k.startswith("addr:"))
    suspect = (tags["natural"] == "hot_spring") & name.rlike(IDENTIFIER_NAME) & ~told
    return F.when(suspect, F.concat(F.lit('identifier-style name ("'), tags["name"], F.lit('") with no other spring attributes')))


def decimals(number: Column) -> Column:
    return F.length(F.regexp_extract(shortest(number), r"\.([0-9]+)$", 1))


def ref_key(state: Column, lat: Column, lng: Column) -> Column:
    """What a catalogue row is known by."""
    return F.concat_ws("/", F.coalesce(state, F.lit("")), shortest(lat), shortest(lng))


def read_catalogue(lines: DataFrame) -> DataFrame:
    """Lines (value) of a tab-separated catalogue: state, lat, lng, name, celsius, qualitative, reason, line.

    Comments, blank lines and the header are left out; ``reason`` says why a line can't be used.
    """
    cols = F.transform(F.split("value", "\t"), lambda x: F.trim(x))
    part = lambda i: F.coalesce(F.get(cols, F.lit(i)), F.lit(""))
    number = lambda x: F.when(x == "", 0.0).otherwise(x.try_cast("double"))  # noqa: E731  a blank cell is zero
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    rows = lines.where((line != "") & ~line.startswith("#") & (part(0) != "state")).select(
        part(0).alias("state"), number(part(1)).alias("lat"), number(part(2)).alias("lng"), F.nullif(part(3), F.lit("")).alias("name"), part(4).alias("f"), part(5).alias("c"), line.alias("line")
    )
    code = F.create_map(*[F.lit(x) for pair in CATALOGUE_CODES.items() for x in pair])[F.upper("c")]
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    f, c = F.when(F.col("f") != "", number(F.col("f"))).otherwise(0.0), number(F.col("c"))
    apart = finite(f) & (F.abs((f - 32) * 5 / 9 - c) > SCALES_APART_C)
    reason = (
        F.when(~finite(F.col("lat")) | ~finite(F.col("lng")), "unparseable coordinate").when(code.isNotNull(), None).when(~finite(c), "no usable temperature")
        .when(apart, F.concat(F.lit("Fahrenheit and Celsius disagree: "), F.col("f"), F.lit("F vs "), F.col("c"), F.lit("C")))
    )
    good = reason.isNull()
    return rows.select("state", "lat", "lng", "name", F.when(good & code.isNull(), c).alias("celsius"), F.when(good, code).alias("qualitative"), reason.alias("reason"), "line")


def admit(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """``rows`` (id, name, lat, lng, ...) with ``reason``: null, or the first rule that refuses.

    A feature to look at without water in its name; no name of its own; a
    position of fewer than three decimals; a box (west, south, east, north,
    bathing) where bathing is refused.
    """
    barred = box_join(rows.select("id", "lat", "lng"), boxes.where("bathing = false").select("west", "south", "east", "north")).select("id").distinct()
    name = F.trim(F.coalesce("name", F.lit("")))
    reason = (
        F.when(name.rlike(VIEW_NAMES) & ~name.rlike(WATER_NAMES), "view-only feature").when(name.rlike(GENERIC_NAMES), "generic or absent name")
        .when(F.least(decimals(F.col("lat")), decimals(F.col("lng"))) < LEAST_DECIMALS, "coordinates coarser than 3 dp").when(F.col("_barred"), "inside a no-bathing boundary")
    )
    return rows.join(barred.withColumn("_barred", F.lit(True)), "id", "left").withColumn("reason", reason).drop("_barred")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a ``reason``, and those with one.  Write ``rows`` first if they are dear to compute."""
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def reject_counts(rows: DataFrame, key: str = "reason", most: int = 5) -> DataFrame:
    """(key, n): the ``most`` frequent values among the rows with a reason."""
    return rows.where("reason is not null").groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)


def coarse_pin(provenance: Column, provider: str = "ncei") -> Column:
    """Whether a record was minted by the catalogue and touched by nothing else."""
    return provenance == F.array(F.lit(provider))


def new_pins(unmatched: DataFrame, records: DataFrame) -> DataFrame:
    """``unmatched`` catalogue rows (state, lat, lng) with ``became_pin``: whether a record was minted from them.

    ``records``: provenance, and catalogue references ``refs`` (array of row keys).
    """
    minted = records.where(coarse_pin(F.col("provenance"))).select(F.explode("refs").alias("_ref")).distinct()
    keyed = unmatched.withColumn("_key", ref_key(F.col("state"), F.col("lat"), F.col("lng")))
    return keyed.join(minted, F.col("_key") == F.col("_ref"), "left").withColumn("became_pin", F.col("_ref").isNotNull()).drop("_key", "_ref")


def refuse(rows: DataFrame, sound: Column, message: str) -> DataFrame:
    """``rows`` that fail their job where ``sound`` is not true, so that nothing is written."""
    return rows.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def latest_options(rows: DataFrame, code: str, name: str, order: str, unknown: str = "XX") -> DataFrame:
    """(code, name, n): how many rows each code has and its last name; the unknown code is left out."""
    return rows.where(F.col(code) != unknown).groupBy(code).agg(F.max_by(name, order).alias("name"), F.count("*").alias("n"))


def reconciled(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """(key, want, have): the keys of which fewer rows are there than wanted."""
    found = have.groupBy(key).agg(F.count("*").alias("have"))
    return want.join(found, key, "left").select(key, "want", F.coalesce("have", F.lit(0)).alias("have")).where("have < want")


def seam_deduped(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each combination of ``keys``: tiles repeat what lies on their seams."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def known_counts(rows: DataFrame) -> DataFrame:
    """One row: how many values each column has."""
    return rows.agg(*[F.count(c).alias(c) for c in rows.columns])


def upsert(ledger: DataFrame, batch: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The ledger (key, at, claims) with the batch's entries put in, without those older than ``days`` or undated.

    The batch's entry of a key takes the ledger's place whatever its date (the latest of several);
    if it is undated or too old, the key goes.
    """
    both = ledger.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in ("key", "_new")]
    last = both.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("_new", "at")).alias("e")).select("key", "e.*")
    return last.where(F.col("at") >= now - F.expr(f"interval {days} days"))


def sole(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows that are the only one of their ``key``."""
    return rows.withColumn("_n", F.count("*").over(W.partitionBy(*key))).where("_n = 1").drop("_n")
