"""A catalogue's rows beside the records: the match with its report, and rows that become records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import completeness, fahrenheit, known_fields
from ..functions.tags import derive_warnings
from ..functions.text import names_agree
from .admission import ref_key
from .fields import UNITED
from .spatial import nearest_anywhere, nearest_within

#: Metres in reach; why a row in reach is refused; the provider's name, source, address and warning.
MATCH_M = 200
NAMES, CONTENDED = "name disagreement", "ambiguous: two NCEI rows contend for one spring"
PROVIDER, MEASURED, COUNTRY = "ncei", "1981", ("US", "United States of America")


def match(rows: DataFrame, records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(row, id, metres, outcome, reason): what becomes of each catalogue row.

    ``rows``: row (a number), name, lat, lng; ``records``: id (their order), name, lat, lng.  The nearest record (the first at a
    tie) within ``MATCH_M`` must bear a name that agrees; all rows that are left for one record are
    refused together.  outcome: matched, rejected, or unmatched with the nearest record at any distance (null if there
    is none).  ``records`` shouldn't hold those minted from the same catalogue.
    """
    theirs = records.select("id", F.col("name").alias("r_name"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    near = nearest_within(rows.select("row", "name", "lat", "lng"), theirs, "row", F.col("id"), MATCH_M)
    agreed = near.withColumn("_agree", names_agree(F.col("name"), F.col("r_name"), ascii_only))
    claims = F.count(F.when(F.col("_agree"), 1)).over(W.partitionBy("id"))
    reason = F.when(~F.col("_agree"), NAMES).when(claims > 1, CONTENDED)
    told = agreed.withColumn("reason", reason).select("row", "id", "metres", F.when(F.col("reason").isNull(), "matched").otherwise("rejected").alias("outcome"), "reason")
    rest = rows.join(told.select("row"), "row", "left_anti")
    far = nearest_anywhere(rest, theirs, "row", "id")
    alone = rest.select("row").join(far, "row", "left").select("row", F.lit(None).cast(dict(records.dtypes)["id"]).alias("id"), "metres", F.lit("unmatched").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    return told.unionByName(alone)


def to_records(rows: DataFrame, ingested: Column, source: str, address: str, warning: str) -> DataFrame:
    """Admitted catalogue rows (state, lat, lng, name, celsius, qualitative) as full records.

    ``source`` says where the temperatures come from, ``address`` is its page, ``warning`` tells that they are old.
    Nothing that the catalogue doesn't say is set; the score counts what is known as for all records.
    """
    ref = ref_key(F.col("state"), F.col("lat"), F.col("lng"))
    text, number = (lambda n: F.lit(None).cast("string").alias(n)), (lambda n: F.lit(None).cast("double").alias(n))
    unknown = F.lit("unknown")
    known = known_fields(F.col("name"), F.col("celsius"), F.lit(None).cast("string"), unknown, unknown, F.lit("natural"))
    return rows.select(
        F.concat(F.lit(f"{PROVIDER}:"), ref).alias("id"), F.array(F.concat(F.lit(f"{PROVIDER}:"), ref)).alias("refs"), "name",
        F.struct("lat", "lng", number("elevation"), F.lit(COUNTRY[0]).alias("country"), F.lit(COUNTRY[1]).alias("countryName"), F.col("state").alias("region"), text("nearestTown"), F.lit(None).cast("int").alias("accuracyMeters")).alias("location"),
        F.struct("celsius", fahrenheit(F.col("celsius")).alias("fahrenheit"), F.lit(source).alias("source"), F.lit(MEASURED).alias("measuredAt"), "qualitative", F.lit("source").alias("kind")).alias("temperature"),
        F.struct(text("price"), text("currency"), text("notes"), unknown.alias("status"), F.lit(None).cast("boolean").alias("bathingAllowed")).alias("access"),
        F.struct(unknown.alias("policy"), text("schedule"), text("notes")).alias("clothing"), F.struct(text("open"), text("seasonalNotes"), unknown.alias("status")).alias("hours"),
        F.struct(number("ph"), *[number(x) for x in UNITED], F.array().cast("array<string>").alias("types"), text("notes"), text("measuredAt"), text("unit")).alias("minerals"),
        F.lit("natural").alias("type"), F.lit(False).alias("unicorn"), F.lit(False).alias("verified"), ingested.alias("lastVerified"), F.array(F.lit(address)).alias("sources"), text("description"),
        F.array().cast("array<string>").alias("tags"), F.array_append(derive_warnings(F.create_map().cast("map<string,string>"), F.col("celsius"), F.lit("natural")), F.lit(warning)).alias("warnings"),
        F.struct(F.array(F.lit(PROVIDER)).alias("provenance"), completeness(known).alias("completeness"), known.alias("known"), F.lit(False).alias("curated"), ingested.alias("ingestedAt")).alias("quality"),
    )
