"""Point tables derived from the driver's tables, which have no coordinates.

The arithmetic is the same in ``SPRINGS_SQL``; blocks of 20 keys keep clusters
small at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import completeness, known_fields


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(k: Column) -> tuple[Column, Column]:
    b, j = F.floor(k / 20), k % 20
    j2 = F.floor(j / 2)
    lat = 30.0 + (b % 400) * 0.05 + ((j2 * 7) % 10) * 0.0026 + (j % 2) * (b % 5) * 0.0004
    lng = -120.0 + F.floor(b / 400) * 0.08 + ((j2 * 3) % 10) * 0.0034 + (j % 2) * (b % 3) * 0.0003
    return lat, lng


def springs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spring an order."""
    k = F.col("o_orderkey")
    lat, lng = position(k)
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), lat.alias("lat"), lng.alias("lng"),
        F.when(k % 5 != 0, (20 + (k * 13) % 70).cast("double")).alias("celsius"),
        F.when(k % 6 != 0, F.concat(F.lit("Hot Spring "), (k % 50).cast("string"))).alias("name"),
        F.concat(F.lit("C"), (k % 25).cast("string")).alias("country"),
        F.concat(F.lit("R"), (k % 7).cast("string")).alias("region"),
        pick(4, "Free", "5 USD", "", None).alias("price"),
        pick(3, "unknown", "optional", "required").alias("policy"),
        F.when(k % 5 == 1, "open").otherwise("unknown").alias("hours"),
        pick(4, "hot_spring", "onsen", "pool", "unknown").alias("kind"),
        pick(2, "way", "node").alias("element"),
    )
    known = known_fields(F.col("name"), F.col("celsius"), F.col("price"), F.col("policy"), F.col("hours"), F.col("kind"))
    return rows.withColumn("known", known).withColumn("completeness", completeness(F.col("known")))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measuring station a supplier, close to some spring."""
    k = F.col("s_suppkey") * 97
    lat, lng = position(k)
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("station"), (lat + 0.0011).alias("r_lat"), lng.alias("r_lng"), (20 + (k * 13) % 70 + F.col("s_suppkey") % 4).cast("double").alias("reading")
    )


_PLACE = """30.0::DOUBLE + (({k} // 20) % 400) * 0.05::DOUBLE + (((({k} % 20) // 2) * 7) % 10) * 0.0026::DOUBLE + ({k} % 2) * (({k} // 20) % 5) * 0.0004::DOUBLE AS {lat},
  -120.0::DOUBLE + (({k} // 20) // 400) * 0.08::DOUBLE + (((({k} % 20) // 2) * 3) % 10) * 0.0034::DOUBLE + ({k} % 2) * (({k} // 20) % 3) * 0.0003::DOUBLE AS {lng}"""

SPRINGS_SQL = f"""base AS (
  SELECT o_orderkey AS id, {_PLACE.format(k="o_orderkey", lat="lat", lng="lng")},
    CASE WHEN o_orderkey % 5 <> 0 THEN (20 + (o_orderkey * 13) % 70)::DOUBLE END AS celsius,
    CASE WHEN o_orderkey % 6 <> 0 THEN 'Hot Spring ' || (o_orderkey % 50) END AS name,
    'C' || (o_orderkey % 25) AS country, 'R' || (o_orderkey % 7) AS region,
    CASE o_orderkey % 4 WHEN 0 THEN 'Free' WHEN 1 THEN '5 USD' WHEN 2 THEN '' END AS price,
    CASE o_orderkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'optional' ELSE 'required' END AS policy,
    CASE WHEN o_orderkey % 5 = 1 THEN 'open' ELSE 'unknown' END AS hours,
    CASE o_orderkey % 4 WHEN 0 THEN 'hot_spring' WHEN 1 THEN 'onsen' WHEN 2 THEN 'pool' ELSE 'unknown' END AS kind,
    CASE o_orderkey % 2 WHEN 0 THEN 'way' ELSE 'node' END AS element
  FROM orders
), springs AS (
  SELECT *, floor(100.0::DOUBLE * ((name IS NOT NULL)::INT + (celsius IS NOT NULL)::INT + (coalesce(price, '') <> '')::INT
    + (policy <> 'unknown')::INT + (hours <> 'unknown')::INT + (kind <> 'unknown')::INT) / 6 + 0.5)::INT AS completeness FROM base
)"""

STATIONS_SQL = f"""stations AS (
  SELECT station, p_lat + 0.0011::DOUBLE AS r_lat, r_lng, reading FROM (
    SELECT s_suppkey AS station, {_PLACE.format(k="(s_suppkey * 97)", lat="p_lat", lng="r_lng")},
      (20 + (s_suppkey * 97 * 13) % 70 + s_suppkey % 4)::DOUBLE AS reading FROM supplier)
)"""


def metres_sql(a: str, b: str, lat: str = "lat", lng: str = "lng") -> str:
    """Metres between two aliases' positions, as a double."""
    h = f"pow(sin(radians({b}.{lat} - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.{lat})) * pow(sin(radians({b}.{lng} - {a}.lng) / 2), 2)"
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {h}))))"
