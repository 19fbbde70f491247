"""Registered queries of the catalogue's match, scenes and picks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scene
from ..operators import catalogue
from .queries import BOTH, SPRINGS, query
from .tables import metres_sql, springs, stations

_M = "4294967295::HUGEINT"
_HASH = f"list_reduce(list_transform(range(1, length(t) + 1), lambda i: ord(substr(t, i, 1))::HUGEINT), lambda h, u: (xor(h, u) * 16777619) & {_M}, 2166136261::HUGEINT)"


def _rand(seed: str, n: int = 1) -> str:
    a = f"((({seed}) + {0x6D2B79F5 * n & 0xFFFFFFFF}) & {_M})"
    t = f"((xor({a}, {a} >> 15) * ({a} | 1::HUGEINT)) & {_M})"
    return f"(WITH q AS (SELECT {t} AS t), w AS (SELECT xor((t + ((xor(t, t >> 7) * (t | 61::HUGEINT)) & {_M})) & {_M}, t) AS t FROM q) SELECT xor(t, t >> 14)::DOUBLE / 4294967296 FROM w)"


@query(f"""{SPRINGS}, h AS (SELECT *, 'whs_' || id AS t FROM springs), s AS (SELECT *, {_HASH} AS seed FROM h), g AS (SELECT *, {_rand('seed')} AS r1 FROM s), f AS (SELECT *, {_rand('seed', 3)} AS r3 FROM g),
n AS (SELECT *, (id * 7919) % 31536000 AS x FROM f), d AS (SELECT *, (x // 86400 + 1)::INT AS day, x % 86400 AS sec FROM n),
e AS (SELECT *, radians(-23.44::DOUBLE * cos(2 * pi() * (day + 10) / 365)) AS tilt, radians(15 * (sec / 3600.0::DOUBLE + lng / 15 - 12)) AS ang FROM d),
u AS (SELECT *, degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians(lat)) * sin(tilt) + cos(radians(lat)) * cos(tilt) * cos(ang))))) AS sun FROM e)
SELECT id, seed::BIGINT AS seed, r1, r3, round(sun, 6) AS sun, CASE WHEN sun > 25 THEN 'high sun' WHEN sun > 6 THEN 'low sun' WHEN sun > -4 THEN 'golden hour' WHEN sun > -6 THEN 'blue hour' WHEN sun > -12 THEN 'dusk' ELSE 'night' END AS light,
CASE WHEN celsius IS NULL THEN 0 WHEN celsius < 25 THEN 6 WHEN celsius < 38 THEN 14 WHEN celsius < 50 THEN 22 ELSE 30 END AS steam,
CASE WHEN id % 110 <= 0 THEN 'clear sky' WHEN id % 110 <= 3 THEN 'partly cloudy' WHEN id % 110 <= 48 THEN 'fog' WHEN id % 110 <= 67 THEN 'drizzle' WHEN id % 110 <= 77 THEN 'snow' WHEN id % 110 <= 82 THEN 'rain showers' WHEN id % 110 <= 99 THEN 'thunderstorms' ELSE 'changing skies' END AS weather FROM u""")
def scene_numbers(spark, sf_dir):
    """Each spring at its own second of 2025."""
    k = F.col("id")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2025-01-01T00:00:00Z").cast("timestamp")) + (k * 7919) % 31_536_000)
    seed = scene.hash_seed(F.concat(F.lit("whs_"), k.cast("string")))
    rows = springs(spark, sf_dir).withColumn("sun", scene.solar_elevation(F.col("lat"), F.col("lng"), at)).withColumn("seed", seed)
    return rows.select(
        "id", "seed", scene.random_at(F.col("seed")).alias("r1"), scene.random_at(F.col("seed"), 3).alias("r3"), F.round("sun", 6).alias("sun"), scene.daylight_word(F.col("sun")).alias("light"), scene.steam_count(F.col("celsius")).alias("steam"),
        scene.weather_label(k % 110).alias("weather"),
    )


@query(f"""{SPRINGS}, h AS (SELECT *, id::VARCHAR AS t FROM springs), s AS (SELECT *, xor({_HASH}, 7::HUGEINT) AS seed FROM h WHERE celsius IS NOT NULL AND completeness >= 50), r AS (SELECT *, {_rand('seed')} AS r FROM s)
SELECT id, name FROM r ORDER BY r, id LIMIT 1""")
def random_pick(spark, sf_dir):
    return scene.picked(springs(spark, sf_dir).select("id", "name", "celsius", "completeness"), seed=7).select("id", "name")


@query(f"""{BOTH}, r AS (SELECT station AS row, r_lat AS lat, r_lng AS lng, CASE WHEN station % 4 = 0 THEN NULL WHEN station % 4 = 1 THEN 'Hot Spring ' || (station % 50) ELSE 'Spring 1' END AS name FROM stations),
p AS (SELECT r.row, r.name, a.id, a.name AS r_name, {metres_sql('a', 'r')} AS d FROM r JOIN springs a ON a.id % 7 <> 0),
b AS (SELECT row, any_value(name) AS name, arg_min(id, (d, id)) AS id, arg_min(coalesce(r_name, ''), (d, id)) AS r_name, floor(min(d) + 0.5)::BIGINT AS metres, min(d) AS d FROM p GROUP BY row),
n AS (SELECT *, replace(lower(coalesce(name, '')), ' ', '') AS x, replace(lower(r_name), ' ', '') AS y, regexp_replace(replace(lower(coalesce(name, '')), ' ', ''), '^hot', '') AS sx, regexp_replace(replace(lower(r_name), ' ', ''), '^hot', '') AS sy FROM b WHERE d <= 200),
g AS (SELECT *, x = '' OR y = '' OR contains(x, y) OR contains(y, x) OR contains(sx, sy) OR contains(sy, sx) AS agree FROM n), c AS (SELECT *, count(*) FILTER (WHERE agree) OVER (PARTITION BY id) AS wanted FROM g)
SELECT row, id, metres, CASE WHEN agree AND wanted = 1 THEN 'matched' ELSE 'rejected' END AS outcome, CASE WHEN NOT agree THEN 'name disagreement' WHEN wanted > 1 THEN 'ambiguous: two NCEI rows contend for one spring' END AS reason FROM c
UNION ALL SELECT row, NULL, metres, 'unmatched', NULL FROM b WHERE d > 200""")
def catalogue_match(spark, sf_dir):
    """Stations as catalogue rows; every seventh spring was minted from the catalogue."""
    k = F.col("station")
    name = F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat(F.lit("Hot Spring "), (k % 50).cast("string"))).otherwise("Spring 1")
    rows = stations(spark, sf_dir).select(k.alias("row"), F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"), name.alias("name"))
    return catalogue.match(rows, springs(spark, sf_dir).where("id % 7 <> 0"), ascii_only=True)
