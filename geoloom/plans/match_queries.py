"""Registered queries of the matchers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from .queries import BOTH, D_STATION, NEAR_STATION, query
from .tables import springs, stations, table

_READINGS = """r AS (SELECT 'S' || s.station AS site, s.r_lat, s.r_lng, l_orderkey * 10 + l_linenumber AS o, l_partkey AS p, strftime(l_shipdate, '%Y-%m-%d') AS day,
s.reading + (s.station % 3) * 0.75 * (l_linenumber % 4) + CASE WHEN l_orderkey % 40 = 0 THEN 200 ELSE 0 END AS c FROM lineitem JOIN stations s ON s.station = l_suppkey)"""


def _readings(spark, sf_dir):
    s = stations(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == s["station"])
    odd = F.when(F.col("l_orderkey") % 40 == 0, 200.0).otherwise(0.0)
    return lines.select(
        F.concat(F.lit("S"), F.col("station").cast("string")).alias("station"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_partkey").alias("ord"), F.lit("well").alias("name"), F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"),
        (F.col("reading") + (F.col("station") % 3) * 0.75 * (F.col("l_linenumber") % 4) + odd).alias("celsius"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("measured_at"),
    )


_GROUPED = """g AS (SELECT site, any_value(r_lat) AS r_lat, any_value(r_lng) AS r_lng, count(*) AS n, min(c) AS lo, max(c) AS hi, arg_min(c, (-(day::DATE - DATE '1970-01-01'), o, p)) AS c, max(day) AS day FROM r WHERE c <= 100 GROUP BY site)"""


@query(f"{BOTH}, {_READINGS}, {_GROUPED} SELECT site AS station, n::BIGINT AS readings, lo AS least, hi AS most, c AS celsius, day AS measured_at FROM g")
def station_readings(spark, sf_dir):
    return matching.group_stations(_readings(spark, sf_dir)).select("station", "readings", "least", "most", "celsius", "measured_at")


@query(f"""{BOTH}, {_READINGS}, {_GROUPED}, pairs AS (SELECT a.id, b.*, floor({D_STATION} + 0.5)::BIGINT AS m, count(*) OVER (PARTITION BY a.id) AS near FROM springs a JOIN g b ON {NEAR_STATION} AND a.celsius IS NULL AND {D_STATION} <= 200),
claimed AS (SELECT *, count(CASE WHEN near = 1 THEN 1 END) OVER (PARTITION BY site) AS k FROM pairs),
judged AS (SELECT *, CASE WHEN near > 1 THEN near || ' stations within 200 m' WHEN k > 1 THEN 'station ' || site || ' is within 200 m of ' || k || ' springs' WHEN hi - lo > 2 THEN printf('station readings span %.1f C', floor((hi - lo) * 10 + 0.5) / 10) END AS reason FROM claimed)
SELECT DISTINCT id, CASE WHEN reason IS NULL THEN site END AS station, CASE WHEN reason IS NULL THEN m END AS metres, CASE WHEN reason IS NULL THEN c END AS celsius, CASE WHEN reason IS NULL THEN day END AS measured_at, CASE WHEN reason IS NULL THEN n END AS readings, reason FROM judged""")
def station_match(spark, sf_dir):
    return matching.match_stations(springs(spark, sf_dir).where("celsius is null").select("id", "lat", "lng"), _readings(spark, sf_dir))


_WELLS = f"""wells AS (SELECT s_suppkey AS ser, CASE WHEN s_suppkey % 4 <> 0 THEN 'Onsen ' || (s_suppkey * 97 // 40) || '温泉' END AS onsen, CASE WHEN s_suppkey % 3 = 0 THEN 'Onsen' ELSE 'Well Onsen ' || (s_suppkey * 97 // 40) END AS source, r_lat, r_lng FROM supplier JOIN stations ON station = s_suppkey),
recs AS (SELECT id, lat, lng, CASE WHEN id % 5 <> 0 THEN 'Onsen ' || (id // 40) || CASE id % 3 WHEN 0 THEN 'の湯' ELSE '' END END AS name FROM springs),
norm AS (SELECT *, regexp_replace(lower(replace(coalesce(onsen, ''), '温泉', '')), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS y FROM wells),
rnorm AS (SELECT *, regexp_replace(lower(replace(coalesce(name, ''), 'の湯', '')), '[^a-z0-9]', '', 'g') AS z FROM recs)"""


def _says(n: str) -> str:
    return f"CASE WHEN {n} = '' OR z = '' THEN NULL WHEN {n} = z THEN 'exact' WHEN least(length({n}), length(z)) >= 4 AND (contains({n}, z) OR contains(z, {n})) THEN 'substring' END"


@query(f"""{BOTH}, {_WELLS}, pairs AS (SELECT coalesce(onsen, '__ser:' || ser) AS g, ser, a.id, floor({D_STATION} + 0.5)::BIGINT AS m, coalesce({_says('x')}, {_says('y')}) AS said FROM rnorm a JOIN norm b ON {NEAR_STATION} AND {D_STATION} <= 200),
near AS (SELECT g, id, min(m) AS m, arg_min(said, (m, ser)) AS said FROM pairs WHERE said IS NOT NULL GROUP BY g, id), counted AS (SELECT *, count(*) OVER (PARTITION BY g) AS hits FROM near),
found AS (SELECT DISTINCT g, CASE WHEN hits = 1 THEN id END AS id, CASE WHEN hits = 1 THEN m END AS metres, CASE WHEN hits = 1 THEN said END AS agreement FROM counted)
SELECT g AS "group", id, metres, agreement, CASE WHEN id IS NULL THEN 'one group, several springs' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'several groups, one spring' END AS reason FROM found""")
def group_match(spark, sf_dir):
    ser, part = F.col("station"), F.floor(F.col("station") * 97 / 40).cast("string")
    wells = stations(spark, sf_dir).select(
        ser.alias("ser"), F.when(ser % 4 != 0, F.concat(F.lit("Onsen "), part, F.lit("温泉"))).alias("onsen"),
        F.when(ser % 3 == 0, "Onsen").otherwise(F.concat(F.lit("Well Onsen "), part)).alias("source"), F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"),
    )
    k = F.col("id")
    name = F.when(k % 5 != 0, F.concat(F.lit("Onsen "), F.floor(k / 40).cast("string"), F.when(k % 3 == 0, "の湯").otherwise("")))
    return matching.match_groups(wells, springs(spark, sf_dir).select("id", name.alias("name"), "lat", "lng"))


#: How far apart values of one field may lie.
_TOLERANCES = {"ph": 0.2, "sodium": 5.0}


@query(f"""{BOTH}, rows AS (SELECT s.station, s.r_lat, s.r_lng, l_orderkey * 10 + l_linenumber AS o, l_partkey AS p, strftime(l_shipdate, '%Y') AS y, CASE WHEN l_linenumber % 2 = 0 THEN 7 + (s.station % 3) * 0.25::DOUBLE * (l_linenumber % 3) END AS ph, 100 + (s.station % 2) * 4.0::DOUBLE * l_linenumber AS na FROM lineitem JOIN stations s ON s.station = l_suppkey),
g AS (SELECT printf('%.5f,%.5f', r_lat, r_lng) AS site, any_value(r_lat) AS r_lat, any_value(r_lng) AS r_lng, max(y) AS y, CASE WHEN max(ph) - min(ph) <= 0.2 THEN arg_min(ph, (o, p)) FILTER (ph IS NOT NULL) END AS v_ph, CASE WHEN max(na) - min(na) <= 5 THEN arg_min(na, (o, p)) END AS v_na,
concat_ws(',', CASE WHEN max(ph) - min(ph) > 0.2 THEN 'ph' END, CASE WHEN max(na) - min(na) > 5 THEN 'sodium' END) AS apart FROM rows GROUP BY 1),
pairs AS (SELECT a.id, b.*, floor({D_STATION} + 0.5)::BIGINT AS m, count(*) OVER (PARTITION BY a.id) AS near FROM springs a JOIN g b ON {NEAR_STATION} AND a.id % 3 = 0 AND {D_STATION} <= 200),
claimed AS (SELECT *, count(CASE WHEN near = 1 THEN 1 END) OVER (PARTITION BY site) AS k FROM pairs),
judged AS (SELECT *, CASE WHEN near > 1 THEN near || ' chemistry sites within 200 m' WHEN k > 1 THEN 'one site is within 200 m of ' || k || ' springs' WHEN coalesce(v_ph, v_na) IS NULL THEN 'every field disagrees across analyses: ' || replace(apart, ',', ', ') END AS reason FROM claimed)
SELECT DISTINCT id, CASE WHEN reason IS NULL THEN m END AS metres, CASE WHEN reason IS NULL THEN y END AS measured_at, CASE WHEN reason IS NULL THEN v_ph END AS v_ph, CASE WHEN reason IS NULL THEN v_na END AS v_sodium, CASE WHEN reason IS NULL THEN apart END AS withheld, reason FROM judged""")
def panel_match(spark, sf_dir):
    s = stations(spark, sf_dir)
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == s["station"]).select(
        F.col("station").cast("string").alias("site"), F.struct((F.col("l_orderkey") * 10 + n).alias("o"), "l_partkey").alias("ord"), F.lit(None).cast("string").alias("name"), F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng"),
        F.date_format("l_shipdate", "yyyy").alias("measured_at"), F.when(n % 2 == 0, 7 + (F.col("station") % 3) * 0.25 * (n % 3)).alias("ph"), (100 + (F.col("station") % 2) * 4.0 * n).alias("sodium"),
    )
    found = matching.match_panels(springs(spark, sf_dir).where("id % 3 = 0").select("id", "lat", "lng"), rows, _TOLERANCES)
    return found.withColumn("withheld", F.array_join("withheld", ",")).drop("site")
