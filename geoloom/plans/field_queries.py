"""Registered queries of fields read from tags, classifications and outlines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures, minerals, tags
from ..functions.geo import half_up
from ..operators import fills
from .queries import query
from .tables import table


@query(f"""WITH p AS (SELECT p_partkey AS k, (p_partkey % 60)::DOUBLE AS c FROM part), kinds AS (SELECT *,
CASE WHEN k % 7 = 0 AND k % 4 = 0 THEN 'resort' WHEN k % 7 = 0 OR (k % 3 <> 0 AND k % 5 = 0) THEN 'developed' WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'natural' WHEN k % 3 <> 0 THEN 'wild' ELSE 'unknown' END AS kind FROM p)
SELECT k AS id, kind, CASE WHEN k % 11 = 0 THEN 'closed' WHEN k % 6 = 0 THEN 'open' WHEN k % 6 = 1 OR k % 8 = 0 THEN 'seasonal' ELSE 'unknown' END AS hours,
CASE WHEN k % 9 = 0 THEN 'optional' WHEN k % 9 = 1 THEN 'textile-only' WHEN k % 10 = 0 THEN 'mixed' ELSE 'unknown' END AS policy,
concat_ws('|', CASE WHEN c BETWEEN 38 AND 43 THEN 'soakable' END) AS labels,
concat_ws('|', CASE WHEN c >= 50 THEN '{tags.SCALDING}' WHEN c >= 44 THEN '{tags.VERY_HOT}' END, CASE WHEN kind = 'wild' THEN '{tags.UNDEVELOPED}' END) AS warnings FROM kinds""")
def feature_fields(spark, sf_dir):
    k = F.col("k")
    said = {
        "natural": F.when(k % 3 != 0, "hot_spring"), "name": F.when(k % 4 == 0, F.concat(F.lit("Old Spa "), k.cast("string"))), "fee": F.when(k % 5 == 0, "yes"),
        "amenity": F.when(k % 7 == 0, "public_bath"), "opening_hours": F.when(k % 6 == 0, "24/7").when(k % 6 == 1, "May-Oct").when(k % 6 == 2, ""), "seasonal": F.when(k % 8 == 0, "summer"),
        "disused": F.when(k % 11 == 0, "yes"), "nudism": F.when(k % 9 == 0, "permissive").when(k % 9 == 1, "no"), "bath:sex": F.when(k % 10 == 0, "separated"),
    }
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).withColumn("tags", F.create_map(*[x for key, v in said.items() for x in (F.lit(key), v)]))
    t, celsius = F.col("tags"), (k % 60).cast("double")
    rows = rows.withColumn("kind", tags.parse_kind(t))
    return rows.select(
        k.alias("id"), "kind", tags.parse_hours(t)["status"].alias("hours"), tags.parse_clothing(t)["policy"].alias("policy"),
        F.array_join(tags.derive_tags(t, celsius), "|").alias("labels"), F.array_join(tags.derive_warnings(t, celsius, F.col("kind")), "|").alias("warnings"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN concat_ws(',', CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 = 2 THEN 'simple' END,
CASE p_partkey % 3 WHEN 0 THEN 'chloride' WHEN 1 THEN 'bicarbonate' END, CASE p_partkey % 4 WHEN 0 THEN 'sulfur' WHEN 2 THEN 'acidic' END) END AS types FROM part""")
def mineral_types(spark, sf_dir):
    k = F.col("p_partkey")
    first = F.when(k % 4 == 0, "含硫黄-").when(k % 4 == 1, "単純").when(k % 4 == 2, "酸性・").otherwise("")
    second = F.when(k % 3 == 0, "ナトリウム-塩化物").when(k % 3 == 1, "炭酸水素塩").otherwise("")
    value = F.concat(first, second, F.when(k % 5 == 0, "謎").otherwise("温泉"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(minerals.mineral_types(value), ",").alias("types"))


@query("SELECT s_suppkey AS id, (s_suppkey % 170 + 2)::DOUBLE AS lng, (s_suppkey % 80 + 1)::DOUBLE AS lat FROM supplier")
def outline_centroids(spark, sf_dir):
    x, y = F.col("s_suppkey") % 170, F.col("s_suppkey") % 80
    corner = lambda dx, dy: F.concat_ws(" ", (x + dx).cast("string"), (y + dy).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(4, 0), corner(4, 2), corner(0, 2), corner(0, 0)), F.lit("))"))
    centre = measures.ring_centroid(wkt)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), half_up(centre["lng"], 6).alias("lng"), half_up(centre["lat"], 6).alias("lat"))


# Fills from measurement mirrors

_PANEL = """p AS (SELECT l_orderkey AS id, max(strftime(l_shipdate, '%Y')) AS y,
CASE WHEN max(l_quantity) - min(l_quantity) <= 20 THEN arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity, l_tax, l_discount)) END AS pc,
CASE WHEN max(l_tax) - min(l_tax) <= 0.05 THEN arg_min(l_tax, (l_linenumber, l_partkey, l_quantity, l_tax, l_discount)) END AS pp,
CASE WHEN max(x) - min(x) <= 0.05 THEN arg_min(x, (l_linenumber, l_partkey, l_quantity, l_tax, l_discount)) FILTER (WHERE x IS NOT NULL) END AS px,
CASE WHEN count(DISTINCT u) = 1 THEN min(u) END AS u, count(DISTINCT c) AS cs, min(c) AS c
FROM (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_discount END AS x, CASE l_returnflag WHEN 'A' THEN 'mg/kg' WHEN 'R' THEN 'mg/l' END AS u,
CASE WHEN l_partkey % 2 = 0 THEN '単純温泉' WHEN l_partkey % 4 = 1 THEN '謎泉' END AS c FROM lineitem) GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 40.0::DOUBLE END AS celsius, CASE WHEN o_orderkey % 3 <> 0 THEN 7.0::DOUBLE END AS ph, CASE WHEN o_orderkey % 2 <> 0 THEN 100.0::DOUBLE END AS chloride,
CASE WHEN o_orderkey % 7 = 0 THEN 'chloride' END AS types, CASE WHEN o_orderkey % 4 = 0 THEN '1990' END AS measured_at, o_orderkey % 6 = 3 AS held_ph, o_orderkey % 11 = 3 AS held_types FROM orders),
j AS (SELECT r.*, p.* EXCLUDE (id), p.id IS NOT NULL AS m, p.id IS NOT NULL AND cs = 1 AND types IS NULL AND c = '単純温泉' AND NOT held_types AS wt FROM r LEFT JOIN p USING (id)),
w AS (SELECT *, m AND pc IS NOT NULL AND celsius IS NULL AS wc, m AND pp IS NOT NULL AND ph IS NULL AND NOT held_ph AS wp, m AND u IS NOT NULL AND px IS NOT NULL AND chloride IS NULL AS wx FROM j)"""


def _panel(spark, sf_dir):
    """Orders as records, their lines as wells, some fields claimed."""
    k, part = F.col("o_orderkey"), F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem")
    wells = lines.select(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("celsius"), F.col("l_tax").alias("ph"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("chloride"),
        F.when(F.col("l_returnflag") == "A", "mg/kg").when(F.col("l_returnflag") == "R", "mg/l").alias("unit"), F.year("l_shipdate").cast("string").alias("year"),
        F.when(part % 2 == 0, "単純温泉").when(part % 4 == 1, "謎泉").alias("class"), F.struct("l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount").alias("at"),
    )
    orders = table(spark, sf_dir, "orders")
    records = orders.select(
        k.alias("id"), F.when(k % 5 != 0, 40.0).alias("celsius"), F.when(k % 3 != 0, 7.0).alias("ph"), F.when(k % 2 != 0, 100.0).alias("chloride"),
        F.when(k % 7 == 0, F.array(F.lit("chloride"))).alias("types"), F.lit(None).cast("string").alias("unit"), F.when(k % 4 == 0, "1990").alias("measured_at"),
    )
    claim = lambda rest, n, field, value, state: F.when(k % n == rest, F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(state).alias("state")))
    some = F.array_compact(F.array(claim(3, 6, "ph", "6.5", "active"), claim(2, 9, "celsius", "50", "retracted"), claim(3, 11, "types", "chloride", "active")))
    claims = orders.select(k.alias("id"), F.inline(some))
    panel = fills.agreed_panel(wells, F.col("at"), {"celsius": 20, "ph": 0.05, "chloride": 0.05})
    return fills.fill_panel(records, panel, fills.held_fields(claims), ("celsius", "ph", "chloride"))


@query(f"""WITH {_PANEL} SELECT id, CASE WHEN wc THEN pc ELSE celsius END AS celsius, CASE WHEN wp THEN pp ELSE ph END AS ph, CASE WHEN wx THEN px ELSE chloride END AS chloride,
CASE WHEN wt THEN 'simple' ELSE types END AS types, CASE WHEN wx OR wt THEN u END AS unit, CASE WHEN measured_at IS NULL AND (wp OR wx OR wt) THEN y ELSE measured_at END AS measured_at,
concat_ws(',', CASE WHEN wc THEN 'celsius' END, CASE WHEN wp THEN 'ph' END, CASE WHEN wx THEN 'chloride' END, CASE WHEN wt THEN 'types' END) AS written,
CASE WHEN held_types AND types IS NULL AND cs = 1 AND c = '単純温泉' THEN 'simple' END AS contest FROM w""")
def panel_fill(spark, sf_dir):
    return _panel(spark, sf_dir).withColumns({"types": F.array_join("types", ","), "written": F.array_join("written", ","), "contest": F.array_join("contest", ",")}).drop("withheld")


@query(f"""WITH {_PANEL} SELECT id, 'celsius' AS field, '{fills.DISAGREE}' AS reason FROM w WHERE m AND pc IS NULL
UNION ALL SELECT id, 'ph', '{fills.DISAGREE}' FROM w WHERE m AND pp IS NULL
UNION ALL SELECT id, 'chloride', CASE WHEN u IS NULL THEN '{fills.NO_UNIT}' ELSE '{fills.DISAGREE}' END FROM w WHERE m AND (u IS NULL OR px IS NULL)
UNION ALL SELECT id, 'types', CASE WHEN cs > 1 THEN 'wells disagree on 泉質' ELSE '泉質 not fully understood: "謎"' END FROM w WHERE m AND (cs > 1 OR (cs = 1 AND types IS NULL AND NOT held_types AND c = '謎泉'))""")
def panel_withheld(spark, sf_dir):
    return fills.withheld_rows(_panel(spark, sf_dir))


@query("""SELECT id, c AS celsius, floor((c * 9 / 5 + 32) * 10 + 0.5) / 10 AS fahrenheit, CASE WHEN outcome = 'filled' THEN '2001' END AS measured_at, outcome FROM (
SELECT *, CASE WHEN outcome = 'filled' THEN reading ELSE celsius END AS c FROM (
SELECT id, celsius, reading, CASE WHEN reading IS NULL THEN NULL WHEN id % 7 = 0 THEN 'deferred' WHEN celsius IS NULL THEN 'filled' WHEN celsius <> reading THEN 'conflict' ELSE 'same' END AS outcome
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 50)::DOUBLE END AS celsius FROM orders) LEFT JOIN (SELECT p_partkey AS id, p_size::DOUBLE AS reading FROM part) USING (id)))""")
def temperature_fill(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    records = orders.select(k.alias("id"), F.when(k % 5 != 0, (k % 50).cast("double")).alias("celsius"), F.lit(None).cast("string").alias("measured_at"))
    readings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("reading"), F.lit("2001").alias("read_at"))
    claims = orders.select(k.alias("id"), F.lit("celsius").alias("field"), F.lit("50").alias("value"), F.when(k % 7 != 0, "retracted").alias("state"))
    return fills.fill_temperature(records, readings, fills.held_fields(claims))
