"""The registered queries over the derived tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse, text
from ..functions.geo import half_up
from ..operators import cluster, dedupe, overlay, registry, rules, spatial
from .search import Filters, search
from .tables import SPRINGS_SQL, STATIONS_SQL, metres_sql, springs, stations, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL if it has any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


SPRINGS = f"WITH RECURSIVE {SPRINGS_SQL}"
BOTH = f"{SPRINGS}, {STATIONS_SQL}"
D, D_STATION = metres_sql("a", "b"), metres_sql("a", "b", "r_lat", "r_lng")
#: A box that holds all points within the radius named, for joins in SQL.
NEAR = "abs(a.lat - b.lat) < 0.006 AND abs(a.lng - b.lng) < 0.012"
NEAR_STATION = "abs(a.lat - b.r_lat) < 0.02 AND abs(a.lng - b.r_lng) < 0.03"


# Filters, search, ranking


@query(f"""{SPRINGS} SELECT id, name, country, completeness FROM springs
WHERE (celsius IS NULL OR (celsius >= 30 AND celsius <= 60)) AND price = 'Free' AND kind IN ('hot_spring', 'onsen') AND contains(lower(name || ' ' || country || ' ' || region), 'spring 4')
ORDER BY completeness DESC, id LIMIT 60""")
def filter_search_topk(spark, sf_dir):
    chosen = Filters(least_c=30, most_c=60, price="free", types=("hot_spring", "onsen"), query=" Spring 4")
    return search(springs(spark, sf_dir), chosen).select("id", "name", "country", "completeness")


@query(f"""{SPRINGS}, b AS (SELECT 31.0::DOUBLE AS lat, -119.9::DOUBLE AS lng)
SELECT id, metres FROM (SELECT a.id, floor({D} + 0.5)::BIGINT AS metres FROM springs a, b WHERE a.hours = 'open') ORDER BY metres, id LIMIT 60""")
def near_me_topk(spark, sf_dir):
    return search(springs(spark, sf_dir), Filters(open_now=True), near=(31.0, -119.9)).select("id", "metres")


@query(f"{SPRINGS} SELECT completeness, count(*) AS n, count(celsius) AS with_temperature FROM springs GROUP BY completeness")
def completeness_score(spark, sf_dir):
    return springs(spark, sf_dir).groupBy("completeness").agg(F.count("*").alias("n"), F.count("celsius").alias("with_temperature"))


@query(f"""{SPRINGS} SELECT CASE WHEN celsius IS NULL THEN 'unknown' WHEN celsius < 30 THEN 'cool' WHEN celsius < 38 THEN 'warm' WHEN celsius < 43 THEN 'hot' WHEN celsius < 50 THEN 'very hot' ELSE 'scalding' END AS band,
count(*) AS n, avg(celsius) AS mean_c, max(floor((celsius * 9 / 5 + 32) * 10 + 0.5) / 10) AS most_f FROM springs GROUP BY band""")
def temp_bands(spark, sf_dir):
    rows = springs(spark, sf_dir).withColumn("band", parse.temp_band(F.col("celsius")))
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.avg("celsius").alias("mean_c"), F.max(parse.fahrenheit(F.col("celsius"))).alias("most_f"))


@query(f"""{SPRINGS} SELECT country, count(*) AS n, count(celsius) AS temperature, sum((coalesce(price, '') <> '')::INT)::BIGINT AS price, sum((policy <> 'unknown')::INT)::BIGINT AS clothing,
sum((hours <> 'unknown')::INT)::BIGINT AS hours, floor(100.0::DOUBLE * count(celsius) / count(*) + 0.5)::BIGINT AS percent_known FROM springs GROUP BY country""")
def country_summary(spark, sf_dir):
    said = F.coalesce(F.col("price"), F.lit("")) != ""
    return springs(spark, sf_dir).groupBy("country").agg(
        F.count("*").alias("n"), F.count("celsius").alias("temperature"), F.count_if(said).alias("price"), F.count_if(F.col("policy") != "unknown").alias("clothing"),
        F.count_if(F.col("hours") != "unknown").alias("hours"), half_up(100.0 * F.count("celsius") / F.count("*")).alias("percent_known"),
    )


@query(f"""{SPRINGS} SELECT country, rank::INT AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY name IS NULL, completeness DESC, id) AS rank FROM springs) WHERE rank <= 5""")
def flagship_top5(spark, sf_dir):
    order = W.partitionBy("country").orderBy(F.col("name").isNull(), F.desc("completeness"), "id")
    return springs(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("country", "rank", "id")


# Record linkage

_PAIRS = f"pairs AS (SELECT a.id, b.station, a.celsius, b.reading, floor({D_STATION} + 0.5)::BIGINT AS metres FROM springs a JOIN stations b ON {NEAR_STATION} AND {D_STATION} <= 200)"


def _verdicts(source: str) -> str:
    return f"""mine AS (SELECT *, count(*) OVER (PARTITION BY id) AS m FROM {source}),
theirs AS (SELECT *, count(CASE WHEN m = 1 THEN 1 END) OVER (PARTITION BY station) AS t FROM mine),
judged AS (SELECT *, CASE WHEN m > 1 THEN 'many_right' WHEN t > 1 THEN 'claimed' ELSE 'matched' END AS verdict FROM theirs)"""


@query(f"{BOTH}, {_PAIRS}, gaps AS (SELECT * FROM pairs WHERE celsius IS NULL), {_verdicts('gaps')} SELECT id, station, metres, reading, verdict FROM judged")
def radius_contention(spark, sf_dir):
    unmeasured = springs(spark, sf_dir).where("celsius is null")
    pairs = spatial.radius_join(unmeasured, stations(spark, sf_dir), 200)
    return spatial.unique_both_ways(pairs, "id", "station").select("id", "station", "metres", "reading", "verdict")


@query(f"""{BOTH}, {_PAIRS}, counted AS (SELECT *, count(*) OVER (PARTITION BY station) AS near FROM pairs)
SELECT id, station, celsius, reading, abs(celsius - reading) <= 2 AS corroborated FROM counted WHERE near = 1 AND celsius IS NOT NULL""")
def corroboration(spark, sf_dir):
    pairs = spatial.radius_join(springs(spark, sf_dir), stations(spark, sf_dir), 200)
    alone = pairs.withColumn("_near", F.count("*").over(W.partitionBy("station"))).where("_near = 1 and celsius is not null")
    return alone.select("id", "station", "celsius", "reading", (F.abs(F.col("celsius") - F.col("reading")) <= 2).alias("corroborated"))


@query(f"""{BOTH}, pairs AS (SELECT a.id, b.station, {D_STATION} AS d FROM springs a JOIN stations b ON {NEAR_STATION}),
best AS (SELECT station, arg_min(id, (d, id)) AS id, floor(min(d) + 0.5)::BIGINT AS metres FROM pairs WHERE d <= 200 GROUP BY station),
judged AS (SELECT *, count(*) OVER (PARTITION BY id) AS wanted FROM best)
SELECT station, id, metres, CASE WHEN wanted > 1 THEN 'claimed' ELSE 'matched' END AS verdict FROM judged""")
def nearest_match(spark, sf_dir):
    rows = stations(spark, sf_dir).withColumnsRenamed({"r_lat": "lat", "r_lng": "lng"})
    right = springs(spark, sf_dir).select("id", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    nearest = spatial.nearest_within(rows, right, "station", F.col("id"), 200)
    verdict = F.when(F.count("*").over(W.partitionBy("id")) > 1, "claimed").otherwise("matched")
    return nearest.select("station", "id", "metres", verdict.alias("verdict"))


@query(f"""{SPRINGS}, named AS (SELECT id, lat, lng, CASE WHEN id % 6 <> 0 THEN (id // 4)::VARCHAR ELSE '' END AS key FROM springs),
pairs AS (SELECT a.id AS pin, b.id AS target, floor({D} + 0.5)::BIGINT AS metres FROM named a JOIN named b ON a.key = b.key AND length(a.key) >= 3 AND a.id % 11 = 0 AND b.id % 11 <> 0 AND {D} <= 1500),
mine AS (SELECT *, count(*) OVER (PARTITION BY pin) AS m FROM pairs), theirs AS (SELECT *, count(CASE WHEN m = 1 THEN 1 END) OVER (PARTITION BY target) AS t FROM mine)
SELECT pin, target, metres, CASE WHEN m > 1 THEN 'many_right' WHEN t > 1 THEN 'claimed' ELSE 'matched' END AS verdict FROM theirs""")
def coarse_name_bind(spark, sf_dir):
    name = F.when(F.col("id") % 6 != 0, F.concat(F.lit("The Hot Spring "), F.floor(F.col("id") / 4).cast("string")))
    named = springs(spark, sf_dir).select("id", "lat", "lng", text.identity_name(name).alias("key")).where("length(key) >= 3")
    pins, others = named.where("id % 11 = 0"), named.where("id % 11 <> 0").select(F.col("id").alias("target"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), F.col("key").alias("r_key"))
    # the grid carries the join: a common name alone would be a hot key
    pairs = spatial.radius_join(pins, others, 1500, spread="left").where("key = r_key").withColumnRenamed("id", "pin")
    return spatial.unique_both_ways(pairs, "pin", "target").select("pin", "target", "metres", "verdict")


_BOXES = """boxes(manager, ord, status, bathing, warning, west, south, east, north) AS (VALUES
('north', 1, 'permit', NULL, 'Stay on the paths', -120.0::DOUBLE, 30.0::DOUBLE, -119.5::DOUBLE, 31.2::DOUBLE),
('middle', 2, 'view-only', true, 'Ask first', -120.0::DOUBLE, 30.5::DOUBLE, -119.9::DOUBLE, 34.0::DOUBLE),
('south', 3, 'closed', false, 'No bathing', -120.0::DOUBLE, 31.0::DOUBLE, -119.99::DOUBLE, 36.0::DOUBLE))"""


def _boxes(spark):
    rows = [("north", 1, "permit", None, "Stay on the paths", -120.0, 30.0, -119.5, 31.2), ("middle", 2, "view-only", True, "Ask first", -120.0, 30.5, -119.9, 34.0), ("south", 3, "closed", False, "No bathing", -120.0, 31.0, -119.99, 36.0)]
    return spark.createDataFrame(rows, "manager string, ord int, status string, bathing boolean, warning string, west double, south double, east double, north double")


@query(f"""{SPRINGS}, {_BOXES}, hit AS (SELECT s.id, b.* FROM springs s JOIN boxes b ON s.lat BETWEEN b.south AND b.north AND s.lng BETWEEN b.west AND b.east)
SELECT id, arg_max(status, CASE status WHEN 'unknown' THEN 1 WHEN 'public' THEN 2 WHEN 'permit' THEN 3 WHEN 'view-only' THEN 4 ELSE 5 END) AS status,
CASE WHEN bool_or(NOT bathing) THEN false ELSE arg_min(bathing, ord) FILTER (bathing IS NOT NULL) END AS bathing, string_agg(warning, '; ' ORDER BY ord) AS warnings FROM hit GROUP BY id""")
def bbox_restrict(spark, sf_dir):
    return rules.restrict(springs(spark, sf_dir), _boxes(spark))


@query(f"""{BOTH}, pairs AS (SELECT a.station, b.id, {metres_sql('b', 'a', 'r_lat', 'r_lng')} AS d FROM stations a JOIN springs b ON b.completeness >= 67),
best AS (SELECT station, arg_min(id, (d, id)) AS nearest, floor(min(d) + 0.5)::BIGINT AS metres FROM pairs GROUP BY station) SELECT * FROM best WHERE metres > 300""")
def gap_worklist(spark, sf_dir):
    points = stations(spark, sf_dir).withColumnsRenamed({"r_lat": "lat", "r_lng": "lng"})
    have = springs(spark, sf_dir).where("completeness >= 67").select(F.col("id").alias("nearest"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    return spatial.gaps(points, have, 300, "station", "nearest")


_SITES = f"""edges AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM springs a JOIN springs b ON {NEAR} AND a.id <> b.id AND {D} <= 500),
reach(id, root) AS (SELECT id, id FROM springs UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.id),
labels AS (SELECT id, min(root) AS site FROM reach GROUP BY id), sized AS (SELECT *, count(*) OVER (PARTITION BY site) AS springs FROM labels)"""


@query(f"{SPRINGS}, {_SITES} SELECT id, site, springs FROM sized")
def sites_single_linkage(spark, sf_dir):
    return cluster.sites(springs(spark, sf_dir)).select("id", "site", "springs")


@query(f"{SPRINGS}, {_SITES} SELECT country, count(DISTINCT site) AS sites, count(*) AS n FROM sized JOIN springs USING (id) GROUP BY country".replace("AS springs FROM labels", "AS size FROM labels"))
def distinct_sites(spark, sf_dir):
    points = springs(spark, sf_dir).where("id is not null").select("id", "lat", "lng", "country")
    return cluster.labelled(points).groupBy("country").agg(F.countDistinct("site").alias("sites"), F.count("*").alias("n"))


@query(f"""{SPRINGS}, {_SITES}, pairs AS (SELECT a.id, b.id AS mate, floor({D} + 0.5)::BIGINT AS metres FROM springs a JOIN springs b ON a.id <> b.id AND a.id % 50 = 0 JOIN labels x ON x.id = a.id JOIN labels y ON y.id = b.id AND x.site = y.site)
SELECT id, mate, metres, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, mate) AS rank FROM pairs) WHERE rank <= 6""".replace("AS springs FROM labels", "AS size FROM labels"))
def place_mates(spark, sf_dir):
    from ..functions.geo import distance_m

    labelled = cluster.labelled(springs(spark, sf_dir).select("id", "lat", "lng"))
    mates = labelled.select(F.col("id").alias("mate"), "site", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    metres = half_up(distance_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))).cast("long")
    pairs = labelled.where("id % 50 = 0").join(mates.hint("merge"), "site").where("id <> mate").withColumn("metres", metres)
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("metres", "mate"))).where("rank <= 6").select("id", "mate", "metres", "rank")


def _records(spark, sf_dir):
    return springs(spark, sf_dir).select("id", F.col("id").alias("ord"), "lat", "lng", text.norm_name(F.col("name"), ascii_only=True).alias("norm"), F.col("element").alias("kind"), "completeness", "celsius", "price")


@query(f"""{SPRINGS}, near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {D} AS d FROM springs a JOIN springs b ON {NEAR} AND a.id < b.id AND {D} <= 300),
norm AS (SELECT id, element, replace(lower(coalesce(name, '')), ' ', '') AS n FROM springs)
SELECT a, b, floor(d + 0.5)::BIGINT AS metres FROM near JOIN norm x ON x.id = a JOIN norm y ON y.id = b WHERE CASE
WHEN x.n <> '' AND x.n = y.n THEN d <= 300
WHEN x.n <> '' AND y.n <> '' THEN (contains(x.n, y.n) OR contains(y.n, x.n)) AND d <= CASE WHEN least(length(x.n), length(y.n)) <= 4 THEN 12 ELSE 60 END
WHEN x.n <> '' OR y.n <> '' THEN x.element <> y.element AND d <= 60 ELSE d <= 12 END""")
def same_spring_pairs(spark, sf_dir):
    return dedupe.pairs_of_one_spring(_records(spark, sf_dir))


@query()
def dedupe_survivors(spark, sf_dir):
    records = _records(spark, sf_dir)
    folded = records.join(dedupe.survivors(records).hint("merge"), "id")
    return dedupe.merged(folded, ["celsius", "price"])


# Rules, ids, overlays


@query(f"""{SPRINGS}, r(rule, ord, country, west, south, east, north, pattern, banned) AS (VALUES
('box', 1, 'C3', -120.0::DOUBLE, 30.0::DOUBLE, -119.0::DOUBLE, 33.0::DOUBLE, NULL, []), ('name', 2, 'C3', NULL, NULL, NULL, NULL, '(?i)spring 2[0-9]$', []), ('all', 3, 'C4', NULL, NULL, NULL, NULL, NULL, [4, 29]))
SELECT s.id, arg_min(r.rule, r.ord) AS rule FROM springs s JOIN r ON s.country = r.country AND (r.west IS NULL OR (s.lat BETWEEN r.south AND r.north AND s.lng BETWEEN r.west AND r.east))
AND (r.pattern IS NULL OR regexp_matches(coalesce(s.name, ''), r.pattern)) AND NOT list_contains(r.banned, s.id) GROUP BY s.id""")
def rule_priority(spark, sf_dir):
    rows = [("box", 1, "C3", -120.0, 30.0, -119.0, 33.0, None, None), ("name", 2, "C3", None, None, None, None, "(?i)spring 2[0-9]$", None), ("all", 3, "C4", None, None, None, None, None, [4, 29])]
    listed = spark.createDataFrame(rows, "rule string, ord int, country string, west double, south double, east double, north double, pattern string, except array<long>")
    return rules.first_rule(springs(spark, sf_dir), listed).where("rule is not null").select("id", "rule")


@query(f"""{SPRINGS}, b AS (SELECT 31.0::DOUBLE AS lat, -119.99::DOUBLE AS lng)
SELECT count(*) AS n, sum(a.id)::BIGINT AS ids FROM springs a, b WHERE NOT ({D} <= 1000) AND NOT coalesce(regexp_matches(a.name, '(?i)spring 1[0-4]$'), false) AND a.id NOT IN (7, 8)""")
def privacy_filter(spark, sf_dir):
    exclusions = spark.createDataFrame([("node/7", None, None, None), ("node/8", None, None, None), (None, 31.0, -119.99, None), (None, None, None, "spring 1[0-4]$")], "ref string, ex_lat double, ex_lng double, pattern string")
    records = springs(spark, sf_dir).withColumn("refs", F.array(F.concat(F.lit("node/"), F.col("id").cast("string"))))
    return rules.without_private(records, exclusions).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT o_orderkey, 'whs_' || substr(sha256('node/' || o_orderkey), 1, 12) AS spring FROM orders")
def mint_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.mint_id(F.concat(F.lit("node/"), F.col("o_orderkey").cast("string"))).alias("spring"))


@query("""WITH r AS (SELECT c_custkey AS key, 'node/' || c_custkey AS a, 'way/' || (c_custkey // 2) AS b, min(c_custkey) OVER (PARTITION BY c_custkey // 2) AS first FROM customer),
g AS (SELECT 'known_' || c_custkey AS spring, c_custkey AS entry, 'way/' || c_custkey AS ref FROM customer WHERE c_custkey % 3 = 0)
SELECT r.key, coalesce(g.spring, 'whs_' || substr(sha256('node/' || r.first), 1, 12)) AS spring, CASE WHEN g.spring IS NULL AND r.first = r.key THEN 'minted' ELSE 'known' END AS how FROM r LEFT JOIN g ON g.ref = r.b""")
def registry_resolve(spark, sf_dir):
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    records = customers.select(c.alias("key"), F.array(F.concat(F.lit("node/"), c.cast("string")), F.concat(F.lit("way/"), F.floor(c / 2).cast("string"))).alias("refs"))
    have = customers.where(c % 3 == 0).select(F.concat(F.lit("known_"), c.cast("string")).alias("spring"), c.alias("entry"), F.array(F.concat(F.lit("way/"), c.cast("string"))).alias("refs"))
    return registry.resolve(records, have).select("key", "spring", "how")


@query("""SELECT coalesce(o.k, n.k) AS spring, CASE WHEN o.k IS NULL THEN 'spring.appeared' WHEN n.k IS NOT NULL AND o.m IS NOT NULL THEN 'spring.returned' WHEN n.k IS NULL AND o.m IS NULL THEN 'spring.disappeared' END AS type, '2026-02-01' AS ts
FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '2026-01-01' END AS m FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) n ON o.k = n.k
WHERE type IS NOT NULL""")
def registry_lifecycle(spark, sf_dir):
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    old = customers.where(k % 3 != 0).select(k.alias("spring"), F.lit("2025-01-01").alias("first_seen"), F.lit("2025-12-01").alias("last_seen"), F.when(k % 7 == 0, "2026-01-01").alias("missing_since"))
    return registry.lifecycle(old, customers.where(k % 5 != 0).select(k.alias("spring")), "2026-02-01")[1]


def _claims(spark, sf_dir):
    """Two claims a tenth spring: a temperature, and tags or a price."""
    k = F.col("id")
    base = springs(spark, sf_dir).where(k % 10 == 3).select("id")
    temperature = base.select("id", F.lit("temperature.celsius").alias("field"), (20 + (k * 13) % 70 + (k % 3) * 0.4).cast("string").alias("value"))
    other = base.select("id", F.when(k % 20 == 3, "access.price").otherwise("tags").alias("field"), F.when(k % 20 == 3, "7 EUR").otherwise("clean|quiet").alias("value"))
    url = F.when(k % 4 == 3, "https://springs.museum/p").otherwise("http://springs.museum/p")
    return temperature.unionByName(other).withColumns({"source": url, "contributor": F.when(k % 9 != 0, "ann"), "state": F.when(k % 13 != 0, "active").otherwise("superseded")})


_CLAIMS = """b AS (SELECT id, id % 13 <> 0 AS active, 20 + (id * 13) % 70 + (id % 3) * 0.4::DOUBLE AS c, CASE WHEN id % 20 = 3 THEN '7 EUR' END AS p, CASE WHEN id % 20 <> 3 THEN ['clean', 'quiet'] END AS t FROM springs WHERE id % 10 = 3)"""


def _tagged(spark, sf_dir):
    return springs(spark, sf_dir).select("id", "celsius", "price", F.array(F.lit("clean"), F.col("kind")).alias("tags"))


@query(f"""{SPRINGS}, {_CLAIMS} SELECT s.id, coalesce(b.c, s.celsius) AS celsius, floor((coalesce(b.c, s.celsius) * 9 / 5 + 32) * 10 + 0.5) / 10 AS fahrenheit, coalesce(b.p, s.price) AS price,
CASE WHEN b.t IS NOT NULL THEN 'clean,' || s.kind || ',quiet' ELSE 'clean,' || s.kind END AS tags, b.id IS NOT NULL AS curated FROM springs s LEFT JOIN b ON b.id = s.id AND b.active""")
def overlay_apply(spark, sf_dir):
    return overlay.apply(_tagged(spark, sf_dir), _claims(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@query(f"""{SPRINGS}, {_CLAIMS} SELECT id, 'temperature.celsius' AS field FROM b JOIN springs s USING (id) WHERE b.active AND abs(b.c - s.celsius) > 0.5
UNION ALL SELECT id, 'access.price' FROM b JOIN springs s USING (id) WHERE b.active AND b.p <> s.price AND s.price <> '' UNION ALL SELECT id, 'tags' FROM b WHERE active AND t IS NOT NULL""")
def overlay_contests(spark, sf_dir):
    return overlay.contests(_tagged(spark, sf_dir), _claims(spark, sf_dir)).select("id", "field")


@query(f"""{SPRINGS}, {_CLAIMS}, e AS (SELECT id, concat_ws('; ', CASE WHEN id % 6 = 1 THEN 'unknown id' END, CASE WHEN id % 4 <> 3 THEN 'source is no public https URL' END, CASE WHEN id % 9 = 0 THEN 'no contributor' END) AS errors FROM b)
SELECT id, unnest(['temperature.celsius', CASE WHEN id % 20 = 3 THEN 'access.price' ELSE 'tags' END]) AS field, errors FROM e WHERE errors <> ''""")
def overlay_errors(spark, sf_dir):
    return overlay.errors(_claims(spark, sf_dir), springs(spark, sf_dir).where("id % 6 <> 1"))


@query("""SELECT l_orderkey, CASE WHEN max(l_quantity) - min(l_quantity) <= 20 THEN arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity)) END AS agreed, count(l_quantity) AS n FROM lineitem GROUP BY l_orderkey""")
def agreement_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_quantity"))
    return overlay.agreed(rows, "l_orderkey", "l_quantity", "at", 20)


# Events


_EVENTS = "e AS (SELECT event_id, ts, event_type AS type, user_id AS spring, user_id % 5 AS path, floor(value)::BIGINT AS x FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("type"), F.col("user_id").alias("spring"), (F.col("user_id") % 5).alias("path"), F.floor("value").alias("to"))


@query(f"""WITH {_EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY type, spring, path, x ORDER BY ts, event_id) AS k FROM e WHERE event_id % 3 <> 0)
SELECT event_id FROM f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM e h WHERE h.event_id % 3 = 0 AND h.type = f.type AND h.spring = f.spring AND h.path = f.path AND h.x IS NOT DISTINCT FROM f.x)""")
def events_dedup_append(spark, sf_dir):
    events = _events(spark, sf_dir)
    return registry.new_events(events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0")).select("event_id")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events""")
def rate_window_60s(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("count(*) over (partition by user_id order by ts range between interval '59.999999' second preceding and current row)").alias("n"))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS claims, CASE WHEN count(*) > 100 THEN 'over the cap' WHEN count(*) > 25 THEN 'slow down' ELSE 'ok' END AS verdict FROM events GROUP BY ALL""")
def daily_budget(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n.alias("claims"), F.when(n > 100, "over the cap").when(n > 25, "slow down").otherwise("ok").alias("verdict"))


# Text


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?(</script\s*>|\z)', ' ', 'g'), '(?is)<style\b[^>]*>.*?(</style\s*>|\z)', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?(</noscript\s*>|\z)', ' ', 'g'), '(?is)<template\b[^>]*>.*?(</template\s*>|\z)', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&deg;', '°', 'g'), '(?i)&amp;', '&', 'g') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[\s\x{A0}\x{3000}]+', ' ', 'g')) AS body FROM b""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@query()
def value_in_text(spark, sf_dir):
    """Whether each document states its own number of tens of characters; the pattern needs lookaround."""
    value = (F.col("doc_id") % 40).cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", text.value_appears(value, F.col("text")).alias("found"), text.word_appears(F.lit("license"), F.col("text")).alias("licensed"))


KEYWORDS = ("the", "und", "la", "that", "de")
_LIST = ", ".join(f"'{k}'" for k in KEYWORDS)


@query(f"""WITH w AS (SELECT doc_id, string_split(lower(text), ' ') AS words FROM documents), p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w),
h AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 39 FOLLOWING) AS n FROM p WHERE word IN ({_LIST}))
SELECT doc_id, max(n) AS hits, arg_min(pos, (-n, pos))::INT AS start FROM h GROUP BY doc_id""")
def densest_excerpt(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word"))
    hits = words.where(F.col("word").isin(*KEYWORDS))
    counted = hits.withColumn("n", F.count("*").over(W.partitionBy("doc_id").orderBy("pos").rangeBetween(0, 39)))
    return counted.groupBy("doc_id").agg(F.max("n").alias("hits"), F.min_by("pos", F.struct((-F.col("n")).alias("n"), "pos")).alias("start"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '', 'g') AS norm FROM part")
def norm_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.norm_name(F.col("p_name")).alias("norm"))


@query("""WITH r AS (SELECT event_id, event_id % 97 AS v, event_id % 7 AS m FROM events)
SELECT event_id, CASE m WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v + 5 WHEN 3 THEN floor((v + 68) * 5::DOUBLE / 9 * 10 + 0.5) / 10 WHEN 5 THEN v + 0.5 END::DOUBLE AS celsius, m = 2 AS is_range, CASE WHEN m = 4 THEN 'very hot' END AS qualitative FROM r""")
def parse_temperature(spark, sf_dir):
    v, m = (F.col("event_id") % 97), F.col("event_id") % 7
    s = v.cast("string")
    raw = (
        F.when(m == 0, s).when(m == 1, F.concat(F.lit("~"), s, F.lit(" °C"))).when(m == 2, F.concat(s, F.lit(" - "), (v + 5).cast("string")))
        .when(m == 3, F.concat((v + 100).cast("string"), F.lit(" F"))).when(m == 4, "Very hot!").when(m == 5, F.concat(s, F.lit(",5 C")))
    )
    parsed = table(spark, sf_dir, "events").select("event_id", parse.parse_temperature(raw).alias("t"))
    return parsed.select("event_id", "t.celsius", F.coalesce("t.is_range", F.lit(False)).alias("is_range"), "t.qualitative")


def _fraction(share: Column) -> Column:
    """The nearest whole / part with part at most ten; the smallest part at a tie."""
    options = [F.struct(F.abs(share - float(w) / p).alias("gap"), F.lit(p).alias("part"), F.lit(w).alias("whole")) for p in range(2, 11) for w in range(1, p)]
    return F.array_min(F.array(*options))


@query("""WITH s AS (SELECT o_orderstatus, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1),
f AS (SELECT p, w FROM range(2, 11) a(p), range(1, 10) b(w) WHERE w < p)
SELECT o_orderstatus, share, (arg_min(w, (abs(share - w::DOUBLE / p), p, w)))::INT AS whole, (arg_min(p, (abs(share - w::DOUBLE / p), p, w)))::INT AS part FROM s, f GROUP BY ALL""")
def share_fraction(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    shares = counts.select("o_orderstatus", (F.col("n").cast("double") / F.sum("n").over(W.partitionBy())).alias("share"))
    return shares.withColumn("f", _fraction(F.col("share"))).select("o_orderstatus", "share", "f.whole", "f.part")


@query(r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#@]+)([/:?#]|$)', 1)) AS host FROM pages)
SELECT page_id, host, starts_with(url, 'https://') AND contains(host, '.') AND NOT regexp_matches(host, '(^|\.)(localhost|local|internal|test|example|invalid)$') AND NOT regexp_matches(host, '^[0-9.]+$') AS sound FROM h""")
def url_checks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"), parse.sound_url(F.col("url")).alias("sound"))


# Coverage


@query("""SELECT n_name, count(c_custkey) AS candidates, count(CASE WHEN c_acctbal > 9000 THEN 1 END) AS verified, greatest(0, least(2, count(c_custkey)) - count(CASE WHEN c_acctbal > 9000 THEN 1 END)) AS unmet
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def coverage_unmet(spark, sf_dir):
    # counted by key before the join: a nation may hold a third of all customers
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.count_if(F.col("c_acctbal") > 9000).alias("v"))
    c, v = F.coalesce("c", F.lit(0)), F.coalesce("v", F.lit(0))
    joined = table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("n_name", c.alias("candidates"), v.alias("verified"), F.greatest(F.lit(0), F.least(F.lit(2), c) - v).cast("long").alias("unmet"))


@query("""SELECT n_name, (n_nationkey * 10 + 5)::INT AS official, count(s_suppkey) AS ours, floor(count(s_suppkey)::DOUBLE / (n_nationkey * 10 + 5) * 100 + 0.5) / 100 AS ratio FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey""")
def inventory_ratio(spark, sf_dir):
    counts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    ours, official = F.coalesce("n", F.lit(0)), (F.col("n_nationkey") * 10 + 5).cast("int")
    joined = table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("n_name", official.alias("official"), ours.alias("ours"), half_up(ours.cast("double") / official, 2).alias("ratio"))


@query(f"""{SPRINGS} SELECT id, CASE WHEN lat >= 30.3 AND lat < 31.7 AND lng >= -119.99 AND lng < -119.98 AND NOT (lat >= 31 AND lat < 31.3) THEN 'west' WHEN lat >= 30 AND lat < 33 AND lng >= -120.005 AND lng < -119.975 THEN 'wide' END AS poly
FROM springs WHERE poly IS NOT NULL""")
def polygon_lookup(spark, sf_dir):
    """A box with a hole before a wider box that holds it."""
    shapes = [("west", 1, 0, -119.99, 30.3, -119.98, 31.7), ("west", 1, 1, -119.995, 31.0, -119.975, 31.3), ("wide", 2, 0, -120.005, 30.0, -119.975, 33.0)]
    boxes = {"west": (-119.99, 30.3, -119.98, 31.7), "wide": (-120.005, 30.0, -119.975, 33.0)}
    rows = []
    for poly, order, ring, w, s, e, n in shapes:
        corners = [(s, w), (s, e), (n, e), (n, w), (s, w)]
        rows += [(poly, order, ring, *a, *b, *boxes[poly]) for a, b in zip(corners, corners[1:], strict=False)]
    edges = spark.createDataFrame(rows, "poly string, ord int, ring int, lat1 double, lng1 double, lat2 double, lng2 double, west double, south double, east double, north double")
    return spatial.polygon_of(springs(spark, sf_dir), edges, "id").select("id", "poly")


from . import admission_queries, card_queries, claim_queries, field_queries, match_queries, registry_queries, scene_queries, summary_queries  # noqa: E402, F401  register their own
