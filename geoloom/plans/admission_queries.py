"""Registered queries of admission, countries, claims and reviewed lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, text
from ..operators import admission, claims, lists, spatial
from .queries import SPRINGS, _boxes, query
from .tables import springs, table

_NAMED = """rows AS (SELECT id, country, CASE id % 9 WHEN 0 THEN 'Hot Springs' WHEN 1 THEN 'Giant Geyser' WHEN 2 THEN 'Geyser Pool ' || id WHEN 3 THEN NULL WHEN 4 THEN 'Steam Vents' WHEN 5 THEN ' warm pool (hot)' ELSE 'Spring ' || id END AS name,
CASE WHEN id % 4 = 0 THEN floor(lat * 100) / 100 ELSE lat + 0.00003 END AS lat, lng + 0.00003 AS lng FROM springs)"""


def _rows(spark, sf_dir):
    k, s = F.col("id"), F.col("id").cast("string")
    name = F.when(k % 9 == 0, "Hot Springs").when(k % 9 == 1, "Giant Geyser").when(k % 9 == 2, F.concat(F.lit("Geyser Pool "), s)).when(k % 9 == 4, "Steam Vents").when(k % 9 == 5, " warm pool (hot)").when(k % 9 != 3, F.concat(F.lit("Spring "), s))
    return springs(spark, sf_dir).select("id", "country", name.alias("name"), F.when(k % 4 == 0, F.floor(F.col("lat") * 100) / 100).otherwise(F.col("lat") + 0.00003).alias("lat"), (F.col("lng") + 0.00003).alias("lng"))


_ADMITTED = f"""{_NAMED}, judged AS (SELECT id, country, CASE WHEN id % 9 IN (1, 4) THEN 'view-only feature' WHEN id % 9 IN (0, 3, 5) THEN 'generic or absent name'
WHEN id % 4 = 0 THEN 'coordinates coarser than 3 dp' WHEN lat BETWEEN 31 AND 36 AND lng BETWEEN -120.0 AND -119.99 THEN 'inside a no-bathing boundary' END AS reason FROM rows)"""


@query(f"{SPRINGS}, {_ADMITTED} SELECT id, reason FROM judged")
def admission_reasons(spark, sf_dir):
    return admission.admit(_rows(spark, sf_dir), _boxes(spark)).select("id", "reason")


@query(f"{SPRINGS}, {_ADMITTED} SELECT country, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY country ORDER BY n DESC, country LIMIT 5")
def rejects_top5(spark, sf_dir):
    return admission.reject_counts(admission.admit(_rows(spark, sf_dir), _boxes(spark)), "country")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'no geometry' WHEN p_partkey % 7 IN (1, 2) THEN 'access=private/no' WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 'geyser, not bathable' END AS reject,
CASE WHEN p_partkey % 3 = 1 AND p_partkey % 7 = 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 'identifier-style name ("C-' || p_partkey || '") with no other spring attributes' END AS suspect FROM part""")
def element_rejects(spark, sf_dir):
    k = F.col("p_partkey")
    said = {
        "natural": F.when(k % 3 == 0, "geyser").when(k % 3 == 1, "hot_spring"), "access": F.when(k % 7 == 1, "private").when(k % 7 == 2, "no").when(k % 7 == 3, "yes").when(k % 7 > 3, "customers"),
        "bath:type": F.when(k % 5 == 0, "onsen"), "addr:city": F.when(k % 11 == 0, "Town"), "name": F.when(k % 2 == 0, F.concat(F.lit("C-"), k.cast("string"))).otherwise("Blue"),
    }
    all_tags = F.create_map(*[x for key, v in said.items() for x in (F.lit(key), v)])
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.map_filter(all_tags, lambda _, v: v.isNotNull()).alias("tags"), F.when(k % 13 != 0, 1.0).alias("lat"))
    return rows.select("id", admission.element_reject(F.col("tags"), F.col("lat"), F.lit(1.0)).alias("reject"), admission.suspected_borehole(F.col("tags")).alias("suspect"))


@query("""WITH b AS (SELECT p_partkey AS k, p_partkey % 6 AS m FROM part)
SELECT k AS id, CASE WHEN m IN (0, 5) THEN (k % 90)::DOUBLE END AS celsius, CASE m WHEN 1 THEN 'boiling' WHEN 2 THEN 'warm' END AS qualitative,
CASE m WHEN 3 THEN 'no usable temperature' WHEN 4 THEN 'Fahrenheit and Celsius disagree: 500F vs ' || (k % 90) || 'C' END AS reason FROM b""")
def catalogue_lines(spark, sf_dir):
    k, c = F.col("p_partkey"), (F.col("p_partkey") % 90).cast("string")
    cell = F.when(k % 6 == 1, "b").when(k % 6 == 2, "W").when(k % 6 == 3, "n/a").otherwise(c)
    fahrenheit = F.when(k % 6 == 4, "500").when(k % 6 == 5, ((k % 90) * 9 / 5 + 32).cast("int").cast("string")).otherwise("x")
    lines = table(spark, sf_dir, "part").select(F.concat_ws("\t", F.lit("CA"), F.concat(F.lit("40."), k.cast("string")), F.lit("-120.5"), F.concat(F.lit("N"), k.cast("string")), fahrenheit, cell).alias("value"))
    read = admission.read_catalogue(lines)
    return read.select(F.substring("name", 2, 20).cast("long").alias("id"), "celsius", "qualitative", "reason")


_SHAPES = [("A", 1, 30.0, -120.0, 30.6, -119.0), ("B", 2, 30.6, -120.0, 31.1, -119.0), ("C", 3, 34.0, -119.99, 34.4, -119.0)]


def _country_sql() -> str:
    inside = " ".join(f"WHEN lat >= {s} AND lat < {n} AND lng >= {w} AND lng < {e} THEN '{p}'" for p, _, s, w, n, e in _SHAPES)
    away = [f"CASE WHEN d{p} < 0.5 THEN d{p} ELSE 9 END" for p, *_ in _SHAPES]
    gaps = ", ".join(f"sqrt(pow(greatest({s} - lat, lat - {n}, 0), 2) + pow(greatest({w} - lng, lng - {e}, 0), 2))::DOUBLE AS d{p}" for p, _, s, w, n, e in _SHAPES)
    least = f"least({', '.join(away)})"
    pick = " ".join(f"WHEN {a} = {least} AND {least} < 9 THEN '{p}'" for (p, *_), a in zip(_SHAPES, away, strict=True))
    return f"{SPRINGS}, d AS (SELECT id, CASE {inside} END AS home, {gaps} FROM springs) SELECT id, coalesce(home, CASE {pick} ELSE 'XX' END) AS poly, home IS NOT NULL AS exact FROM d"


@query(_country_sql())
def country_lookup(spark, sf_dir):
    """Points in three boxes, near them, and in none."""
    rows = []
    for poly, order, s, w, n, e in _SHAPES:
        corners = [(s, w), (s, e), (n, e), (n, w), (s, w)]
        rows += [(poly, order, 0, *a, *b, w, s, e, n) for a, b in zip(corners, corners[1:], strict=False)]
    edges = spark.createDataFrame(rows, "poly string, ord int, ring int, lat1 double, lng1 double, lat2 double, lng2 double, west double, south double, east double, north double")
    return spatial.country_of(springs(spark, sf_dir), edges, "id")


@query()
def verify_claims(spark, sf_dir):
    """Claims of a number, and of a price, against the pages that they cite; the pattern of a number needs lookaround."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    fetched = pages.select("url", F.when(k % 10 == 1, "source-unreachable").when(k % 10 == 2, "not-found").otherwise("ok").alias("outcome"), text.html_text(F.col("html")).alias("body"))
    made = pages.select(k.alias("id"), F.when(k % 4 == 3, "access.price").otherwise("minerals.ph").alias("field"), (k % 9).cast("string").alias("value"), F.col("url").alias("source"), F.when(k % 7 == 0, "superseded").otherwise("active").alias("state"))
    return claims.verify(made, fetched)


@query("""WITH c AS (SELECT event_id % 10 AS m FROM events)
SELECT count(CASE WHEN m = 1 THEN 1 END) AS refuted, count(CASE WHEN m = 2 THEN 1 END) AS disputed, count(CASE WHEN m = 3 THEN 1 END) AS unreachable, count(CASE WHEN m = 4 THEN 1 END) AS needs_review, count(CASE WHEN m IN (0, 5, 6, 7, 8, 9) THEN 1 END) AS verified, 1 AS code FROM c""")
def verdict_summary(spark, sf_dir):
    m = F.col("event_id") % 10
    verdict = F.when(m == 1, claims.REFUTED).when(m == 2, claims.DISPUTED).when(m == 3, claims.UNREACHABLE).when(m == 4, claims.NEEDS_REVIEW).otherwise(claims.VERIFIED)
    return claims.summary(table(spark, sf_dir, "events").select(verdict.alias("verdict")))


@query("""WITH d AS (SELECT doc_id, text, instr(lower(text), 'the') AS spot FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, greatest(1, CASE WHEN spot > 0 THEN spot ELSE 1 END - 100), 200) END AS excerpt FROM d""")
def source_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", claims.source_excerpt(F.col("text"), F.lit("The"), 200).alias("excerpt"))


@query(r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?i)</?[a-z][^>]*>', '', 'g'), '[<>]', '', 'g'), '(?i)\bhttps?://\S+', '', 'g'), '(^|\s)[@#][\w-]+', '\1', 'g'), '\s+', ' ', 'g')), 1, 280) AS note FROM documents""")
def stripped_notes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", claims.strip_note(F.col("text")).alias("note"))


@query("""WITH m AS (SELECT s_suppkey AS k, s_suppkey % 50 AS id, s_suppkey % 4 AS a, s_suppkey % 5 AS b FROM supplier), e AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS twice FROM m)
SELECT 'm' || id AS id, concat_ws('; ', CASE WHEN twice THEN 'duplicate id' END, CASE WHEN a = 1 THEN 'no warning' END, CASE WHEN b = 1 THEN 'box is not four numbers' END, CASE WHEN b = 2 THEN 'latitude outside 90, transposed?' END,
CASE WHEN b IN (2, 3) THEN 'inverted or empty box' END, CASE WHEN a = 2 THEN 'unknown status' END) AS errors FROM e WHERE errors <> ''""")
def manager_list_faults(spark, sf_dir):
    k = F.col("s_suppkey")
    a, b, said = k % 4, k % 5, F.lit("said")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), (k % 50).cast("string")).alias("id"), said.alias("name"), said.alias("manager"), F.when(a != 1, "careful").alias("warning"), said.alias("source"), said.alias("retrieved"),
        F.when(b == 3, 10.0).otherwise(F.lit(-20.0)).alias("west"), F.when(b == 2, 110.0).otherwise(F.lit(40.0)).alias("south"), F.when(b != 1, F.lit(-10.0)).alias("east"), F.lit(50.0).alias("north"),
        F.when(a == 2, "shut").otherwise("permit").alias("status"),
    )
    return lists.manager_faults(rows)


@query("""SELECT 'r' || n_nationkey AS rule, 'o' || unnest([n_nationkey * 3, n_nationkey * 3 + 1, -n_nationkey - 1]) AS id FROM nation EXCEPT SELECT 'r' || n_nationkey, 'o' || o_orderkey FROM nation, orders""")
def rule_ids_unmatched(spark, sf_dir):
    n = F.col("n_nationkey")
    ident = lambda x: F.concat(F.lit("o"), x.cast("string"))
    rules = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), n.cast("string")).alias("id"), F.array(ident(n * 3), ident(n * 3 + 1)).alias("ids"), F.array(ident(-n - 1)).alias("except"))
    return lists.unmatched_ids(rules, table(spark, sf_dir, "orders").select(ident(F.col("o_orderkey")).alias("id")))


@query("""WITH e AS (SELECT user_id AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC) AS n FROM events)
SELECT key, ts AS "at" FROM e WHERE n = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def ledger_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("claims"))
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return admission.upsert(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"), F.lit(now)).select("key", "at")


@query("""SELECT l_suppkey, l_shipdate, l_quantity, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL""")
def seam_dedupe(spark, sf_dir):
    return admission.seam_deduped(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_orderkey"), ["l_suppkey", "l_shipdate", "l_quantity"], F.col("l_orderkey"))


@query(f"{SPRINGS} SELECT count(id) AS id, count(celsius) AS celsius, count(name) AS name, count(price) AS price FROM springs")
def column_counts(spark, sf_dir):
    return admission.known_counts(springs(spark, sf_dir).select("id", "celsius", "name", "price"))


@query("SELECT n_nationkey, 8::INT AS want, count(s_suppkey) AS have FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(s_suppkey) < 8")
def tiles_short(spark, sf_dir):
    want = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(8).alias("want"))
    return admission.reconciled(want, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@query("SELECT country, arg_max(country || '-' || (id % 3), id) AS name, count(*) AS n FROM (SELECT o_orderkey AS id, CASE o_orderkey % 25 WHEN 7 THEN 'XX' ELSE 'C' || (o_orderkey % 25) END AS country FROM orders) WHERE country <> 'XX' GROUP BY country")
def country_options(spark, sf_dir):
    k = F.col("o_orderkey")
    country = F.when(k % 25 == 7, "XX").otherwise(F.concat(F.lit("C"), (k % 25).cast("string")))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), country.alias("country")).withColumn("label", F.concat_ws("-", "country", (F.col("id") % 3).cast("string")))
    return admission.latest_options(rows, "country", "label", "id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size <= 19 THEN list_value('one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen')[p_size]
ELSE list_value('twenty','thirty','forty','fifty')[p_size // 10 - 1] || CASE WHEN p_size % 10 > 0 THEN '-' || list_value('one','two','three','four','five','six','seven','eight','nine')[p_size % 10] ELSE '' END END AS words,
CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN -p_size::BIGINT WHEN 2 THEN p_size::BIGINT + 1 END AS elevation,
'https://www.openstreetmap.org/node/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '|https://en.wikipedia.org/wiki/Hot_spring_' || p_partkey || '%2F(a)' ELSE '' END AS urls FROM part""")
def display_fields(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    s = size.cast("string")
    raw = F.when(k % 4 == 0, F.concat(s, F.lit(" m"))).when(k % 4 == 1, F.concat(F.lit("-"), s)).when(k % 4 == 2, F.concat(s, F.lit(".5m"))).otherwise("high")
    wiki = F.when(k % 3 == 0, F.concat(F.lit("en:Hot spring "), k.cast("string"), F.lit("/(a)")))
    tags = F.create_map(F.lit("wikipedia"), wiki)
    urls = F.array_join(display.source_urls(F.lit("node"), k, tags), "|")
    return table(spark, sf_dir, "part").select(k.alias("id"), display.number_words(size).alias("words"), display.elevation(raw).alias("elevation"), urls.alias("urls"))
