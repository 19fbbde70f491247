"""Registered queries of durable ids over time, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry
from .queries import query
from .tables import table

_MINT = "'whs_' || substr(sha256('node/' || {}), 1, 12)"


@query(f"""WITH RECURSIVE c AS (SELECT o_orderkey AS k, o_orderkey // 20 AS b FROM orders),
e AS (SELECT b, list(k ORDER BY k) FILTER (k % 3 = 0) AS entries FROM c GROUP BY b),
q AS (SELECT k, b, row_number() OVER (PARTITION BY b ORDER BY k) AS i, k // 4 AS way FROM c WHERE k % 2 = 0),
f(b, i, k, spring, how, taken, ways) AS (
  SELECT b, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::BIGINT[], []::STRUCT(way BIGINT, spring VARCHAR)[] FROM e
  UNION ALL
  SELECT b, i, k, spring, how, CASE WHEN entry IS NULL THEN taken ELSE list_append(taken, entry) END, list_append(ways, {{'way': way, 'spring': spring}}) FROM (
    SELECT *, coalesce(CASE WHEN own THEN 'known_' || k END, old, 'known_' || entry, {_MINT.format('k')}) AS spring, CASE WHEN own OR old IS NOT NULL THEN 'known' WHEN entry IS NOT NULL THEN 'moved' ELSE 'minted' END AS how FROM (
      SELECT f.b, q.i, q.k, q.way, taken, ways, own, old, CASE WHEN own THEN q.k WHEN old IS NULL THEN list_min(list_filter(coalesce(entries, []::BIGINT[]), lambda x: NOT list_contains(taken, x))) END AS entry FROM (
        SELECT f.*, q.k AS k2, q.k % 12 = 0 AS own, list_filter(f.ways, lambda x: x.way = q.way)[1].spring AS old, q.i AS i2 FROM f JOIN q ON q.b = f.b AND q.i = f.i + 1
      ) f JOIN q ON q.k = f.k2 JOIN e ON e.b = f.b)))
SELECT k AS key, spring, how FROM f WHERE k IS NOT NULL""")
def registry_moves(spark, sf_dir):
    """Blocks of 20 keys at one place: every third is an entry, every second a record; few find a reference, four share one."""
    k = F.col("o_orderkey")
    block = F.floor(k / 20)
    rows = table(spark, sf_dir, "orders").select(k.alias("key"), (30 + (block % 4000) * 0.01).alias("lat"), (F.floor(block / 4000) * 0.01 - 120).alias("lng"), F.concat(F.lit("Place "), block.cast("string")).alias("name"), F.lit("node").alias("kind"))
    ref = lambda kind, x: F.concat(F.lit(f"{kind}/"), x.cast("string"))
    key = F.col("key")
    have = rows.where("key % 3 = 0").select(F.concat(F.lit("known_"), key.cast("string")).alias("spring"), key.alias("entry"), F.array(F.when(key % 12 == 0, ref("node", key)).otherwise(ref("old", key))).alias("refs"), "lat", "lng", "name", "kind")
    records = rows.where("key % 2 = 0").withColumn("refs", F.array(ref("node", key), ref("way", F.floor(key / 4))))
    return registry.resolve(records, have).select("key", "spring", "how")


_RUN = "'2026-03-01'"


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer), old AS (SELECT k, CASE WHEN k % 7 = 0 THEN '2026-01-01' END AS gone, CASE WHEN k % 7 = 0 AND k % 2 = 0 THEN 's' || (k + 1) END AS into0 FROM c WHERE k % 3 <> 0),
here AS (SELECT k FROM c WHERE k % 5 <> 0), j AS (SELECT coalesce(old.k, here.k) AS k, old.k AS o, here.k AS h, gone, into0 FROM old FULL JOIN here ON old.k = here.k),
m AS (SELECT *, CASE WHEN k % 10 = 5 AND o IS NOT NULL THEN 's' || (k + 1) END AS into1 FROM j)
SELECT 's' || k AS spring, CASE WHEN h IS NULL THEN coalesce(gone, {_RUN}) END AS missing_since, coalesce(into1, CASE WHEN h IS NULL THEN into0 END) AS merged_into, CASE WHEN h IS NOT NULL THEN k * 0.5::DOUBLE ELSE -1.0::DOUBLE END AS lat,
CASE WHEN h IS NOT NULL AND o IS NOT NULL THEN 'node/' || k || ',way/' || k WHEN h IS NOT NULL THEN 'way/' || k ELSE 'node/' || k END AS refs, CASE WHEN h IS NOT NULL AND k % 4 <> 0 THEN 'new' WHEN o IS NOT NULL THEN 'old' END AS name,
CASE WHEN o IS NULL THEN 'spring.appeared' WHEN h IS NULL AND gone IS NULL THEN CASE WHEN into1 IS NOT NULL THEN 'spring.merged' ELSE 'spring.disappeared' END END AS type FROM m""")
def registry_advance(spark, sf_dir):
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(k)
    text = lambda prefix, x=k: F.concat(F.lit(prefix), x.cast("string"))
    none = F.lit(None).cast("string")
    gone = F.when(k % 7 == 0, "2026-01-01")
    old = customers.where(k % 3 != 0).select(
        text("s").alias("spring"), k.alias("entry"), F.array(text("node/")).alias("refs"), F.lit(-1.0).alias("lat"), F.lit(-1.0).alias("lng"), F.lit("old").alias("name"),
        F.lit("2025-01-01").alias("first_seen"), F.lit("2025-12-01").alias("last_seen"), gone.alias("missing_since"), F.when(gone.isNotNull() & (k % 2 == 0), text("s", k + 1)).alias("merged_into"),
    )
    # two records a spring: the later one says where it is, the last named one how it is called
    rows = customers.where(k % 5 != 0)
    resolved = rows.select((k * 2).alias("key"), text("s").alias("spring"), F.array(text("way/")).alias("refs"), F.lit(7.0).alias("lat"), F.lit(7.0).alias("lng"), F.when(k % 4 != 0, "new").alias("name"))
    resolved = resolved.unionByName(rows.select((k * 2 + 1).alias("key"), text("s").alias("spring"), F.array(text("way/")).alias("refs"), (k * 0.5).alias("lat"), F.lit(8.0).alias("lng"), none.alias("name")))
    merges = customers.where(k % 10 == 5).select(text("node/").alias("ref"), text("s", k + 1).alias("into"))
    after, events = registry.advance(old, resolved, "2026-03-01", merges)
    told = events.select("spring", "type")
    return after.join(told, "spring", "left").select("spring", "missing_since", "merged_into", "lat", F.array_join("refs", ",").alias("refs"), "name", "type")


@query("""WITH RECURSIVE m AS (SELECT event_id, ts, user_id AS k, event_type AS t, CASE WHEN user_id % 9 <> 0 THEN user_id // 2 END AS dest FROM events),
l AS (SELECT k, arg_max(struct_pack(t := t, dest := dest), (ts, (t = 'click')::INT, dest::VARCHAR)) AS e FROM m WHERE t IN ('click', 'purchase') GROUP BY k),
links AS (SELECT k AS old, e.dest AS new FROM l WHERE e.t = 'click' AND e.dest IS NOT NULL), r(old, at) AS (SELECT old, new FROM links UNION SELECT r.old, links.new FROM r JOIN links ON links.old = r.at WHERE r.at <> links.new)
SELECT old::VARCHAR AS old, CASE WHEN NOT EXISTS (SELECT 1 FROM links WHERE links.old = r.at) THEN r.at::VARCHAR END AS current FROM r WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.old = r.at)""".replace("at)", "top)").replace("r.at", "r.top"))
def merged_ids(spark, sf_dir):
    """Clicks as merges into half the number, purchases as returns: chains are as long as the numbers' binary logarithm."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "spring.merged").when(F.col("event_type") == "purchase", "spring.returned").otherwise("claim")
    log = events.select(F.col("user_id").cast("string").alias("spring"), kind.alias("type"), F.when(F.col("user_id") % 9 != 0, F.floor(F.col("user_id") / 2).cast("string")).alias("to"), "ts")
    return registry.current_ids(registry.merge_links(log))
