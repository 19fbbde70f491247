"""Registered queries of summary documents, plans and changed paths, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import summary
from .queries import SPRINGS, query
from .tables import springs, table


@query(f"""{SPRINGS}, r AS (SELECT *, 'Land ' || (id % 25 // 2) AS country_name, id // 40 AS site FROM springs), b AS (SELECT country, country_name, count(*) AS n FROM r GROUP BY ALL)
SELECT 'total' AS section, NULL AS key, count(*) AS n FROM r UNION ALL SELECT 'sites', NULL, count(DISTINCT site) FROM r UNION ALL SELECT 'countries', NULL, count(*) FROM b
UNION ALL SELECT 'coverage', 'temperature', count(celsius) FROM r UNION ALL SELECT 'coverage', 'price', count(CASE WHEN price <> '' THEN 1 END) FROM r UNION ALL SELECT 'coverage', 'hours', count(CASE WHEN hours = 'open' THEN 1 END) FROM r
UNION ALL SELECT 'coverage', 'clothing', count(CASE WHEN policy <> 'unknown' THEN 1 END) FROM r UNION ALL SELECT 'by_type', kind, count(*) FROM r GROUP BY kind
UNION ALL SELECT 'by_country', country_name, min(n) FROM b GROUP BY country_name UNION ALL SELECT 'sites_by_country', country_name, count(DISTINCT site) FROM r GROUP BY country_name""")
def summary_counts(spark, sf_dir):
    """Two codes share a country's name; sites lie across borders."""
    k = F.col("id")
    rows = springs(spark, sf_dir).select(
        "country", F.concat(F.lit("Land "), F.floor(k % 25 / 2).cast("string")).alias("country_name"), F.col("kind").alias("type"), F.floor(k / 40).alias("site"), "celsius", "price", F.when(F.col("hours") == "open", "daily").alias("hours_open"), "policy"
    )
    return summary.counts(rows)


@query("""WITH c AS (SELECT c_nationkey AS k, least(5, count(*) FILTER (WHERE c_acctbal > 0)) AS candidates, count(*) FILTER (WHERE c_acctbal > 9990) AS verified, count(*) FILTER (WHERE c_acctbal < -995) AS had FROM customer GROUP BY 1)
SELECT count(*) AS countries, sum(candidates)::BIGINT AS candidates, count(*) FILTER (WHERE verified + had >= 2) AS met FROM c""")
def plan_totals(spark, sf_dir):
    """At most five candidates a nation."""
    balance, customers = F.col("c_acctbal"), table(spark, sf_dir, "customer")
    best = customers.where(balance > 0).withColumn("rank", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("rank <= 5")
    candidates = best.groupBy(F.col("c_nationkey").alias("n")).agg(F.collect_list("c_custkey").alias("candidates"))
    had = customers.groupBy("c_nationkey").agg(F.count_if(balance > 9990).alias("verified"), F.count_if(balance < -995).alias("already_had"))
    return summary.plan_totals(had.join(candidates, F.col("c_nationkey") == F.col("n"), "left"))


@query("""SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1""")
def identity_event_counts(spark, sf_dir):
    return summary.event_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "type"))


#: (path, what is wrong with it or None); a part key picks one.
PATHS = (
    ("data/overlay/whs_a1b2c3d4e5f6.json", None), ("data/springs.json", "may only"), ("data/overlay/../../package.json", "may only"), ("data\\overlay\\..\\..\\package.json", "may only"), ("data/overlay/sub/dir/x.json", "no sub"),
    ("data/overlay/notes.md", "named"), ("data/overlay/whs_0123456789AB.json", "named"), ("data/coverage.json", None), ("data/overlay/../coverage.json", None), ("data/coverage.json/../../package.json", "may only"),
    ("./data//overlay/./whs_0123456789ab.json", None), ("../../data/overlay/whs_0123456789ab.json", None), ("data/overlay/", "may only"), ("data/overlay/x/../whs_0123456789ab.json", None), ("DATA/overlay/whs_0123456789ab.json", "may only"),
)
_SAID = {"may only": ": a contribution may only modify data/overlay/**", "no sub": ": data/overlay/ has no subdirectories", "named": ": overlay files are named <spring-id>.json, e.g. whs_a1b2c3d4e5f6.json"}
_PATHS_SQL = ", ".join(f"({i}, '{p}', {'NULL' if e is None else repr(_SAID[e])})" for i, (p, e) in enumerate(PATHS))


@query(f"""WITH cases(i, path, error) AS (VALUES {_PATHS_SQL}), p AS (SELECT p_partkey % 7 AS change, c.* FROM part JOIN cases c ON p_partkey % {len(PATHS)} = c.i WHERE p_partkey % 7 <> 0 OR p_partkey <= 700),
s AS (SELECT change, count(*) AS n FROM p GROUP BY change)
SELECT change, path || error AS error FROM p JOIN s USING (change) WHERE n <= 260 AND error IS NOT NULL
UNION ALL SELECT change, 'too many files: ' || n || ' changed, limit is 260. Split this into smaller submissions.' FROM s WHERE n > 260""")
def path_faults(spark, sf_dir):
    """Parts as files of seven changesets."""
    k = F.col("p_partkey")
    listed = F.get(F.array(*[F.lit(p) for p, _ in PATHS]), (k % len(PATHS)).cast("int"))
    files = table(spark, sf_dir, "part").where((k % 7 != 0) | (k <= 700)).select((k % 7).alias("change"), listed.alias("path"))
    return paths.path_faults(files)
