"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_topk, line_dedup, lm_score, mixing, one_bit, packing, pii, quality, simhash, spelling, token_count, token_files
from .common import id_remainder, saved, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_score.score(docs, id_remainder(F.col("doc_id"), 10) == 0)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what the mix takes of it, and where its copies stand in training."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), compress=True)
    return mixing.with_ranks(mixed).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").cast("long").alias("taken"),
        F.col("mix_first").alias("position"),
        F.col("mix_first_rank").alias("first_rank"),
        F.col("mix_last_rank").alias("last_rank"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path, with_ids=False)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return exact_topk.search(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    stats = saved(quality.with_statistics(docs, ["doc_id"]), "statistics")
    model = quality.fit(quality.training_rows(stats, _table(spark, sf_dir, "labels"), ~held_out))
    return quality.with_scores(stats, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = one_bit.searchable(_table(spark, sf_dir, "embeddings"))
    return one_bit.search(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings")).drop("centroid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_lm_score, op2_mix, op3_pii, op4_token_files, op5_pack, op6_exact_topk, op7_token_count, op8_quality, op9_one_bit, op10_simhash, op11_line_dedup, op12_spelling, op13_centroids)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Words of a text as the operators count them.
_WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, r, source_size, least(cap, weight * coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight >= level), 0)) AS target FROM l
), m AS (
  SELECT row_number() OVER () AS n, doc_id, size, source_size, target, r,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT n, doc_id, size, r % 3 AS kind, (e.e * source_size + middle) / target AS share
  FROM m, (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) AS e(e) WHERE size > 0 AND e.e * source_size + middle <= target
), p AS (
  -- the inverses of the schedules' integrals: 1; 0.5 to 1 to 1.5; 1.5 to 1 to 0.5
  SELECT n, doc_id, size, CASE kind
    WHEN 0 THEN CASE WHEN share <= 0.5 THEN least(share, 0.5) ELSE 0.5 + least(share - 0.5, 0.5) END
    WHEN 1 THEN CASE WHEN share <= 0.375 THEN least(greatest((sqrt(greatest(0.25 + 2 * 1.0 * share, 0.0)) - 0.5) / 1.0, 0.0), 0.5)
      ELSE 0.5 + least(greatest((sqrt(greatest(1.0 + 2 * 1.0 * (share - 0.375), 0.0)) - 1.0) / 1.0, 0.0), 0.5) END
    ELSE CASE WHEN share <= 0.625 THEN least(greatest((sqrt(greatest(2.25 + 2 * -1.0 * share, 0.0)) - 1.5) / -1.0, 0.0), 0.5)
      ELSE 0.5 + least(greatest((sqrt(greatest(1.0 + 2 * -1.0 * (share - 0.625), 0.0)) - 1.0) / -1.0, 0.0), 0.5) END
    END AS position FROM c
), o AS (
  SELECT n, position, size, row_number() OVER (ORDER BY position, doc_id NULLS FIRST, size) - 1 AS rank FROM p
), q AS (
  SELECT n, count(*) AS copies, min(position) AS position, min(rank) AS first_rank, max(rank) AS last_rank FROM o GROUP BY n
)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken, position, first_rank, last_rank
FROM m LEFT JOIN q ON m.n = q.n
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0)
), p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS FIRST) AS rank FROM p
) WHERE rank <= 5
"""

_STRIP = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'"
#: DuckDB's lower() changes other letters too.
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, {_STRIP}), {_LOWER}) AS key FROM l),
s AS (SELECT key, min(id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(id) <> max(id)),
m AS (SELECT k.*, s.key IS NOT NULL AND k.id <> s.owner AS gone FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial 0xEDB88320, as a list in SQL."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return f"{table}::BIGINT[]"


OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT {_crc_table()} AS t),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), {_LOWER}) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS c FROM o WHERE length(run) >= 5 GROUP BY doc_id, run),
b AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM g),
h AS (SELECT run, c, xor(list_reduce(list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda h, y: xor(h >> 8, t[(xor(h, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, t),
n AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY word),
w AS MATERIALIZED (SELECT word, n FROM n WHERE length(word) >= 5 AND n >= 3),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM e a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM e a JOIN w b ON a.rest = b.word
), f AS MATERIALIZED (
  SELECT w.word, w.n, count(near) AS n_near, CASE WHEN max(m) >= 2 * w.n THEN arg_min(near, (-m, near)) END AS form, CASE WHEN max(m) >= 2 * w.n THEN max(m) END AS form_n
  FROM w LEFT JOIN p USING (word) GROUP BY w.word, w.n
), r(word, top) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.top AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f g ON g.word = r.top AND g.form IS NULL
"""


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    away = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j FROM (SELECT r, j, {away} AS d FROM v, c{i} c) GROUP BY r),
s{i} AS (SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{i} USING (r)) GROUP BY j, i),
m{i} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (j))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS j, v FROM v QUALIFY j < {k}),
{", ".join(steps)},
e AS (SELECT vec_id, r, j, {away} AS d FROM v, c{rounds} c),
b AS (SELECT any_value(vec_id) AS vec_id, arg_min(j, (d, j)) AS cluster, min(d) AS distance FROM e GROUP BY r),
t AS (SELECT j, sha256(list_aggregate(list_transform(v, lambda x: x::VARCHAR), 'string_agg', ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM b JOIN t ON t.j = b.cluster
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op2_mix": OP2_SQL, "op6_exact_topk": OP6_SQL, "op11_line_dedup": OP11_SQL, "op12_spelling": OP12_SQL, "op13_centroids": _op13_sql()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
