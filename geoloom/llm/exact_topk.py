"""Exact inner-product search in buckets of similar length.

Vectors are sorted by length, descending, by range, and cut into buckets.  The
bucket of the longest vectors answers every query first; the k-th score
there is a lower bound on the query's k-th best.  In every other bucket that
bound, divided by the query's length and the bucket's greatest length, is a
threshold on the cosine: above 1 the bucket is skipped; a high threshold prunes
by coordinate (each candidate's coordinate must lie in the interval that the
threshold leaves around the query's largest coordinates), a low one by length
(only a prefix of the bucket is long enough).  What is left is verified by
integer products: one by one where coordinates leave little, else a block of
queries at once.  A task keeps some buckets, and a query's bound rises with what it finds there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved
from .vectors import ANSWER_DDL, SMALL_GROUPS, Leaders, answered, best, blocks, lanes, meet, usable

BUCKET = 8192
QUERY_BLOCK = 1024
#: Up to so many vector lengths their first buckets are broadcast, beyond they are shuffled.
FEW_LENGTHS = 16
#: From this cosine on, coordinates prune better than lengths.
COORDINATE_FROM = 0.5
COORDINATES = 3
#: Coordinates prune a query on its own where an interval is at most so much of the bucket's extent.
SHARP = 0.25
#: Queries whose products with a bucket are made at once.
SLICE = 256
#: Room for the rounding of lengths and quotients, relative.
ROUNDING = 1e-9


def _bucket(ids: np.ndarray, vectors: np.ndarray):
    norms = np.sqrt((vectors * vectors).sum(1))
    order = np.lexsort((ids, -norms))
    return vectors.shape[1], len(ids), float(norms[order[0]]), ids[order].tobytes(), _pack(vectors[order])


def _queries(ids: np.ndarray, vectors: np.ndarray):
    return vectors.shape[1], ids.tobytes(), _pack(vectors)


def _pack(vectors: np.ndarray) -> bytes:
    """The components as 32-bit integers, or as doubles where one is too large for that."""
    return vectors.astype("<i4" if np.abs(vectors).max(initial=0) < 2**31 else "<f8").tobytes()


def _open(raw: bytes, dim: int, count: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * dim * count else "<f8").reshape(-1, dim).astype("f8")


def survivors(q: np.ndarray, bound: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Positions in a bucket (lengths descending) whose product with q may reach ``bound``."""
    length = float(np.sqrt(q @ q))
    if bound <= 0 or length == 0:
        return np.arange(len(norms)) if bound <= 0 else np.zeros(0, int)
    cosine = bound / (length * norms[0]) * (1 - ROUNDING) if norms[0] else 2.0
    if cosine > 1:
        return np.zeros(0, int)
    prefix = int(np.searchsorted(-norms, -bound / length * (1 - ROUNDING), side="right"))
    kept = np.arange(prefix)
    if cosine >= COORDINATE_FROM:
        direction = q / length
        for f in np.argsort(-np.abs(direction))[:COORDINATES].tolist():
            middle, reach = cosine * direction[f], np.sqrt((1 - cosine**2) * max(0.0, 1 - direction[f] ** 2))
            # a candidate with a greater cosine may lie beyond, but only towards the query
            low = -1.0 if direction[f] < -cosine else middle - reach
            high = 1.0 if direction[f] > cosine else middle + reach
            values = unit[kept, f]
            kept = kept[(values >= low - 1e-7) & (values <= high + 1e-7)]
    return kept


class Bucket:
    """A bucket as a task keeps it."""

    def __init__(self, row: dict):
        self.dim, self.ids, self.raw = row["dim"], np.frombuffer(row["ids"], "i8"), row["vectors"]
        vectors = self.vectors()
        self.norms = np.sqrt((vectors * vectors).sum(1))
        unit = vectors / np.where(self.norms, self.norms, 1)[:, None]
        self.low, self.high = unit.min(0), unit.max(0)

    def vectors(self) -> np.ndarray:
        return _open(self.raw, self.dim, len(self.ids))


def sharp(q: np.ndarray, cosine: np.ndarray, bucket: Bucket) -> np.ndarray:
    """Whether coordinates leave a small part of the bucket to these queries (of length 1)."""
    narrow = np.zeros(len(q), bool)
    for f in np.argsort(-np.abs(q), axis=1)[:, :COORDINATES].T:
        d = q[np.arange(len(q)), f]
        middle, reach = cosine * d, np.sqrt(np.maximum(0, 1 - cosine**2) * np.maximum(0, 1 - d * d))
        low, high = np.where(d < -cosine, -1.0, middle - reach), np.where(d > cosine, 1.0, middle + reach)
        left = np.minimum(high, bucket.high[f]) - np.maximum(low, bucket.low[f])
        narrow |= left <= SHARP * (bucket.high[f] - bucket.low[f])
    return narrow


def verify(bucket: Bucket, q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, found: Leaders) -> None:
    """Enter what the bucket has for the queries that may find something there."""
    vectors, norms, ids = bucket.vectors(), bucket.norms, bucket.ids
    lengths = np.sqrt((q * q).sum(1))
    # partial sums of whole numbers are at most the product of the lengths
    most = norms[0] * lengths.max(initial=0) * (1 + ROUNDING)
    kind = "f4" if most < 2**24 else "f8"
    floor = np.maximum(bounds, found.least)
    if most >= 2**53:  # not exact: one product may be rounded in another way than the bound
        floor = np.where(np.isfinite(floor), floor - most * 1e-12, floor)
    positive = floor > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(positive, floor / (lengths * norms[0]) * (1 - ROUNDING), -1.0)
        shortest = np.where(positive, floor / lengths * (1 - ROUNDING), 0.0)
    prefix = np.where(positive, np.searchsorted(-norms, -shortest, side="right"), len(norms))
    open_ = ~(cosine > 1) & (prefix > 0) & ((lengths > 0) | ~positive)
    alone = np.zeros(len(q), bool)
    steep = np.flatnonzero(open_ & positive & (cosine >= COORDINATE_FROM))
    if len(steep):
        alone[steep] = sharp(q[steep] / lengths[steep, None], cosine[steep], bucket)
    if alone.any():
        unit = vectors / np.where(norms, norms, 1)[:, None]
    single = []
    for i in np.flatnonzero(alone).tolist():
        kept = survivors(q[i], floor[i], unit, norms)
        kept = kept[ids[kept] != q_ids[i]]
        # products of integers below 2^53 are exact in doubles
        scores = vectors[kept] @ q[i]
        kept, scores = kept[scores >= floor[i]], scores[scores >= floor[i]]
        single.append((np.full(len(kept), i), ids[kept], scores))
    if single:
        found.add(*(np.concatenate(x) for x in zip(*single, strict=True)))
    rest = np.flatnonzero(open_ & ~alone)
    if not len(rest):
        return
    short = vectors[: prefix[rest].max()].astype(kind)
    for at in range(0, len(rest), SLICE):
        part = rest[at : at + SLICE]
        scores = q[part].astype(kind) @ short.T
        enough = scores >= floor[part, None].astype(kind)
        if enough.sum() > 64 * found.k * len(part):  # no bound yet, or a low one
            scores[ids[None, : len(short)] == q_ids[part, None]] = -np.inf
            if len(short) > found.k:
                enough &= scores >= np.partition(scores, len(short) - found.k, axis=1)[:, len(short) - found.k, None]
        i, j = np.nonzero(enough)
        other = ids[j] != q_ids[part[i]]
        i, j = i[other], j[other]
        found.add(part[i], ids[j], scores[i, j])


def search(queries: DataFrame, base: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (long) of each query's ``k`` highest products.

    Both tables: vec_id, v (array of integers).  Rows with the query's id are
    its own and no candidates; a repeated query row is answered once, an id with
    several vectors once for each of them; repeated other rows are candidates
    each, rows without an id too (first among ties; the least 64-bit number
    counts as no id); vectors of another length take no part.  An empty table
    gives no rows; other columns are not read.  Products are exact while their
    sums stay below 2^53.
    """
    spark = base.sparkSession
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = max(1, -(-n // BUCKET))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ordered = base.repartitionByRange(count, norm.desc(), F.xxhash64("vec_id"))
    buckets = saved(blocks(ordered, BUCKET, "block long, dim int, n int, longest double, ids binary, vectors binary", _bucket), "buckets", **SMALL_GROUPS)
    asked = queries.dropDuplicates(["vec_id", "v"]).coalesce(max(1, -(-n // (QUERY_BLOCK * 64))))
    asked = blocks(asked, QUERY_BLOCK, "q_block long, dim int, q_ids binary, q_vectors binary", _queries)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "i8")
                vectors = _open(row["vectors"], row["dim"], len(ids))
                q_ids = np.frombuffer(row["q_ids"], "i8")
                q = _open(row["q_vectors"], row["dim"], len(q_ids))
                bounds = np.full(len(q), -np.inf)
                for i in range(len(q)):
                    scores = (vectors @ q[i])[ids != q_ids[i]]
                    if len(scores) >= k:
                        bounds[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
                yield pa.record_batch([pa.array([row[c]], t) for c, t in (("q_block", pa.int64()), ("dim", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()))] + [pa.array([bounds.tobytes()], pa.binary())], names=["q_block", "dim", "q_ids", "q_vectors", "bounds"])

    # one bucket of at most BUCKET rows per vector length: a few lengths are small enough to broadcast
    firsts = buckets.groupBy("dim").agg(F.max_by("block", F.struct("longest", -F.col("block"))).alias("block"))
    few = firsts.count() <= FEW_LENGTHS
    told = F.broadcast if few else lambda df: df
    first = told(buckets.join(told(firsts), ["dim", "block"]).select("dim", "ids", "vectors"))
    pairs = asked.join(first, "dim").select("q_block", "dim", "q_ids", "q_vectors", "ids", "vectors")
    seeded = saved(bounded_batches(pairs).mapInArrow(seed, "q_block long, dim int, q_ids binary, q_vectors binary, bounds binary"), "seeded", **SMALL_GROUPS)

    def ask(held: list[Bucket], row: dict) -> pa.RecordBatch:
        q_ids = np.frombuffer(row["q_ids"], "i8")
        q = _open(row["q_vectors"], row["dim"], len(q_ids))
        found = Leaders(len(q), k)
        for bucket in held:
            verify(bucket, q, q_ids, np.frombuffer(row["bounds"], "f8"), found)
        return found.answer(row["q_block"] * QUERY_BLOCK, q_ids, "i8")

    met = meet(seeded, buckets.select("block", "dim", "ids", "vectors"), lanes(spark, n, BUCKET))
    return best(met.mapInArrow(lambda batches: answered(batches, Bucket, ask), ANSWER_DDL + "long"), k)


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, of the rows that take part."""
    return usable(table).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale)))
