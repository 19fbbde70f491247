"""Approximate inner-product search on randomly rotated one-bit codes.

Each vector, less the mean of all, is rotated by a random orthogonal matrix
(padded to ``BITS`` dimensions) and keeps one sign per dimension, packed, and
three scalars: its length, the product of the unit vector with its code, and
its product with the mean.  For a query the packed bits and the scalars give an
unbiased estimate of the inner product and an error bound; a vector is ranked
again by its exact product only if estimate plus bound reaches the k-th
best estimate minus bound of its block, in the first block a task sees for the
query; in later ones, if estimate plus ``LATER`` bounds reaches the k-th best product so far.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .vectors import ANSWER_DDL, SMALL_GROUPS, Leaders, answered, best, blocks, lanes, leading, matrix, meet, usable

BLOCK = 8192
QUERY_BLOCK = 1024
SEED = 7
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 1.9
#: Queries whose products with a block are estimated at once, and vectors ranked again at once.
SLICE = 128
AGAIN = 1 << 14
#: How many error bounds an estimate may lie below a product that is known.
LATER = 1.5
#: Room for the rounding of products of vectors of length 1 in 32 bits.
ROUNDING = 1e-4


def code_bits(dim: int) -> int:
    """Dimensions after rotation: twice the vector's, whole bytes."""
    return -(-2 * dim // 8) * 8


@functools.lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """``code_bits`` orthonormal columns' first ``dim`` rows: the same in every task."""
    bits = code_bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def mean_vectors(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each length; one partial sum a task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                v = matrix(batch.filter(pa.array(lengths == dim)).column(0))
                sums[dim] = sums.get(dim, 0) + np.append(v.sum(0), len(v))
        for dim, total in sums.items():
            yield pa.record_batch([pa.array(np.full(dim + 1, dim), pa.int32()), pa.array(np.arange(dim + 1), pa.int32()), pa.array(total)], names=["dim", "i", "x"])

    out: dict[int, np.ndarray] = {}
    for r in rows.select("v").mapInArrow(run, "dim int, i int, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r["dim"], np.zeros(r["dim"] + 1))[r["i"]] = r["x"]
    return {dim: v[:-1] / v[-1] for dim, v in out.items()}


def index(rows: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of codes and scalars, with the vectors for ranking again."""

    def make(ids: np.ndarray, vectors: np.ndarray):
        dim = vectors.shape[1]
        rest = vectors - means[dim]
        turned = rest @ rotation(dim)
        length = np.sqrt((turned * turned).sum(1))
        # product of the unit vector with its code, a unit vector of signs
        fit = np.abs(turned).sum(1) / np.where(length, length, 1) / np.sqrt(turned.shape[1])
        codes = np.packbits(turned > 0, axis=1)
        scalars = np.stack([length, np.where(length, fit, 1.0)], 1)
        return dim, ids.tobytes(), codes.tobytes(), scalars.astype("<f8").tobytes(), _pack(vectors)

    return blocks(rows, BLOCK, "block long, dim int, ids binary, codes binary, scalars binary, vectors binary", make)


def _pack(vectors: np.ndarray) -> bytes:
    """The components as floats where that loses nothing, else as doubles."""
    short = vectors.astype("<f4")
    return (short if (short == vectors).all() else vectors.astype("<f8")).tobytes()


def _open(raw: bytes, dim: int, count: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * count else "<f8").reshape(-1, dim).astype("f8")


def estimate(q: np.ndarray, mean: np.ndarray, ones: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries x vectors) estimates of the inner products, and their error bounds; ``ones``: the codes' bits as floats."""
    dim = len(mean)
    bits = code_bits(dim)
    turned = q @ rotation(dim)
    size = np.sqrt((turned * turned).sum(1))[:, None]
    # the products with the bits are of unit length, so 32 bits do for vectors of any length
    unit = (turned / np.where(size, size, 1)).astype("f4")
    # signs are 2 * bit - 1
    signed = (2 * (unit @ ones.T) - unit.sum(1)[:, None]) / np.float32(np.sqrt(bits))
    length, fit = scalars[:, 0], scalars[:, 1]
    value = size * signed * (length / fit)[None, :] + (q @ mean)[:, None]
    spread = length * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(bits - 1)
    return value, EPSILON * size * spread[None, :]


def search(queries: DataFrame, base: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest found.

    Both tables: vec_id, v.  Rows with the query's id are its own and no
    candidates; a repeated query row is answered once, an id with several vectors
    once for each of them; repeated other rows are candidates each, rows without
    an id too (first among ties; the least 64-bit number counts as no id);
    vectors of another length take no part.  An empty table gives no rows;
    other columns are not read.
    """
    spark = base.sparkSession
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    means = mean_vectors(base)
    codes = saved(index(base.coalesce(max(1, -(-n // BLOCK))), means), "codes", **SMALL_GROUPS)
    asked = queries.dropDuplicates(["vec_id", "v"]).coalesce(max(1, -(-n // (QUERY_BLOCK * 32))))
    asked = blocks(asked, QUERY_BLOCK, "q_block long, dim int, q_ids binary, q_vectors binary", lambda ids, v: (v.shape[1], ids.tobytes(), _pack(v)))
    # written, so that a block has one number in every attempt of a task
    asked = saved(asked, "queries", **SMALL_GROUPS)

    def load(row: dict):
        ids = np.frombuffer(row["ids"], "i8")
        return ids, np.frombuffer(row["codes"], "u1").reshape(len(ids), -1), np.frombuffer(row["scalars"], "<f8").reshape(-1, 2), row["vectors"]

    def ask(held: list, row: dict) -> pa.RecordBatch:
        dim = row["dim"]
        q_ids = np.frombuffer(row["q_ids"], "i8")
        q = _open(row["q_vectors"], dim, len(q_ids))
        found = Leaders(len(q), k)
        lengths = np.sqrt((q * q).sum(1))
        unit = (q / lengths[:, None]).astype("f4")
        for ids, codes, scalars, raw in held:
            vectors, ones = _open(raw, dim, len(ids)), np.unpackbits(codes, axis=1).astype("f4")
            longest = float(np.sqrt((vectors * vectors).sum(1).max()))
            short = (vectors / longest).astype("f4")
            for at in range(0, len(q), SLICE):
                value, bound = estimate(q[at : at + SLICE], means[dim], ones, scalars)
                value[ids[None, :] == q_ids[at : at + SLICE, None]] = -np.inf
                least = found.least[at : at + SLICE]
                near = value + LATER * bound >= least[:, None]
                fresh = np.flatnonzero(least == -np.inf)
                if len(fresh):
                    low = value[fresh] - bound[fresh]
                    low = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(fresh), -np.inf)
                    near[fresh] = value[fresh] + bound[fresh] >= low[:, None]
                i, j = np.nonzero(near & (value > -np.inf))
                parts = []
                for x in range(0, len(i), AGAIN):
                    a, b = i[x : x + AGAIN] + at, j[x : x + AGAIN]
                    # 32 bits tell most of those that are below the k-th best
                    kept = np.einsum("ij,ij->i", short[b], unit[a]) >= found.least[a] / (lengths[a] * longest) - ROUNDING
                    a, b = a[kept], b[kept]
                    # summed row by row: equal vectors have equal scores
                    scores = (vectors[b] * q[a]).sum(1)
                    kept = scores >= found.least[a]
                    parts.append(leading(a[kept], ids[b[kept]], scores[kept], k))
                if parts:
                    found.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return found.answer(row["q_block"] * QUERY_BLOCK, q_ids, "f8")

    met = meet(asked, codes, lanes(spark, n, BLOCK))
    return best(met.mapInArrow(lambda batches: answered(batches, load, ask), ANSWER_DDL + "double"), k)


def searchable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: vectors set, finite, not zero."""
    return usable(table, nonzero=True)
