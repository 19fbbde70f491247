"""Exact centroid clustering of integer vectors, with float32 screening.

A task multiplies a batch of vectors with all centroids in float32 and bounds
how far rounding can have moved each product: with u = 2^-24, a sum of d
products is off by at most gamma * |x| * |c|, gamma = (d + 2) u / (1 - (d + 2) u), in
whatever order it is added (two of the roundings are for numbers beyond 2^24
themselves; whole numbers don't underflow).  So each squared distance is known
to lie in an interval.  Centroids whose interval begins after another one ends
are out; where several are left, their distances are recomputed in whole
numbers and the lowest number wins a tie.  Sums, means and distances are whole
numbers throughout, so results don't depend on the layout of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Components below this size are handled in 32 and 64 bits, others as Python's whole numbers.
NARROW = 1 << 26
#: Bits of the pieces in which sums travel.
LIMB = 30
UNIT = 2.0**-24
#: Room for the rounding of the bounds themselves, relative.
SLACK = 1 + 2.0**-40
MOST = 2**63 - 1


def integer_vectors(table: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v, narrow) of the rows that take part, written to the shared folder.

    ``v`` holds floor(scale * x) of every component x as a double: as 32-bit
    integers where all are small (``narrow``), else as doubles, which are whole
    numbers there.  Rows whose vector is null, has another length than ``dim`` or
    holds null or non-finite components (also once scaled) are left out.
    """
    e = F.col("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim) * float(scale))
            fit = np.isfinite(x).all(1)
            x, ids = x[fit], batch.column(0).filter(pa.array(fit))
            narrow = (np.abs(x) < NARROW).all(1)
            raw = [r.tobytes() for r in x]
            for i in np.flatnonzero(narrow).tolist():
                raw[i] = x[i].astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(narrow)], names=["vec_id", "v", "narrow"])

    whole = F.coalesce(F.forall(e, lambda x: x.isNotNull()), F.lit(False)) & (F.size(e) == dim)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("e")).where(whole)
    return saved(rows.mapInArrow(run, "vec_id long, v binary, narrow boolean"), "integers")


def _numbers(raw: bytes, narrow: bool) -> list[int]:
    return [int(x) for x in np.frombuffer(raw, "<i4" if narrow else "<f8")]


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``; equal ones in the order of their bytes."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.withColumn("h", F.sha2(text, 256)).orderBy("h", "v").limit(k)
    return [_numbers(r["v"], r["narrow"]) for r in first.collect()]


def screened(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, certain) for rows of small whole numbers: the nearest centroid of each row, exact, and where screening alone told it."""
    d = x.shape[1]
    gamma = (d + 2) * UNIT / (1 - (d + 2) * UNIT)
    c = centroids.astype("f8")
    products = (x.astype("f4") @ centroids.astype("f4").T).astype("f8")
    sizes, lengths = np.sqrt((x.astype("f8") ** 2).sum(1)), np.sqrt((c * c).sum(1))
    # |c|^2 - 2 x.c: the distance without |x|^2, which all centroids share
    middle = (c * c).sum(1) - 2 * products
    reach = (2 * gamma * sizes[:, None] * lengths + 2.0**-50 * ((c * c).sum(1) + 2 * sizes[:, None] * lengths)) * SLACK
    left = middle - reach <= (middle + reach).min(1)[:, None]
    certain = left.sum(1) == 1
    least = left.argmax(1)
    open_rows = np.flatnonzero(~certain)
    if len(open_rows):
        r, j = np.nonzero(left[open_rows])
        away = x[open_rows[r]].astype("i8") - centroids[j]
        exact = np.full((len(open_rows), len(c)), MOST)
        exact[r, j] = (away * away).sum(1)
        least[open_rows] = exact.argmin(1)  # the first of equal ones
    return least, certain


def _assign(batch: pa.RecordBatch, v: int, narrow: int, centroids: list[list[int]], dim: int):
    """Parts of a batch: (rows, numbers, nearest, exact distances or None)."""
    small = batch.column(narrow).to_numpy(zero_copy_only=False).astype(bool)
    raw = batch.column(v)
    if all(abs(x) < NARROW for c in centroids for x in c):
        rows = np.flatnonzero(small)
        if len(rows):
            x = np.frombuffer(b"".join(raw.take(pa.array(rows)).to_pylist()), "<i4").reshape(-1, dim)
            yield rows, x, screened(x, np.array(centroids, "i8"))[0]
        small_done = small
    else:
        small_done = np.zeros(len(small), bool)
    rows = np.flatnonzero(~small_done)
    if len(rows):
        x = [_numbers(raw[i].as_py(), bool(small[i])) for i in rows.tolist()]
        yield rows, x, np.array([min(range(len(centroids)), key=lambda j: (_square(p, centroids[j]), j)) for p in x], "i8")


def _square(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Each centroid's number of vectors, and their sums: one row a task, centroid and component, added up by Spark."""
    dim, k = len(centroids[0]), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]
        for batch in batches:
            for _, x, near in _assign(batch, 0, 1, centroids, dim):
                for j in np.unique(near).tolist():
                    of = [x[i] for i in np.flatnonzero(near == j).tolist()] if isinstance(x, list) else x[near == j]
                    part = [sum(c) for c in zip(*of, strict=True)] if isinstance(of, list) else of.sum(0, dtype="i8").tolist()
                    counts[j] += len(of)
                    sums[j] = [a + b for a, b in zip(sums[j], part, strict=True)]
        rows = []
        for j in range(k):
            rows.append((j, -1, 0, counts[j]))
            for i, total in enumerate(sums[j]):
                limb = 0
                while total:
                    # the last piece keeps the sign
                    piece = total if abs(total) < 1 << LIMB else total % (1 << LIMB)
                    rows.append((j, i, limb, piece))
                    total, limb = (total - piece) >> LIMB, limb + 1
        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["j", "i", "limb", "x"])

    parts = vectors.select("v", "narrow").mapInArrow(run, "j int, i int, limb int, x long")
    counts, sums = dict.fromkeys(range(k), 0), {j: [0] * dim for j in range(k)}
    # at most k * (1 + dim * limbs of a number) rows
    for r in parts.groupBy("j", "i", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        if r["i"] < 0:
            counts[r["j"]] += int(r["x"])
        else:
            sums[r["j"]][r["i"]] += int(r["x"]) << (LIMB * r["limb"])
    return counts, sums


def refined(vectors: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after ``rounds`` rounds; an empty one stays.  A round that changes nothing is the last: all others would repeat it."""
    for _ in range(rounds if centroids else 0):
        counts, sums = _sums(vectors, centroids)
        moved = [[s // counts[j] for s in sums[j]] if counts[j] else c for j, c in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): each vector's nearest centroid and its squared distance (null beyond a long)."""
    dim = len(centroids[0]) if centroids else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, away = np.zeros(len(batch), "i4"), [None] * len(batch)
            for rows, x, least in _assign(batch, 1, 2, centroids, dim):
                near[rows] = least
                if isinstance(x, list):
                    exact = [_square(p, centroids[j]) for p, j in zip(x, least.tolist(), strict=True)]
                else:
                    gap = x.astype("i8") - np.array(centroids, "i8")[least]
                    exact = (gap * gap).sum(1).tolist()
                for i, d in zip(rows.tolist(), exact, strict=True):
                    away[i] = d if d <= MOST else None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of decimals).

    ``table``: vec_id, embedding; other columns are ignored.  ``integer_vectors`` says which rows take
    part; each is a vector of its own, also where an id or a whole row repeats or the id is null (its
    text is empty for the start's hash).  With fewer than ``k`` vectors there are fewer centroids;
    without any, no rows.  Distances are null where they don't fit a long, and so are sums of
    distances that don't or that hold such a one.  Centroids are at most ``k`` lists; only they and the
    sums of the rounds pass through the driver.
    """
    vectors = integer_vectors(table, dim, scale)
    centroids = refined(vectors, starts(vectors, k, seed), rounds)
    rows = saved(assigned(vectors, centroids), "assigned")
    found = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.bool_or(F.col("distance").isNull()).alias("beyond")).collect()
    parts = {r["cluster"]: None if r["beyond"] else int(r["d"]) for r in found}
    whole = None if None in parts.values() else sum(parts.values())

    def pick(values: dict[int, object], kind: str) -> Column:
        return F.coalesce(*[F.when(F.col("cluster") == j, F.lit(x)) for j, x in values.items()], F.lit(None)).cast(kind)

    def fitting(x: int | None) -> int | None:
        return x if x is not None and x <= MOST else None

    text = {j: ",".join(map(str, c)) for j, c in enumerate(centroids)}
    return rows.select(
        "vec_id", "cluster", "distance", pick({j: fitting(x) for j, x in parts.items()}, "long").alias("cluster_inertia"),
        F.lit(fitting(whole)).cast("long").alias("inertia"), pick({j: hashlib.sha256(t.encode()).hexdigest() for j, t in text.items()}, "string").alias("centroid_sha256"),
        pick(text, "string").alias("centroid"),
    )
