"""Blocks of vectors, shared by the two searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Stands for a null id inside blocks, so null ids come first among ties.
NO_ID = -(2**63)
#: Base blocks that a task holds while the query blocks pass.
LANE_BLOCKS = 32
#: For files of blocks: Parquet else takes a hundred rows, of megabytes each, before it looks at their size.
SMALL_GROUPS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}


def usable(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v): rows whose vector is set, not empty and all finite numbers."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def matrix(column) -> np.ndarray:
    """An Arrow list column of one length as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def blocks(rows: DataFrame, size: int, fields: str, make) -> DataFrame:
    """One row per at most ``size`` vectors of one task and one length.

    ``make(ids, vectors)`` returns the block's values for ``fields``; no row is
    shuffled.
    """
    schema = rows.sparkSession.createDataFrame([], fields).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def emit(dim: int, least: int):
            nonlocal number
            ids, vectors = np.concatenate([i for i, _ in held[dim]]), np.concatenate([v for _, v in held[dim]])
            at = 0
            while len(ids) - at >= least and at < len(ids):
                made = (number, *make(ids[at : at + size], vectors[at : at + size]))
                number, at = number + 1, at + size
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, arrow, strict=True)], names=names)
            held[dim] = [(ids[at:], vectors[at:])]

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dim))
                held.setdefault(dim, []).append((part.column(0).fill_null(NO_ID).to_numpy(), matrix(part.column(1))))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    yield from emit(dim, size)
        for dim in held:
            yield from emit(dim, 1)

    return rows.select("vec_id", "v").mapInArrow(run, schema)


def lanes(spark, n: int, size: int) -> int:
    """Into how many lanes ``n`` base vectors in blocks of ``size`` are dealt: enough for all cores, no more than that calls for or the blocks a task may hold."""
    count = -(-n // size)
    return max(-(-count // LANE_BLOCKS), min(count, 4 * spark.sparkContext.defaultParallelism), 1)


def meet(queries: DataFrame, base: DataFrame, count: int) -> DataFrame:
    """Rows of a stream, sorted, in which the base blocks of a lane and length come first, then all query blocks of that length.

    Base blocks are dealt to ``count`` lanes and are sent once; the query blocks are
    copied to each lane.  No row holds both, so a task keeps its lane's blocks (about
    ``LANE_BLOCKS``) and sees each query block once.
    """
    # blocks are numbered by partition and place: neighbours go to different lanes
    lane: Column = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND((1 << 32) - 1), F.lit(count)).cast("int")
    dealt = base.withColumn("lane", lane).withColumn("asks", F.lit(False))
    copies = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("asks", F.lit(True))
    both = dealt.unionByName(copies, allowMissingColumns=True)
    # more partitions than lanes: few tasks get two of them
    return bounded_batches(both.repartition(4 * count, "lane", "dim").sortWithinPartitions("lane", "dim", "asks", "block"))


def answered(batches: Iterator[pa.RecordBatch], load, ask) -> Iterator[tuple]:
    """What ``ask(blocks, row)`` returns for each query row of ``meet``; ``blocks``: ``load(row)`` of its lane's base rows."""
    held, where = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if where != (row["lane"], row["dim"]):
                held, where = [], (row["lane"], row["dim"])
            if not row["asks"]:
                held.append(load(row))
            elif held:
                yield ask(held, row)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (query, query_id, vec_id, score) of each query, with rank; ties to the smaller vec_id, null first.

    ``query`` is the query row's number: ids may stand on several vectors.
    """
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_first()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def leading(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each query, ties to smaller ids, sorted by query and place."""
    order = np.lexsort((ids, -scores, query))
    order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
    return query[order], ids[order], scores[order]


class Leaders:
    """The ``k`` best found so far of each of ``n`` queries; ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.ids, self.scores = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        #: The k-th best score, where there are as many.
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(query):
            return
        both = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores.astype("f8"))))
        self.query, self.ids, self.scores = leading(*both, self.k)
        full = np.arange(len(self.query)) - np.searchsorted(self.query, self.query) == self.k - 1
        self.least[self.query[full]] = self.scores[full]

    def answer(self, first: int, query_ids: np.ndarray, kind: str) -> pa.RecordBatch:
        """(query, query_id, vec_id, score) of all; queries are numbered from ``first``."""
        named = lambda x: pa.array(x, mask=x == NO_ID)
        return pa.record_batch([pa.array(first + self.query), named(query_ids[self.query]), named(self.ids), pa.array(self.scores.astype(kind))], names=["query", "query_id", "vec_id", "score"])


#: What ``Leaders.answer`` returns, before the type of the score.
ANSWER_DDL = "query long, query_id long, vec_id long, score "
