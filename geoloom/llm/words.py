"""Corpus word tables: distinct keys with counts, and lookups of per-document keys.

The heaviest keys (a documented bound) are looked up inside the map tasks, so
no hot key is ever shuffled; the rest meet their table in an equi-join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Distinct keys a task holds before it hands its counts on.
FLUSH_KEYS = 400_000


def count_keys(docs: DataFrame, split: Callable[[bytes], list[bytes]], column: str = "text", each: bytes | None = None) -> DataFrame:
    """(key binary, n long): how often ``split`` yields each key over all rows.

    ``each`` is a key that every row has once besides, null texts too.
    Each task sums in a bounded dictionary first, so the shuffle carries a key
    about once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            if each is not None and len(batch):
                counts[each] += len(batch)
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    counts.update(split(text))
                if len(counts) > FLUSH_KEYS:
                    yield _rows(counts)
                    counts.clear()
        if counts:
            yield _rows(counts)

    def _rows(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["key", "n"],
        )

    partial = bounded_batches(docs).select(column).mapInArrow(run, "key binary, n long")
    return partial.groupBy("key").agg(F.sum("n").alias("n"))
