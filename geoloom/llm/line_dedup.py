"""Lines that several documents share stay in one of them only.

A scan hands on each task's distinct lines once, as 128-bit hashes with the
rows that hold them.  All distinct line hashes are dealt to shards by hash;
a shard is one small blob: a minimal perfect hash, and behind it arrays of
fingerprints, of document counts and of the smallest id (``perfect_hash``).
The same hashes then probe their shard's arrays in one sorted stream, so lines
are joined with nothing: a task holds one shard and a batch of probes.  Only
lines to drop go back to their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, saved, utf8
from .perfect_hash import Shard, pack

BLANKS = b" \t\n\x0b\x0c\r"
#: Line hashes of a shard, on average: about 2 MB.
SHARD_LINES = 1 << 17
#: Distinct lines, and rows that hold them, that a task keeps before it hands them on.
FLUSH_LINES, FLUSH_ROWS = 100_000, 1_000_000
#: A null id counts as this one, the largest.
NO_ID = 2**63 - 1
_CONTINUED = re.compile(rb"[\x80-\xbf]+")


def key_of(line: bytes, least: int) -> bytes | None:
    """16 bytes that stand for the line, or None if it is shorter than ``least`` code points."""
    import xxhash

    key = line.strip(BLANKS).lower()  # bytes: A-Z only
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(_CONTINUED.sub(b"", key)) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """(a, b, n, first, last, rows): each task's distinct lines, the two halves of their hash, how many rows hold them,
    the smallest and largest id, and the rows: pairs of id and hash of the text, 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        many = 0

        def out() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            n, first, last, rows = zip(*held.values(), strict=True)
            return pa.record_batch(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([bytes(r) for r in rows], pa.binary())],
                names=["a", "b", "n", "first", "last", "rows"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            names = np.stack([ids, batch.column(1).to_numpy()], 1).astype("<i8")
            for i, (doc, text) in enumerate(zip(ids.tolist(), utf8(batch.column(2)), strict=True)):
                name = names[i].tobytes()
                found = {key_of(line, least) for line in text.split(b"\n")}
                found.discard(None)
                many += len(found)
                for key in found:
                    if (of := held.get(key)) is None:
                        held[key] = [1, doc, doc, bytearray(name)]
                    else:
                        of[0] += 1
                        of[1] = min(of[1], doc)
                        of[2] = max(of[2], doc)
                        of[3] += name
                if len(held) > FLUSH_LINES or many > FLUSH_ROWS:
                    yield out()
                    held.clear()
                    many = 0
        if held:
            yield out()

    return bounded_batches(docs).select("_id", "_text_hash", "text").mapInArrow(run, "a long, b long, n long, first long, last long, rows binary")


def arrays(lines: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): every distinct line hash of ``line_rows`` with its count and smallest id.

    Counted as one document: rows of one id, however many.  Hashes are spread evenly, so shards are of
    about one size and a task packs one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []

        def out() -> pa.RecordBatch:
            a, b, n, first = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.record_batch([pa.array([number], pa.int32()), pa.array([pack(a.view("u8"), b.view("u8"), n, first)], pa.binary())], names=["shard", "blob"])

        for batch in batches:
            shard, *columns = (c.to_numpy() for c in batch.columns)
            for at, end in _runs(shard):
                if held and shard[at] != number:
                    yield out()
                    held = []
                number = int(shard[at])
                held.append([c[at:end] for c in columns])
        if held:
            yield out()

    spread = lines.select(_shard(shards), "a", "b", "n", "first", "last").repartition("shard")
    counted = spread.groupBy("shard", "a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    told = counted.select("shard", "a", "b", F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("n")).alias("n"), "first")
    return told.sortWithinPartitions("shard").mapInArrow(run, "shard int, blob binary")


def _shard(shards: int):
    return F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard")


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True)


def probed(lines: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc, text_hash, key): the lines that a row must drop: found in two documents at least, and in one of a smaller id."""
    schema = "doc long, text_hash long, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            blobs = batch.column(1)
            out = []
            for at, end in _runs(numbers):
                if numbers[at] != number:
                    # a shard's blob comes before its probes
                    number, shard = numbers[at], Shard(blobs[at].as_py())
                    at += 1
                if at == end:
                    continue
                a, b = (batch.column(c).slice(at, end - at).to_numpy().astype("i8") for c in (2, 3))
                count, owner = shard.probe(a.view("u8"), b.view("u8"))
                hit = np.flatnonzero(count > 1)
                if not len(hit):
                    continue
                held = batch.column(4).slice(at, end - at).take(pa.array(hit)).to_pylist()
                rows = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
                of = np.repeat(hit, [len(r) // 16 for r in held])
                drop = rows[:, 0] != owner[of]
                out.append((rows[drop], np.stack([a[of[drop]], b[of[drop]]], 1)))
            if out:
                rows, keys = (np.concatenate(x) for x in zip(*out, strict=True))
                raw = keys.astype("<i8").tobytes()
                packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, len(raw) + 1, 16, dtype="i4").tobytes()), pa.py_buffer(raw)])
                yield pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), packed], names=["doc", "text_hash", "key"])

    probes = lines.select(_shard(shards), F.lit(None).cast("binary").alias("blob"), "a", "b", "rows")
    none = F.lit(None)
    both = index.select("shard", "blob", none.cast("long").alias("a"), none.cast("long").alias("b"), none.cast("binary").alias("rows")).unionByName(probes)
    return both.repartition("shard").sortWithinPartitions("shard", F.col("blob").isNull()).mapInArrow(run, schema)


def dedup(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that is left).

    ``docs``: doc_id, text; other columns are ignored.  Lines end at \\n only; a null or empty text is one
    empty line.  Lines count as the same if they are after blanks at both ends are taken off and A-Z are
    lower-cased; those of at least ``least`` code points that two documents hold stay only in the one
    of the smallest id, there as often as they stand.  Rows of one id are one document: a line that only
    they hold is not shared.  A null id counts as the largest.  An empty table gives no rows.  A very
    long text is split in one task.  Lines are told apart by 128-bit hashes.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text_hash"), "text"
    )
    lines = saved(line_rows(keyed, least), "lines")
    shards = max(1, -(-lines.count() // SHARD_LINES))
    index = saved(arrays(lines, shards), "line-arrays")
    # equal rows drop the same lines once
    drops = probed(lines, index, shards).groupBy("doc", "text_hash").agg(F.collect_set("key").alias("drops"))
    both = keyed.join(drops, (keyed["_id"] == drops["doc"]) & (keyed["_text_hash"] == drops["text_hash"]), "left").select("doc_id", "text", "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, kept = [], [], []
            for text, drop in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                n.append(text.count(b"\n") + 1)
                if drop:
                    gone = set(drop)
                    rest = [line for line in text.split(b"\n") if key_of(line, least) not in gone]
                    dropped.append(n[-1] - len(rest))
                    text = b"\n".join(rest)
                else:
                    dropped.append(0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"]
            )

    kind = T.StructType([T.StructField("doc_id", T.LongType()), *T._parse_datatype_string("n_lines long, n_dropped long, kept string")])
    return both.mapInArrow(run, kind)
