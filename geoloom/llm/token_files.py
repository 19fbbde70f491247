"""Token ids in files: short documents compressed one by one with a shared dictionary.

Format (a folder, written by Spark's committing writer, so it may be in any
store that Spark writes and a lost executor leaves no partial file):

``segments/``
    Parquet rows of some megabytes: ``part``, ``segment`` (order of the ids),
    ``first_doc``, ``last_doc`` (for pruning), ``before`` (ids of the same part
    before this segment), ``n_ids``, ``dict_sha256`` and two binaries.
    ``payload`` holds one zstandard frame per document, end to end; each frame
    is the document's ids as little-endian unsigned ``width``-byte integers.
    ``offsets`` is an array of :data:`ENTRY` records, one per document.
``dictionary/``
    One Parquet row: ``sha256``, ``content``.

Parts cover ascending ranges of doc_id, documents ascend within them, and a
null id comes first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, utf8
from .token_ids import encoder, groups

#: doc_id is 0 where ``null`` is 1; ``offset`` and ``length`` are bytes of the payload.
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
SEGMENT_BYTES = 4 << 20
#: Ranges of ids that a reader of named documents prunes segments by.
RANGES = 64
DICTIONARY_BYTES = 64 << 10
#: The dictionary serves short documents; it learns from at most so many texts of at most so many bytes.
DICTIONARY_TEXTS = 1000
DICTIONARY_TEXT_BYTES = 32 << 10
LEVEL = 3


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary from serialized id arrays; b'' without samples."""
    import zstandard

    samples = [x for x in samples if x]
    if not samples:
        return b""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too short for the trainer: plain content serves too
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Encode every text, append ``end_id``, write the folder ``path``.

    A null text has the end id only; rows with the same id are kept, ordered by
    size and bytes; an empty table makes a folder without segments.
    """
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long"), "text")
    n = docs.count()
    ids = F.coalesce(F.col("doc_id"), F.lit(0))
    sample = (
        docs.where((F.pmod(F.xxhash64(ids, F.octet_length("text")), F.lit(max(1, n // DICTIONARY_TEXTS))) == 0) & (F.octet_length("text") <= DICTIONARY_TEXT_BYTES))
        .select("text")
        .limit(DICTIONARY_TEXTS)
        .toArrow()
    )
    own = encoder(tokenizer_file)
    width = 2 if len(own.ends) <= 65536 and end_id < 65536 else 4
    end = np.array([end_id], "<u4").tobytes()

    def serial(raw: bytes) -> bytes:
        return np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes()

    content = train_dictionary([serial(raw + end) for raw in own.encode_all(utf8(sample["text"]))])
    sha = hashlib.sha256(content).hexdigest()
    shared = spark.sparkContext.broadcast(content)
    spark.createDataFrame([(sha, content)], "sha256 string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.001))) if n and parts > 1 else []
    cuts = np.array(bounds, "f8")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codes = encoder(tokenizer_file)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in groups(texts, 1 << 20):
                found = [raw + end for raw in codes.encode_all(texts[a:b])]
                doc_ids = batch.column(0).slice(a, b - a)
                part = np.searchsorted(cuts, doc_ids.fill_null(-(2**63)).to_numpy().astype("f8"), side="right")
                frames = [press.compress(serial(raw)) for raw in found]
                yield pa.record_batch(
                    [pa.array(part.astype("i4")), doc_ids, pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(frames, pa.binary())],
                    names=["part", "doc_id", "n_tokens", "frame"],
                )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, held, size = 0, 0, [], 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal number, before, held, size
            index = np.zeros(len(held), ENTRY)
            index["doc_id"] = [d or 0 for d, _, _ in held]
            index["null"] = [d is None for d, _, _ in held]
            index["length"] = lengths = np.array([len(f) for _, _, f in held])
            index["offset"] = np.cumsum(lengths) - lengths
            index["n_tokens"] = [k for _, k, _ in held]
            n_ids = int(index["n_tokens"].astype("i8").sum())
            named = [d for d, _, _ in held if d is not None]
            row = (part, number, named[0] if named else None, named[-1] if named else None, before, n_ids, sha, width, index.tobytes(), b"".join(f for _, _, f in held))
            number, before, held, size = number + 1, before + n_ids, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENT, strict=True)], schema=SEGMENT)

        for batch in batches:
            for d, k, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((d, k, f))
                size += len(f)
                if size >= SEGMENT_BYTES:
                    yield flush()
        if held:
            yield flush()

    (
        docs.mapInArrow(compress, "part int, doc_id long, n_tokens long, frame binary")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
        .select("doc_id", "n_tokens", "frame")
        .mapInArrow(segments, SEGMENT_DDL)
        .write.parquet(f"{path}/segments")
    )


SEGMENT = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("dict_sha256", pa.string()), ("width", pa.int32()), ("offsets", pa.binary()), ("payload", pa.binary())]
)
SEGMENT_DDL = "part int, segment int, first_doc long, last_doc long, before long, n_ids long, dict_sha256 string, width int, offsets binary, payload binary"


def _content(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["content"]).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary of {path} is damaged")
    return bytes(row["content"])


def id_ranges(ids: np.ndarray) -> list[tuple[int, int]]:
    """At most ``RANGES`` (first, last) that hold all of the sorted ids, cut at their widest gaps."""
    if not len(ids):
        return []
    # as objects: gaps between 64-bit numbers may need 65 bits
    gaps = np.diff(ids.astype(object))
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: RANGES - 1]) + 1 if len(gaps) else np.zeros(0, int)
    return [(int(part[0]), int(part[-1])) for part in np.split(ids, cuts)]


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) ids of the documents in ``path``.

    ``doc_ids`` fetches these only: segments are pruned by at most ``RANGES``
    ranges of ids, however many there are, and just the named frames are
    decompressed.  Frames of a dictionary other than
    the stored one are refused.
    """
    content = _content(spark, path)
    sha, shared = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)
    rows = spark.read.schema(SEGMENT_DDL).parquet(f"{path}/segments")
    # one row a part, and parts are as many as the writer's tasks
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for part, k in totals:
        starts[part], total = total, total + k
    wanted = None
    if doc_ids is not None:
        wanted = np.array(sorted(set(doc_ids)), "i8")
        near = F.lit(False)
        for first, last in id_ranges(wanted):
            near = near | ((F.col("last_doc") >= first) & (F.col("first_doc") <= last))
        rows = rows.where(near)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError("a segment names another dictionary")
                index = np.frombuffer(row["offsets"], ENTRY)
                start = starts[row["part"]] + row["before"] + np.cumsum(index["n_tokens"], dtype="i8") - index["n_tokens"]
                kept = range(len(index)) if wanted is None else np.flatnonzero(np.isin(index["doc_id"], wanted) & (index["null"] == 0)).tolist()
                out = []
                for i in kept:
                    e = index[i]
                    at = int(e["offset"])
                    ids = np.frombuffer(press.decompress(row["payload"][at : at + int(e["length"])]), f"<u{row['width']}").astype("<u4")
                    out.append((None if e["null"] else int(e["doc_id"]), int(start[i]), len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype("i8"),) if with_ids else ()))
                columns = list(zip(*out, strict=True)) or [()] * len(fields)
                yield pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields])

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.select("part", "before", "dict_sha256", "width", "offsets", "payload").mapInArrow(run, ddl)
