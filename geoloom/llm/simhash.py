"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  If two fingerprints
differ in at most ``MOST_BITS`` = 2 bits, one segment differs in at most one, so
the two share that segment with one bit masked out.  Every distinct fingerprint
is indexed under the 64 one-wildcard variants of its segments; equal variants
meet in one shuffle and are verified on the whole fingerprint.

Copies with the same fingerprint count as one row throughout.  Each variant
hands on only a spanning forest of its verified links.  A variant that more
than ``RUN`` distinct fingerprints share is not compared within one task: its
fingerprints are indexed under all their two-wildcard variants instead, where
every meeting is a link and the smallest member is the hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import components
from .common import bounded_batches, saved, utf8

SHINGLE = 3
SEED = 42
MOST_BITS = 2
#: Distinct fingerprints of one variant that are compared in memory.
RUN = 4096


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included; 0 without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and just the ASCII white space
    if not words:
        return 0
    hashes = (
        [xxhash.xxh64_intdigest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
        if len(words) >= SHINGLE
        else [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    )
    return majority(np.array(hashes, "u8"))


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``fp`` (the 64 bits as a long) of every row."""
    schema = docs.select(*keep).schema
    names = schema.names[:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in utf8(batch.column(len(keep)))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*names, "fp"])

    return bounded_batches(docs).select(*keep, F.col("text").alias("_whole_text")).mapInArrow(run, schema.add("fp", "long"))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the one-wildcard variants of both segments."""
    bit = np.arange(32, dtype="u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view("u8")
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                segments = np.stack([part >> np.uint64(32), part & np.uint64(0xFFFFFFFF)], 1)
                masked = segments[:, :, None] & ~(np.uint64(1) << bit)
                key = masked | bit << np.uint64(32) | (np.arange(2, dtype="u8") << np.uint64(37))[None, :, None]
                yield pa.record_batch([pa.array(key.ravel().view("i8")), pa.array(np.repeat(part.view("i8"), 64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _linked(x: np.ndarray, y: np.ndarray, segment: int, bit: int) -> np.ndarray:
    """Links between x and y that belong to this variant: each link to one variant only."""
    differ = x ^ y
    high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)
    own, other = (low, high) if segment else (high, low)
    single = np.uint64(1) << np.uint64(bit)
    mine = (own == single) | ((own == 0) & (bit == 0))
    if segment:  # else the first segment has it
        mine &= np.bitwise_count(other) > 1
    return mine & (np.bitwise_count(differ) <= MOST_BITS)


def forest(fp: np.ndarray, key: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one variant."""
    segment, bit = key >> 37 & 1, key >> 32 & 31
    rest, edges = fp, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _linked(x, rest, segment, bit)
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, fp) batches, cut so that no run of a key is split unless it is longer than RUN."""
    held_k, held_f = np.zeros(0, "i8"), np.zeros(0, "u8")
    for batch in batches:
        key = np.concatenate([held_k, batch.column(0).to_numpy()])
        fp = np.concatenate([held_f, batch.column(1).to_numpy().view("u8")])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield key[:cut], fp[:cut]
        held_k, held_f = key[cut:], fp[cut:]
        while len(held_k) > 4 * RUN:
            yield held_k[: 2 * RUN], held_f[: 2 * RUN]
            held_k, held_f = held_k[2 * RUN :], held_f[2 * RUN :]
    yield held_k, held_f


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints whose closure is that of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = None
        for key, fp in _runs(batches):
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            edges: list[tuple[int, int]] = []
            busy: list[np.ndarray] = []
            pair = starts[ends - starts == 2]
            if len(pair):  # by far the most runs with more than one member
                for segment in (0, 1):
                    for bit in range(32):
                        at = pair[(key[pair] >> 37 & 1 == segment) & (key[pair] >> 32 & 31 == bit)]
                        at = at[_linked(fp[at], fp[at + 1], segment, bit)]
                        edges += zip(fp[at].tolist(), fp[at + 1].tolist(), strict=True)
            for a, b in zip(*(x[ends - starts > 2] for x in (starts, ends)), strict=True):
                if b - a > RUN or key[a] == hot:
                    hot = key[a]
                    busy.append(fp[a:b])
                else:
                    edges += forest(fp[a:b], int(key[a]))
            if len(key) and hot is not None and key[0] == hot and ends[0] <= 2:
                busy.append(fp[: ends[0]])
            many = np.concatenate(busy) if busy else np.zeros(0, "u8")
            a = np.concatenate([np.array([x for x, _ in edges], "u8"), many]).view("i8")
            b = np.concatenate([np.array([y for _, y in edges], "u8"), many]).view("i8")
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    met = variants(fps).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")
    found = saved(met.distinct(), "links")
    # a link to itself marks a member of a hot variant
    return found.where("a <> b").unionByName(hot_links(found.where("a = b").select(F.col("a").alias("fp"))))


def hot_links(fps: DataFrame) -> DataFrame:
    """Links among the members of hot variants, by two-wildcard variants of the whole fingerprint."""
    low, high = (x.astype("u8") for x in np.triu_indices(64, 1))
    masks = ~((np.uint64(1) << low) | (np.uint64(1) << high))
    where = (low * np.uint64(64) + high).astype("i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_numpy().view("u8"):
                yield pa.record_batch([pa.array(where), pa.array((x & masks).view("i8")), pa.array(np.full(len(masks), x).view("i8"))], names=["bits", "rest", "b"])

    index = fps.mapInArrow(run, "bits int, rest long, b long")
    hubs = index.groupBy("bits", "rest").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    return index.join(hubs, ["bits", "rest"]).where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    component_id is the smallest id of all rows reachable over links of at most
    two bits, its own included.  Null and empty texts have fingerprint 0 and
    link like any other; repeated rows each keep their row; a null id counts
    for nothing, and a component of null ids has a null component_id; an empty
    table gives no rows.
    """
    marked = saved(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"]), "fingerprints")
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(reps.select("fp")))
    # the other members of each component; the root's own row comes with them
    members = reps.join(roots, reps["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
