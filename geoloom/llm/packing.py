"""Best-fit packing of token sequences by hierarchical residual merging.

Each scan task cuts its documents into pieces and packs them best-fit
decreasing.  Nearly full bins are final.  Underfull bins travel up a tree, those
of a scan task piece by piece: each node takes the bins of ``FAN_IN`` nodes as
items and packs them again, until one node is left.

Bins of one node and one fill are interchangeable, so only counts per fill
travel: a node handles at most ``FAN_IN`` times ``capacity`` numbers whatever
the size of the corpus, and every underfull bin stays a candidate up to the last
round.  A node says which ordinals of which fill go where; the bins learn their
place from that in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved, utf8
from .token_ids import encoder, groups

FAN_IN = 8
#: A bin with at most this share of room left is final.
NEARLY_FULL = 1 / 256
#: Pieces a task packs at once, for its memory; the bins of each such batch go up the tree alike.
LOCAL_PIECES = 1_000_000
#: Rounds of at most so many nodes have tables of moves that are surely small enough to broadcast.
BROADCAST_NODES = 16


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin, offset) of each item, and each bin's fill."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rooms: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: some bin has r tokens of room
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    for i in order:
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            rooms.setdefault(left, []).append(b)
            open_rooms |= 1 << left
    return bins, offsets, fills


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Best-fit decreasing of ``counts[size]`` items of each size, as runs of like bins.

    A run is (number of bins, contents); contents are (size, items in each bin,
    number of the run's first item of that size, offset of the first in its bin).
    """
    open_runs: dict[int, list[list]] = {}
    rooms = 0  # bit r: some run has r tokens of room

    def put(room: int, run: list):
        nonlocal rooms
        open_runs.setdefault(room, []).append(run)
        rooms |= 1 << room

    for size in sorted(counts, reverse=True):
        left, taken = counts[size], 0
        while left:
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                run = open_runs[room].pop()
                if not open_runs[room]:
                    rooms &= ~(1 << room)
            else:
                room, run = capacity, [-(-left // (capacity // size)), []]
            # the tightest bin stays the tightest while the size fits, so bins fill up one by one
            each = room // size
            bins = min(run[0], left // each) or 1
            each = min(each, left)
            if bins < run[0]:
                put(room, [run[0] - bins, [(s, q, first + bins * q, at) for s, q, first, at in run[1]]]) if room < capacity else None
            put(room - each * size, [bins, [*run[1], (size, each, taken, capacity - room)]])
            taken += bins * each
            left -= bins * each
    return [(n, contents) for runs in open_runs.values() for n, contents in runs]


def local_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces with their task's nearly full bins.

    What is in underfull ones goes up the tree piece by piece, each a bin
    (``leaf``) of its own with its ``fill`` and its ``ordinal`` among the task's bins
    of that fill.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("leaf", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("ordinal", pa.int64())]
    end = np.array([end_id], "<u4").tobytes()
    slack = int(capacity * NEARLY_FULL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer_file)
        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        under = [0] * (capacity + 1)

        def packed():
            nonlocal rows, first
            bins, offsets, fills = best_fit([r[3] for r in rows], capacity)
            leaf, fill, ordinal = [first + b for b in bins], [None] * len(rows), [None] * len(rows)
            for i, b in enumerate(bins):
                if fills[b] < capacity - slack:
                    f = rows[i][3]
                    leaf[i], offsets[i], fill[i], ordinal[i] = first + len(fills) + i, 0, f, under[f]
                    under[f] += 1
            columns = [*zip(*rows, strict=True), leaf, offsets, fill, ordinal]
            first += len(fills) + len(rows)
            rows = []
            return pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in groups(texts, 1 << 20):
                for doc_id, raw in zip(doc_ids[a:b], codes.encode_all(texts[a:b]), strict=True):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= LOCAL_PIECES:
                yield packed()
        if rows:
            yield packed()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, leaf long, offset long, fill long, ordinal long"
    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


MOVES = [("child", pa.int32()), *((x, pa.int64()) for x in ("fill", "since", "until", "skip", "each", "base", "to_fill", "to_ordinal", "to_bin")), ("full", pa.bool_())]
MOVES_DDL = "child int, fill long, since long, until long, skip long, each long, base long, to_fill long, to_ordinal long, to_bin long, full boolean"


def moves(table: pa.Table, capacity: int) -> pa.Table:
    """Where a node's items go.  ``table``: child, fill, n.

    Items of ``child`` with this ``fill`` and an ordinal from ``since`` to before
    ``until`` go into bins of ``to_fill``, ``each`` to a bin, from ``to_ordinal`` on
    (``to_bin`` is its number among all bins of the node), at ``base``.
    """
    slack = int(capacity * NEARLY_FULL)
    kids: dict[int, list[tuple[int, int]]] = {}
    for child, fill, n in sorted(zip(*(table[c].to_pylist() for c in ("child", "fill", "n")), strict=True)):
        kids.setdefault(fill, []).append((child, n))
    out: list[tuple] = []
    ordinals, number = [0] * (capacity + 1), 0
    for bins, contents in best_fit_counts({f: sum(n for _, n in c) for f, c in kids.items()}, capacity):
        to_fill = sum(size * each for size, each, _, _ in contents)
        for size, each, first, base in contents:
            last, at = first + bins * each, 0
            for child, n in kids[size]:
                a, b = max(first, at), min(last, at + n)
                if a < b:
                    out.append((child, size, a - at, b - at, a - first, each, base, to_fill, ordinals[to_fill], number, to_fill >= capacity - slack))
                at += n
        ordinals[to_fill] += bins
        number += bins
    return pa.table({k: pa.array(list(c), t) for (k, t), c in zip(MOVES, zip(*out, strict=True), strict=True)})


def merge_bins(bins: DataFrame, capacity: int, nodes: int) -> DataFrame:
    """(leaf, sequence_id, base) of every underfull leaf bin.

    ``bins``: leaf long, node int, fill long, ordinal long, written.
    """
    counts = bins.groupBy(F.col("node").alias("child"), "fill").agg(F.count("*").alias("n"))
    at, level, final = bins.withColumn("base", F.lit(0).cast("long")), 0, None
    while True:
        nodes, level = -(-nodes // FAN_IN), level + 1
        parent = F.floor(F.col("child") / FAN_IN).cast("int")
        found = saved(counts.groupBy(parent.alias("node")).applyInArrow(lambda t: moves(t, capacity), MOVES_DDL), "moves")
        table = found.select(F.col("child").alias("node"), F.col("fill"), *[F.col(x).alias(f"m_{x}") for x, _ in MOVES[2:]])
        item = F.col("m_skip") + F.col("ordinal") - F.col("m_since")
        nth = F.floor(item / F.col("m_each"))
        number = F.lit(level << 58) + F.shiftleft(F.floor(F.col("node") / FAN_IN), 31) + F.col("m_to_bin") + nth
        at = at.join(F.broadcast(table) if nodes <= BROADCAST_NODES else table, ["node", "fill"]).where("ordinal >= m_since and ordinal < m_until").select(
            "leaf", F.floor(F.col("node") / FAN_IN).cast("int").alias("node"), F.col("m_to_fill").alias("fill"), (F.col("m_to_ordinal") + nth).alias("ordinal"),
            (F.col("m_base") + item % F.col("m_each") * F.col("fill") + F.col("base")).alias("base"), (-1 - number).alias("sequence_id"), F.col("m_full").alias("full"),
        )
        at = saved(at, "bins")
        done = at if nodes <= 1 else at.where("full")
        done = done.select("leaf", "sequence_id", "base")
        final = done if final is None else final.unionByName(done)
        if nodes <= 1:
            return final
        at = at.where("not full").drop("sequence_id", "full")
        # each bin once: the smallest piece of it would do, but the moves say it without the bins
        made = F.ceil((F.col("skip") + F.col("until") - F.col("since")) / F.col("each")) - F.floor(F.col("skip") / F.col("each"))
        counts = found.where("not full and base = 0").select(parent.alias("child"), F.col("to_fill").alias("fill"), F.col("to_ordinal"), F.col("to_bin"), F.floor(F.col("skip") / F.col("each")).alias("a"), made.alias("m"))
        counts = counts.groupBy("child", "fill", "to_bin").agg(F.max(F.col("a") + F.col("m")).alias("n")).groupBy("child", "fill").agg(F.sum("n").alias("n"))


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A document is its ids and ``end_id``; only longer ones are cut, into pieces
    of ``capacity``.  A null text is the end id alone; repeated rows and null
    ids are packed like others; an empty table gives no rows.
    """
    pieces = saved(local_pieces(docs, tokenizer_file, end_id, capacity), "pieces")
    node = F.shiftright("leaf", 32).cast("int")
    nodes = (pieces.agg(F.max(node)).first()[0] or 0) + 1
    placed = merge_bins(pieces.where("ordinal is not null").select("leaf", node.alias("node"), "fill", "ordinal"), capacity, nodes)
    return pieces.join(placed, "leaf", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "leaf").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
