"""Scores of whole documents by a recurrent language model.

The vocabulary is what the learning rows hold, with counts over all of them.
The most frequent words are head words of a gated recurrent model with a
class-factored softmax (see ``gru``).  Other words, unknown ones too, belong to
spelling classes; within one of them a word's share is (count + 0.1) of the
class's counts + 0.1 * (words + 1), so the probabilities of all events add up to
at most 1.

Words are counted in one pass; a second pass writes each document's codes (two
bytes a token) and its rarer words, and everything after it reads these.  Counts
of the most frequent words (``HOT_WORDS``) are looked up in the map tasks; rarer
words meet the count table in an equi-join.

Training: learning rows are dealt by a hash to shards of about ``SHARD_TOKENS``
tokens.  The first shard trains from the class frequencies, every other one
continues from there, and the parameters are averaged by tokens in a tree.  So
scores do not depend on how the rows lie in files and tasks.  Scoring carries
the state through whole documents.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hot_split, saved, utf8
from .gru import F4, Gru, Streams
from .words import count_keys

#: The end of a text, counted as a token; no word holds a blank.
END = b" end"
#: Starts the key of a long word.
LONG = b" long"
HEAD_WORDS = 512
PER_CLASS = 32
SPELLING_CLASSES = 32
HOT_WORDS = 1 << 18
#: Words of more bytes are known by their hash only, so no key is longer.
LONGEST_WORD = 64
WINDOW, WIDTH = 32, 320
#: Tokens that go through the model in one group of streams.
GROUP_TOKENS = 8 << 20
SHARD_TOKENS = 2 << 20
#: Streams of a training shard, and the tokens each has at least while there are fewer.
SHARD_WIDTH, STREAM_TOKENS = 256, 4096
FIRST_PASSES = 3
#: Models that one node of the averaging tree takes.
FAN_IN = 32
#: Words a task remembers the entry of, besides the hot ones.
REMEMBERED = 1 << 19
RATE = 0.01
SMOOTH = 0.1


def split(text: bytes) -> list[bytes]:
    words = text.lower().split()  # bytes: A-Z and the ASCII white space
    if len(text) > LONGEST_WORD and len(max(words, key=len, default=b"")) > LONGEST_WORD:
        words = [w if len(w) <= LONGEST_WORD else LONG + hashlib.md5(w).digest() for w in words]
    return words


def spelling(word: bytes) -> int:
    """The spelling class of a tail word: script, end mark, length and first letter's half."""
    if word[:1] == b" ":
        return 31  # a long word
    size = len(word)
    last = word[-1]
    mark = 1 if last in b".,;:!?" else 0
    wide = 1 if any(b >= 128 for b in word) else 0
    plain = word[:-1] if mark and size > 1 else word
    odd = not wide and not plain.isalpha()
    if odd:
        return 24 + mark * 4 + (plain.isdigit() * 2 + (size > 6))
    span = 0 if size < 6 else 1 if size < 9 else 2
    return ((wide * 2 + mark) * 3 + span) * 2 + (word[0] > 109)


@dataclass
class Lexicon:
    """What scoring knows of the vocabulary; its size is bounded by ``HOT_WORDS``."""

    total: int
    distinct: int
    #: word -> (number of the head word or -1, count)
    hot: dict[bytes, tuple[int, int]]
    #: Per spelling class: log10 of counts + 0.1 * (words + 1) of its tail words.
    class_log: np.ndarray
    head: int
    #: Tells lexicons apart in worker processes that live on.
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def base_log(self) -> float:
        return math.log10(self.total + SMOOTH * (self.distinct + 1))

    def network(self) -> Gru:
        heads = max(1, -(-self.head // PER_CLASS))
        return Gru(heads * PER_CLASS + SPELLING_CLASSES, heads + SPELLING_CLASSES, heads, PER_CLASS)


def lexicon(learning: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon and the table (key, n) of words that it leaves out."""
    table = saved(count_keys(learning, split, each=END), "words")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SPELLING_CLASSES, 2), np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            np.add.at(sums, [spelling(w) for w in batch.column(0).to_pylist()], np.stack([n, np.ones_like(n)], 1))
        yield pa.record_batch([pa.array(np.arange(SPELLING_CLASSES), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["c", "n", "words"])

    is_end = F.col("key") == F.lit(bytearray(END))
    ends = (table.where(is_end).select("n").first() or (0,))[0]
    table = table.where(~is_end)
    per_class = table.mapInArrow(classes, "c int, n long, words long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    sums = np.zeros((SPELLING_CLASSES, 2))
    for r in per_class:
        sums[r["c"]] = r["n"], r["words"]
    hot, rest = hot_split(table, "n", HOT_WORDS)
    known = hot.toArrow()
    pairs = sorted(zip(known["n"].to_pylist(), known["key"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    total, distinct = int(sums[:, 0].sum()) + ends, int(sums[:, 1].sum()) + bool(ends)
    hot_words = {END: (0, ends)}
    for n, word in pairs:
        number = len(hot_words) if len(hot_words) < HEAD_WORDS else -1
        hot_words[word] = (number, n)
        if number >= 0:
            sums[spelling(word)] -= n, 1
    head = min(HEAD_WORDS, len(hot_words))
    return Lexicon(total, distinct, hot_words, np.log10(sums[:, 0] + SMOOTH * (sums[:, 1] + 1)), head), rest


class _Entries(dict):
    """Entry numbers of the hot words; of others the number of their spelling class, remembered within a bound."""

    def __init__(self, hot: dict[bytes, int], first_class: int):
        super().__init__(hot)
        self.first_class, self.most = first_class, len(hot) + REMEMBERED

    def __missing__(self, word: bytes) -> int:
        number = self.first_class + spelling(word)
        if len(self) < self.most:
            self[word] = number
        return number


class Reader:
    """Words to entry numbers; entry arrays hold what the model and the base need.

    Entries are the hot words, then one per spelling class for all other words,
    whose log10(n + 0.1) the caller adds from the count table.
    """

    def __init__(self, lexicon: Lexicon):
        heads = max(1, -(-lexicon.head // PER_CLASS))
        self.n_head, self.n_hot = heads * PER_CLASS, len(lexicon.hot)
        self.index = _Entries({word: i for i, word in enumerate(lexicon.hot)}, self.n_hot)
        number = np.array([k for k, _ in lexicon.hot.values()])
        count = np.array([n for _, n in lexicon.hot.values()])
        tail = np.arange(SPELLING_CLASSES)
        kind = np.array([0 if k >= 0 else spelling(w) for w, k in zip(lexicon.hot, number.tolist(), strict=True)])
        logs = np.log10(count + SMOOTH)
        self.number = np.concatenate([np.where(number >= 0, number, self.n_head + kind), self.n_head + tail]).astype("<u2")
        self.base = np.concatenate([logs, np.zeros(SPELLING_CLASSES)])
        self.inside = np.concatenate([np.where(number >= 0, 0.0, logs - lexicon.class_log[kind]), -lexicon.class_log])
        self.known = np.concatenate([count > 0, np.zeros(SPELLING_CLASSES, bool)])

    def entries(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))


_readers: dict[str, Reader] = {}


def reader_of(shared) -> Reader:
    """The worker process's reader of a broadcast lexicon, kept between tasks."""
    words = shared.value
    key = words.mark
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(words)
        words.hot = {}  # this process has them in the reader now
    return _readers[key]


def _inputs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's input at each place, the word before (an end at first), and 0 where a text starts."""
    before, fresh = np.zeros_like(codes), np.ones(len(codes), F4)
    before[1:] = codes[:-1]
    before[starts], fresh[starts] = 0, 0  # number 0 is the end
    return before, fresh


def train(net: Gru, texts: list[np.ndarray], rate: float) -> int:
    """One pass over the codes of ``texts``; the number of tokens.

    The texts stand end to end in as many streams of one length as
    ``SHARD_WIDTH`` allows.  A stream's start may cut a text; there the state
    starts anew, as it does with each text.
    """
    lengths = np.array([len(t) for t in texts])
    codes = np.concatenate(texts).astype(np.int32)
    total = len(codes)
    width = max(1, min(SHARD_WIDTH, total // STREAM_TOKENS))
    steps = -(-total // width)
    before, fresh = _inputs(codes, np.cumsum(lengths) - lengths)
    fresh[::steps] = 0
    cls, member = targets(net, codes)
    live = np.ones(steps * width, bool)
    live[total:] = False

    def streams(x: np.ndarray) -> np.ndarray:
        return np.append(x, np.zeros(steps * width - total, x.dtype)).reshape(width, steps).T

    x, fresh, cls, member, live = streams(before), streams(fresh), streams(cls), streams(member), live.reshape(width, steps).T
    h = np.zeros((net.hidden, width), F4)
    for at in range(0, steps, WINDOW):
        part = slice(at, at + WINDOW)
        h = net.learn(x[part], fresh[part], h, cls[part], member[part], live[part], rate * min(1.0, width / 32))
    return total


def targets(net: Gru, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and member of each model number."""
    n_head = net.heads * net.per_class
    head = codes < n_head
    return np.where(head, codes // net.per_class, codes - n_head + net.heads), np.where(head, codes % net.per_class, 0)


def log_sums(net: Gru, texts: list[np.ndarray]) -> np.ndarray:
    """The natural-log probability of each text's codes, the state carried through the whole text."""
    lengths = np.array([len(t) for t in texts])
    codes = np.concatenate(texts).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    before, fresh = _inputs(codes, starts)
    cls, member = targets(net, codes)
    logs, h = np.zeros(len(codes)), None
    for places in Streams(lengths, WIDTH).windows(WINDOW):
        live = places >= 0
        at = np.where(live, places, 0)
        h = np.zeros((net.hidden, at.shape[1]), F4) if h is None else h[:, : at.shape[1]]
        found, h = net.score(before[at], fresh[at], h, cls[at], member[at])
        logs[places[live]] = found[live]
    return np.add.reduceat(logs, starts)


def _code_lists(batch_column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in batch_column]


def fit(coded: DataFrame, words: Lexicon) -> np.ndarray:
    """The averaged parameters after one pass over the codes of all learning rows.

    ``coded``: doc_id and codes of the learning rows.  A shard is as long as its
    texts make it; only rows of one id and one text are sure to share theirs.
    """
    net = words.network()
    # start from the class frequencies
    p = net.views(net.flat)
    counts = np.zeros(net.heads * PER_CLASS)
    for number, k in words.hot.values():
        if number >= 0:
            counts[number] = k
    counts = counts.reshape(-1, PER_CLASS) + SMOOTH
    tails = 10.0**words.class_log
    p["c"][:] = np.log(np.concatenate([counts.sum(1), tails]))
    p["v"][:] = np.log(counts)
    if not words.total:
        return net.flat
    number = max(1, -(-words.total // SHARD_TOKENS))
    hashed = F.xxhash64("doc_id", "codes")
    dealt = coded.select(F.pmod(hashed, F.lit(number)).alias("shard"), hashed.alias("hash"), "codes")
    ddl = "shard long, tokens double, flat binary, squares binary"

    def trained(rows: DataFrame, flat: np.ndarray, squares: np.ndarray, passes: int) -> DataFrame:
        start = rows.sparkSession.sparkContext.broadcast((flat, squares))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, texts in _by_shard(batches):
                own = net_of(words.head, *start.value)
                for k in range(passes):
                    tokens = train(own, texts, RATE / (1 + k) if passes > 1 else RATE / 2)
                yield pa.record_batch([pa.array([shard]), pa.array([float(tokens)]), pa.array([own.flat.tobytes()], pa.binary()), pa.array([own.squares.tobytes()], pa.binary())], names=["shard", "tokens", "flat", "squares"])

        return rows.sortWithinPartitions("shard", "hash", "codes").mapInArrow(run, ddl)

    # shard 0 may have no rows, so the first is the least that has some
    least = dealt.agg(F.min("shard")).first()[0]
    first = trained(dealt.where(F.col("shard") == least).repartition(1), net.flat, net.squares, FIRST_PASSES).first()
    flat, squares = np.frombuffer(first["flat"], F4), np.frombuffer(first["squares"], F4)
    if number == 1:
        return flat
    models = saved(trained(dealt.where(F.col("shard") != least).repartition("shard"), flat, squares, 1), "models")

    def average(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["at"].to_pylist(), table["tokens"].to_pylist(), table["flat"].to_pylist(), strict=True))
        weight = sum(n for _, n, _ in rows)
        mean = sum(n / weight * np.frombuffer(x, F4).astype("f8") for _, n, x in rows)
        return pa.table({"at": [rows[0][0] // FAN_IN], "tokens": [weight], "flat": pa.array([mean.astype(F4).tobytes()], pa.binary())})

    models = models.select(F.col("shard").alias("at"), "tokens", "flat")
    while number > 1:
        models = models.groupBy(F.floor(F.col("at") / FAN_IN).alias("node")).applyInArrow(average, "at long, tokens double, flat binary")
        number = -(-number // FAN_IN)
    found = models.first()
    return np.frombuffer(found["flat"], F4) if found else flat


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shard numbers and their texts, from rows sorted by shard."""
    at, held = None, []
    for batch in batches:
        for shard, codes in zip(batch.column(0).to_pylist(), _code_lists(batch.column(2)), strict=True):
            if held and shard != at:
                yield at, held
                held = []
            at = shard
            held.append(codes)
    if held:
        yield at, held


def net_of(head: int, flat: np.ndarray, squares: np.ndarray | None = None) -> Gru:
    """The network of a lexicon with ``head`` head words and these parameters."""
    heads = max(1, -(-head // PER_CLASS))
    net = Gru(heads * PER_CLASS + SPELLING_CLASSES, heads + SPELLING_CLASSES, heads, PER_CLASS)
    net.flat = flat.copy()
    if squares is not None:
        net.squares = squares.copy()
    return net


CODED = [
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
    ("base", pa.float64()), ("inside", pa.float64()), ("codes", pa.binary()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
]
CODED_DDL = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, inside double, codes binary, rare array<binary>, times array<long>"


def encode(rows: DataFrame, words: Lexicon) -> DataFrame:
    """One row per document: its codes, its distinct words that the lexicon leaves out (``rare``) and how often each comes."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, base_log = reader_of(shared), shared.value.base_log
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in CODED[:-2]]
            keys, times, ends = [], [], [0]
            for doc_id, text, held in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                found_words = split(text)
                found_words.append(END)
                found = reader.entries(found_words)
                n = len(found)
                values = (row, doc_id, held, n, int(reader.known[found].sum()), float(reader.base[found].sum()) - n * base_log, float(reader.inside[found].sum()), reader.number[found].tobytes())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                rare = Counter(compress(found_words, (found >= reader.n_hot).tolist()))
                keys += rare.keys()
                times += rare.values()
                ends.append(len(keys))
                row += 1
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((keys, pa.binary()), (times, pa.int64()))]
            yield pa.record_batch([*(pa.array(c, t) for c, (_, t) in zip(out, CODED, strict=False)), *lists], names=[k for k, _ in CODED])

    return bounded_batches(rows).mapInArrow(run, CODED_DDL)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows where ``held_out`` is false.  A null text counts as
    empty, which is one end token; repeated rows learn and score each for
    themselves; without learning rows every event has the smoothing's share; an
    empty table gives no rows.  Words of more than ``LONGEST_WORD`` bytes are
    told apart by hash, so a text without blanks is one short key.  A text
    carries its state from end to end, so its tokens follow one another in one
    task: a text of a million words takes about a minute.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"))
    words, rest = lexicon(rows.where("not held_out"))
    texts = saved(encode(rows, words), "coded")
    flat, head = fit(texts.where("not held_out").select("doc_id", "codes"), words), words.head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held, size = net_of(head, flat), [], 0

        def scored() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sums = log_sums(net, _code_lists(table["codes"])) / math.log(10)
            model = pc.add(table["inside"], pa.array(sums))
            return table.drop_columns(["codes", "inside"]).append_column("model", model).combine_chunks().to_batches()[0]

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += int(pc.sum(batch["n_tokens"]).as_py())
            if size >= GROUP_TOKENS:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()

    known = F.coalesce("n", F.lit(0))
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("key"), "r.times")
    tails = rare.join(rest, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(known + SMOOTH)).alias("more"), F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    done = bounded_batches(texts.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "codes")).mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double"
    )
    more = F.coalesce("more", F.lit(0.0))
    return done.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
