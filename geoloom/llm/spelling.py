"""Words grouped with the frequent word they are one edit away from.

If two words differ by one inserted, deleted or replaced letter, either the first
half of one word starts the other or its second half ends it.  So every word
is entered under its two halves, and looked up under the halves that words of
its own length, one more and one less would have.  Entries and lookups meet in
shards by a hash of length, place and segment; a shard builds an Aho-Corasick
automaton of its segments and scans its words with it.  Of the segments found
only those count that lie where the lookup wants them, in words of the length it
wants; what is left is verified.

A segment that many words share is no unbounded group: its words are entered again
under the segment and a half of what is left between, and so on until the groups
are small.  What is left shrinks to one letter, so this ends.  Of the two ways in
which a pair could be found, the second counts only where the first fails.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved, utf8

#: Letters A-Z, a-z and U+00C0 to U+00FF as UTF-8.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: One text's run in so many loses a letter.
NOISE = 97
#: Distinct words a task holds before it hands its counts on, and their bytes.
FLUSH_WORDS, FLUSH_BYTES = 300_000, 16 << 20
#: Entries that may share a segment; lookups that may ask for it.
ENTRIES, LOOKUPS = 48, 4096
#: Entries and lookups of a shard, on average.
SHARD = 1 << 17
MOST_ROUNDS = 64


def _noised(run: bytes, at: int) -> bytes:
    if run.isascii():
        return run[:at] + run[at + 1 :]
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def count_words(docs: DataFrame, noise: int | None = NOISE, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): the words of at least ``least`` letters and how often they stand in all texts.

    With ``noise``, a run whose crc32 behind its document's id is divisible by it
    loses the letter that the crc32 names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                seed = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(RUN.findall(text.lower())).items():
                    if len(word) < least:
                        continue
                    letters = len(word) if word.isascii() else len(word.decode())
                    if noise and not (h := zlib.crc32(word, seed)) % noise:
                        word = _noised(word, h % letters)
                        letters -= 1
                    if letters >= least:
                        if word not in counts:
                            size += len(word)
                        counts[word] += n
                if len(counts) > FLUSH_WORDS or size > FLUSH_BYTES:
                    yield out()
                    counts.clear()
                    size = 0
        if counts:
            yield out()

    partial = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _key() -> Column:
    """A hash of a row's length, places and segments."""
    prefix = F.col("word").substr(F.lit(1), F.col("p"))
    suffix = F.when(F.col("s") > 0, F.col("word").substr(F.length("word") - F.col("s") + 1, F.col("s"))).otherwise("")
    return F.xxhash64("len", "p", "s", prefix, suffix)


def lookups(words: DataFrame) -> DataFrame:
    """(word, n, len, p, s, own, key): each word under the first ``p`` or the last ``s`` of its letters, as words of ``len``
    letters have them; ``own`` rows are entries.  The letters between are ``len - p - s``."""
    sizes = F.array(*[F.struct((F.length("word") + d).alias("len"), F.lit(d == 0).alias("own")) for d in (0, 1, -1)])
    each = words.withColumn("e", F.explode(sizes)).select("word", "n", "e.len", "e.own")
    half = F.floor(F.col("len") / 2).cast("int")
    parts = F.array(F.struct(half.alias("p"), F.lit(0).alias("s")), F.struct(F.lit(0).alias("p"), (F.col("len") - half).alias("s")))
    rows = each.withColumn("e", F.explode(parts)).select("word", "n", "len", "own", "e.p", "e.s")
    return rows.withColumn("key", _key())


def small_groups(words: DataFrame) -> DataFrame:
    """Rows like ``lookups`` whose segments at most ``ENTRIES`` words share, or that leave one letter between."""
    rows, done = saved(lookups(words), "segments"), None
    for _ in range(MOST_ROUNDS):
        sizes = rows.groupBy("key").agg(F.count_if("own").alias("entries"), F.count("*").alias("all"), F.max(F.when(F.col("own"), F.col("len") - F.col("p") - F.col("s"))).alias("between"))
        hot = (F.col("between") > 1) & ((F.col("entries") > ENTRIES) | (F.col("all") > LOOKUPS))
        # segments without an entry find nothing
        told = saved(rows.join(sizes.where("entries > 0").select("key", hot.alias("hot")), "key"), "segments")
        small = told.where("not hot").drop("hot")
        done = small if done is None else done.unionByName(small)
        large = told.where("hot")
        if large.isEmpty():
            return done
        half = F.floor((F.col("len") - F.col("p") - F.col("s")) / 2).cast("int")
        parts = F.array(F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("len") - F.col("p") - half).alias("s")))
        finer = large.withColumn("e", F.explode(parts)).select("word", "n", "len", "own", "e.p", "e.s")
        # a lookup may be too short for both segments
        rows = finer.where(F.col("p") + F.col("s") <= F.length("word")).withColumn("key", _key())
    raise RuntimeError("segments did not part")


def one_edit(u: str, w: str) -> bool:
    """Whether one letter inserted, deleted or replaced makes one word the other."""
    if len(u) > len(w):
        u, w = w, u
    if len(w) - len(u) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(u, w, strict=False)) if x != y), len(u))
    if len(u) == len(w):
        return at < len(u) and u[at + 1 :] == w[at + 1 :]
    return u[at:] == w[at + 1 :]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of the words that have near ones, how many, and the most frequent one (n, near; the first in order at a tie)."""
    rows = small_groups(words)
    shards = max(1, -(-rows.count() // SHARD))
    schema = "word string, n_near long, n long, near string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        number, machine, scan = None, None, False
        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for shard, word, n, size, p, s, own, entry in zip(*columns, strict=True):
                if shard != number:
                    number, machine, scan = shard, ahocorasick.Automaton(), False
                if entry:
                    # the longer segment is the pattern, at its place; the other one is checked
                    pattern = word[:p] if p >= s else word[len(word) - s :]
                    held = machine.get(pattern, None)
                    if held is None:
                        machine.add_word(pattern, held := {})
                    held.setdefault((size, p, s), []).append((word, n))
                    continue
                if not scan:
                    scan = True
                    if len(machine):
                        machine.make_automaton()
                if not len(machine):
                    continue
                # where the wanted segment must end
                last = p - 1 if p >= s else len(word) - 1
                near, best = 0, None
                for end, held in machine.iter(word):
                    if end != last or (entries := held.get((size, p, s))) is None:
                        continue
                    for other, m in entries:
                        if p and s and not (word.startswith(other[:p]) and word.endswith(other[size - s :])):
                            continue
                        # with the first half too, the pair is found there
                        if s and word.startswith(other[: size - s]) or other == word or not one_edit(word, other):
                            continue
                        near += 1
                        if best is None or (-m, other) < best:
                            best = (-m, other)
                if near:
                    found.append((word, near, -best[0], best[1]))
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "n", "near"])

    shard = F.pmod("key", F.lit(shards)).cast("int").alias("shard")
    # each entry is there twice: to be found, and to look for others
    twice = rows.withColumn("entry", F.explode(F.when(F.col("own"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    sorted_rows = twice.select(shard, "word", "n", "len", "p", "s", "own", "entry").repartition("shard").sortWithinPartitions("shard", F.desc("entry"))
    found = sorted_rows.mapInArrow(run, schema)
    best = F.min_by(F.struct("n", "near"), F.struct((-F.col("n")).alias("m"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) to words more frequent by a factor of two at least: chains are short, and each round doubles the steps."""
    jumps = saved(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        onward = jumps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        longer = saved(jumps.join(onward, jumps["root"] == onward["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        jumps = longer.select("word", "root")
    raise RuntimeError("forms run in a circle")


def variants(docs: DataFrame, noise: int | None = NOISE, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of at least five letters found at least ``least_times``.

    ``docs``: doc_id, text; other columns are ignored.  Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z
    lower-cased; ``count_words`` says which lose a letter.  Words are near if one inserted, deleted or replaced letter
    parts them.  ``form``: the near word of largest n (the first in code-point order at a tie) if
    that is at least twice the word's, else null; ``root``: the last form from there on.  A null id counts as
    empty text before the colon; null and empty texts have no words; rows count as often as they
    repeat; no words, no rows.  A very long text or word is handled in one task.
    """
    words = saved(count_words(docs, noise).where(F.col("n") >= least_times), "words")
    near = saved(near_words(words), "near")
    both = words.join(near, "word", "left")
    taken = F.col("best.n") >= 2 * F.col("n")
    formed = saved(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, F.col("best.n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
