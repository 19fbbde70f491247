"""Operators 11 to 13 against brute force, on odd rows and on groups that are hot."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import centroids, line_dedup, perfect_hash, spelling

DOC = "doc_id long, text string, shard int, key string, word string, n long, rows string, a long"
LINE = "the same line of text"
ODD = [
    (0, None), (1, ""), (2, "\n\n"), (3, f"  {LINE}\t\nown line number three\n{LINE}"), (4, f"{LINE.upper()}\n"), (5, "Ünï çödé línes \nshort"), (6, "Ünï çödé línes \nÜNÏ çödé línes "),
    (7, "ééééééééé\néééééééééé"), (8, "ééééééééé\néééééééééé\r"), (9, "x" * 300_000 + "\n" + LINE), (10, ("x y " * 80_000) + "\n" + LINE), (None, LINE), (None, f"{LINE}\nheld by nulls only"),
    (None, "held by nulls only"), (11, "held by eleven only\nheld by eleven only"), (11, "held by eleven only"), (11, "held by eleven only"), (12, "\x1c\x1c ten signs"), (13, "\x1c\x1c ten signs"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "k", "w", 2, "r", 3) for r in ODD], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# 11


def kept_lines(docs, least=10):
    """(id, lines, dropped, kept) by plain loops."""
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(blanks).translate(lower)
    order = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= least and len(holders[k]) > 1 and doc != min(holders[k], key=order) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_lines_of_odd_rows(odd, empty):
    assert sorted((tuple(r) for r in line_dedup.dedup(odd).collect()), key=repr) == kept_lines(ODD)
    assert line_dedup.dedup(empty).count() == 0


def test_lines_in_many_shards_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 50)
    monkeypatch.setattr(line_dedup, "FLUSH_ROWS", 40)
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice([f"hot line for all {rng.randint(0, 3)}", f"rare line {rng.randint(0, 400)}", "tiny"]) for _ in range(rng.randint(0, 9)))) for i in range(400)]
    rng.shuffle(docs)
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == kept_lines(docs)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        a, b = rng.integers(0, 2**63, n, "u8"), rng.integers(0, 2**63, n, "u8")
        a[: n // 3] = a[:1]  # equal first halves part too
        counts, owners = np.arange(n, dtype="i8") + 1, np.arange(n, dtype="i8") * 7 - 5
        raw = perfect_hash.pack(a, b, counts, owners)
        shard = perfect_hash.Shard(raw)
        assert sorted(shard.hash.numbers(a, b).tolist()) == list(range(n))
        found = shard.probe(a, b)
        assert (found[0] == counts).all() and (found[1] == owners).all()
        assert len(raw) < 21 * n + 600
        others = shard.probe(rng.integers(0, 2**63, 2000, "u8"), rng.integers(0, 2**63, 2000, "u8"))
        assert (others[0] > 0).sum() <= 1


# 12


def counted(docs, noise=97):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    near = defaultdict(set)
    rest = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            rest[i, shorter].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in rest.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, others in ((w, others) for w, others in near.items() if others):
        best = min(others, key=lambda x: (-words[x], x))
        if words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        last = w
        while last in form:
            last = form[last]
        out.append((w, form.get(w), last, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_words_of_odd_rows(spark, odd, empty):
    rows = ODD + [(50 + i, f"straße Straßé STRASSE strasse çà÷là ÷ÀÁÂÃÄ {'ñandú ' * 3} {'z' * 3000} {'z' * 2999}y") for i in range(4)]
    frame = spark.createDataFrame([(*r, 1, "k", "w", 2, "r", 3) for r in rows], DOC)
    assert sorted_rows(spelling.variants(frame)) == grouped(counted(rows))
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(odd.where("doc_id < 3")).count() == 0


@pytest.mark.parametrize("limits", [(1, 3), (3, 20), (48, 4096)])
def test_near_words_with_hot_segments(spark, monkeypatch, limits):
    """Whatever the limits of a group, every pair is found once."""
    monkeypatch.setattr(spelling, "ENTRIES", limits[0])
    monkeypatch.setattr(spelling, "LOOKUPS", limits[1])
    monkeypatch.setattr(spelling, "SHARD", 500)
    rng = random.Random(7)
    words = {}
    for _ in range(700):
        core = "".join(rng.choice("abé") for _ in range(rng.randint(0, 6)))
        words[rng.choice(["prefix" + core, core + "suffix", "pre" + core + "fix", core + "aaaaa"])] = rng.randint(3, 60)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"]["near"]) for r in spelling.near_words(frame).collect()}
    expected = grouped(words)
    assert {w: n for w, (n, _) in got.items()} == {w: n_near for w, _, _, _, n_near, _ in expected if n_near}
    assert all(got[w][1] == form for w, form, *_ in expected if form)


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(40)] + [(f"leaf{i}", "w05") for i in range(50)]
    assert {tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {(w, "w40") for w, _ in chain}


# 13


def clustered(vectors, k=8, rounds=10):
    """The same in whole numbers, one by one."""
    import math

    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v)]
    text = lambda i: "3:" + ("" if i is None else str(i))
    pack = lambda v: (np.array(v, "<i4") if all(abs(x) < 2**26 for x in v) else np.array(v, "<f8")).tobytes()
    first = sorted(rows, key=lambda r: (hashlib.sha256(text(r[0]).encode()).hexdigest(), pack(r[1])))
    centers = [v for _, v in first[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centers)), key=lambda j: (away(v, centers[j]), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in rows:
            groups[near(v)].append(v)
        centers = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if groups[j] else centers[j] for j in range(len(centers))]
    out = [(i, near(v), away(v, centers[near(v)])) for i, v in rows]
    sums = Counter()
    for _, j, d in out:
        sums[j] += d
    fit = lambda d: d if d < 2**63 else None
    beyond = any(d >= 2**63 for _, _, d in out)
    inertia = lambda j: None if any(fit(d) is None for _, i, d in out if i == j) else fit(sums[j])
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, fit(d), inertia(j), None if beyond else fit(sum(sums.values())), sha[j]) for i, j, d in out), key=repr)


VEC = "vec_id long, embedding array<double>, v string, cluster int, narrow int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in vectors], VEC)


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(60)] + [(None, rng.normal(size=64).tolist()), (3, [0.25] * 64), (3, [0.25] * 64), (3, [-0.25] * 64), (70, [0.0] * 64)]
    vectors += [(80, None), (81, []), (82, [1.0] * 63), (83, [None] + [1.0] * 63), (84, [float("nan")] + [1.0] * 63), (85, [float("inf")] + [1.0] * 63), (86, [1e306] * 64)]
    assert sorted_rows(centroids.cluster(table(spark, vectors)).drop("centroid")) == clustered(vectors)
    assert sorted_rows(centroids.cluster(table(spark, vectors[:3])).drop("centroid")) == clustered(vectors[:3])
    assert centroids.cluster(table(spark, vectors[-7:])).count() == 0
    assert centroids.cluster(table(spark, [])).count() == 0


def test_clusters_of_large_numbers(spark):
    rng = np.random.default_rng(5)
    for scale in (1e4, 1e6, 1e9, 1e30):
        vectors = [(i, (rng.normal(size=64) * scale).tolist()) for i in range(30)] + [(90 + i, rng.normal(size=64).tolist()) for i in range(10)]
        assert sorted_rows(centroids.cluster(table(spark, vectors)).drop("centroid")) == clustered(vectors)


def test_clusters_at_ties(spark):
    """Whole steps of one unit: most distances are equal to others."""
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.integers(0, 2, 64) / 1024).tolist()) for i in range(200)]
    assert sorted_rows(centroids.cluster(table(spark, vectors)).drop("centroid")) == clustered(vectors)


def test_screening_recomputes_overlaps():
    rng = np.random.default_rng(8)
    x = rng.integers(-(2**25), 2**25, (500, 64)).astype("<i4")
    c = np.concatenate([rng.integers(-(2**25), 2**25, (4, 64)), rng.integers(-(2**25), 2**25, (1, 64)).repeat(3, 0) + np.array([[0], [1], [0]])])
    least, certain = centroids.screened(x, c)
    exact = np.array([[sum((int(p) - int(q)) ** 2 for p, q in zip(row, center, strict=True)) for center in c] for row in x], object)
    assert least.tolist() == [min(range(len(c)), key=lambda j: (row[j], j)) for row in exact]
    assert 0 < certain.sum() < len(x)
