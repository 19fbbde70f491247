"""The numbered operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import exact_topk, lm_score, mixing, one_bit, packing, pii, quality, queries, simhash, token_count, token_files, token_ids
from geoloom.llm.common import hot_split

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, key int, row int, fp string, label string"
ODD_TEXTS = [None, "", " \t\n", "A", "a b", "Ünï çödé ﬁ Σίσυφος ΣΑΣ", "<|endoftext|> x's <s> </s>", "漢字 かな　é", "▁▁ a  b   ", "x" * 5000, "a@b.co " * 3, "é" * 300 + " 1.2.3.4", "\x00\x01 \x1c\x85  z", "12 " * 700]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls anywhere, repeated rows, clashing extra columns."""
    rows = [(i, t, None, None if i % 3 else "s", None, "x", 1, 2, "f", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, None, None, None, None, None, None, None, None, None), (None, "a b c d", "en", "s", 7, None, None, None, None, None), (3, "again A", "en", "s", 7, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# 1


def test_lm_base_and_state(spark, odd, documents):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    for frame in (documents, odd):
        texts = [(r["doc_id"], zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 10 == 0, lm_score.split((r["text"] or "").encode())) for r in frame.collect()]
        counts = Counter(w for _, h, words in texts if not h for w in [*words, None])
        n, v = sum(counts.values()), len(counts)
        expected = sorted((repr(d), h, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 6)) for d, h, w in texts)
        got = lm_score.score(frame, held).collect()
        assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_lm_beats_base_on_held_out(spark, documents):
    got = lm_score.score(documents, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_lm_empty(empty):
    assert lm_score.score(empty, F.lit(False)).count() == 0


def test_lm_layout_and_plain_forward(spark, documents, odd):
    """Scores don't depend on the tasks that read the rows, and equal a step-by-step forward pass in plain loops."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    small = documents.where("doc_id < 60").select("doc_id", "text").unionByName(odd.select(F.col("doc_id").cast("long"), F.substring("text", 1, 3000).alias("text")))
    # shards of a few thousand tokens, so that there are several
    seen = []
    for n in (1, 4, 16):
        seen.append(sorted(((repr(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score.score(small.repartition(n, "text"), held).collect())))
    for other in seen[1:]:
        assert len(other) == len(seen[0])
        for a, b in zip(seen[0], other, strict=True):
            assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=2e-4, abs_tol=1e-3)
    words, rest = lm_score.lexicon(small.where(~held).select("text"))
    coded = lm_score.encode(small.select("doc_id", "text", held.alias("held_out")), words)
    texts = coded.collect()
    flat = lm_score.fit(spark.createDataFrame([(r["doc_id"], r["codes"]) for r in texts if not r["held_out"]], "doc_id long, codes binary"), words)
    net = lm_score.net_of(words.head, flat)
    p = {k: v.astype("f8") for k, v in net.views(net.flat).items()}
    k = net.hidden
    for r in texts[:8]:
        codes, h, before, plain = np.frombuffer(r["codes"], "<u2"), np.zeros(k), 0, 0.0
        for code in codes[:400].tolist():
            pre = p["W"] @ p["E"][:, before] + p["b"]
            z, reset = np.split(1 / (1 + np.exp(-(pre[: 2 * k] + p["U"][: 2 * k] @ h))), 2)
            n = np.tanh(pre[2 * k :] + p["U"][2 * k :] @ (reset * h))
            h = n + z * (h - n)
            out = np.exp(p["C"] @ h + p["c"])
            n_head = net.heads * net.per_class
            c = code // net.per_class if code < n_head else code - n_head + net.heads
            plain += math.log(out[c] / out.sum())
            if code < n_head:
                inner = np.exp(p["V"][c] @ h + p["v"][c])
                plain += math.log(inner[code % net.per_class] / inner.sum())
            before = code
        assert math.isclose(lm_score.log_sums(net, [codes[:400]])[0], plain, rel_tol=1e-4, abs_tol=1e-2)


def test_lm_shards(spark, documents, monkeypatch):
    """Several shards, averaged in a tree, give the same parameters in any layout."""
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 4000)
    monkeypatch.setattr(lm_score, "FAN_IN", 3)
    words, _ = lm_score.lexicon(documents.select("text"))
    coded = lm_score.encode(documents.select("doc_id", "text", F.lit(False)), words).select("doc_id", "codes")
    one, many = (lm_score.fit(coded.repartition(n), words) for n in (1, 7))
    assert np.allclose(one, many, atol=1e-4) and np.isfinite(one).all()


def test_gru_gradient_and_windows():
    from geoloom.llm.gru import Gru, Streams

    rng = np.random.default_rng(0)
    net = Gru(20, 6, 4, 4, hidden=5, embed=3)
    net.flat += rng.standard_normal(len(net.flat)).astype("f4") * 0.1
    x, fresh = rng.integers(0, 20, (4, 3)), np.ones((4, 3), "f4")
    fresh[0], fresh[2, 1] = 0, 0
    cls, member, h = rng.integers(0, 6, (4, 3)), rng.integers(0, 4, (4, 3)), np.zeros((5, 3), "f4")
    loss = lambda: -float(net.score(x, fresh, h, cls, member)[0].astype("f8").sum()) / 12
    before, base = net.flat.copy(), loss()
    net.learn(x, fresh, h, cls, member, np.ones((4, 3), bool), 1e-4)
    assert loss() < base
    step = before - net.flat
    # the step's sign follows the numeric gradient wherever that is clear
    net.flat[:] = before
    for i in rng.integers(0, len(before), 60):
        net.flat[i] = before[i] + 1e-2
        up = loss()
        net.flat[i] = before[i] - 1e-2
        slope = (up - loss()) / 2e-2
        net.flat[i] = before[i]
        if abs(slope) > 1e-3:
            assert np.sign(step[i]) == np.sign(slope)
    # windows with carried state score as one long run
    whole, _ = net.score(x, fresh, h, cls, member)
    first, carried = net.score(x[:2], fresh[:2], h, cls[:2], member[:2])
    second, _ = net.score(x[2:], fresh[2:], carried, cls[2:], member[2:])
    assert np.allclose(whole, np.concatenate([first, second]), atol=1e-5)
    places = np.concatenate([w[w >= 0] for w in Streams(np.array([5, 1, 9, 3]), 2).windows(4)])
    assert sorted(places.tolist()) == list(range(18))


# 2


def test_mix(spark, documents, odd, empty):
    got = mixing.mix(documents).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["mix_size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    targets, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * unit > 3 * sizes[s]}
        for s in over or free:
            targets[s] = 3.0 * sizes[s] if over else weights[s] * unit
        left -= sum(3.0 * sizes[s] for s in over)
        free = free - over if over else set()
    most = max(r["mix_size"] for r in got)
    taken = Counter()
    for r in got:
        assert r["mix_target"] == pytest.approx(targets[r["source"]])
        assert r["mix_taken"] <= 3 * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    assert all(abs(taken[s] - targets[s]) <= most for s in sizes)
    assert mixing.mix(odd).count() == odd.count()
    clashing = ["rank", "slice_before", "s_source", "s_slice", "t_source", "size", "bytes", "before", "inside", "n", "mix_rank", "mix_source_size"]
    named = odd.withColumns({c: F.lit("own") for c in clashing})
    ranked = mixing.with_ranks(mixing.mix(named)).collect()
    assert len(ranked) == odd.count() and all(r[c] == "own" for r in ranked for c in clashing[:-2])
    assert sorted((r["mix_size"], r["mix_taken"]) for r in ranked) == sorted((r["mix_size"], r["mix_taken"]) for r in mixing.mix(odd).collect())
    assert mixing.mix(empty).count() == 0
    order = [r["mix_position"] for r in mixing.training_order(mixing.mix(documents)).select("mix_position").collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1


# 3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.findall("[0-9]", m.group())]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_base_spans_on_noise():
    rng, anchors = random.Random(5), pii.automaton()
    parts = ["a@b.co", "@", ".", "-", " ", "+", "1", "23", "255.1.1.9", "4524132264652876", "4111 1111 1111 1111", "+1 (988) 555-2485", "é", "iban", "account ", "://", "tel:", "x", "a.b", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        found = pii.find_spans(text, anchors)
        assert [s for s in found if s[0] in BASE] == base_spans(text), text


def test_pii_added_spans():
    found = {s[0]: s for s in pii.find_spans("IBAN: GB82 WEST 1234 5698 7654 32 IS MINE, see https://bob:pw@host.example/x", pii.automaton())}
    assert "IBAN: GB82 WEST 1234 5698 7654 32 IS MINE"[found["account"][1] : found["account"][2]] == "GB82 WEST 1234 5698 7654 32"
    assert "address" in found and not pii.find_spans("accountable 123456 see https://host.example/x", pii.automaton())
    long = "https://" + "u" * 5000 + ":pw@host.example/x"
    assert [long[s[1] : s[2]] for s in pii.find_spans(long, pii.automaton()) if s[0] == "address"] == [long.removesuffix("/x")]
    assert pii.redacted("mail a@b.co!", pii.find_spans("mail a@b.co!", pii.automaton())) == "mail [EMAIL]!"


def test_pii_rows(documents, odd, empty):
    for frame in (documents, odd):
        expected = sorted((repr(r["doc_id"]), hashlib.sha256(pii.joined(base_spans(r["text"] or "")).encode()).hexdigest()) for r in frame.collect())
        assert sorted((repr(r["doc_id"]), r["base_sha256"]) for r in pii.detect(frame).collect()) == expected
    assert pii.detect(empty).count() == 0
    assert pii.detect(odd, redact=True).where("redacted is null").count() == 2


# 4, 5


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def library_ids(tokenizer, text):
    return tokenizer[1].encode(text or "", add_special_tokens=False).ids


def test_word_encoder_is_the_library(tokenizer, documents):
    own, rng = token_ids.WordEncoder(tokenizer[0], max_words=50), random.Random(2)
    alphabet = "abcdABC'stmdlre .,!?0123²½_-\t\n \x85\x1céÉßŉǅİΣσ漢́’… |<>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t for t in ODD_TEXTS if t] + [r["text"] for r in documents.collect()]
    for text, raw in zip(texts, own.encode_all([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library_ids(tokenizer, text), text


def test_token_files_round_trip(spark, tmp_path, tokenizer, documents, odd, empty):
    for name, frame in (("documents", documents), ("odd", odd), ("empty", empty)):
        path = f"file://{tmp_path}/{name}"
        token_files.write_token_files(frame, path, tokenizer[0], end_id=2)
        got = token_files.read_token_files(spark, path).collect()
        expected = sorted(((r["doc_id"], library_ids(tokenizer, r["text"]) + [2]) for r in frame.collect()), key=repr)
        assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=repr) == expected
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert ids == sorted(ids, key=lambda d: (d is not None, d))
    some = token_files.read_token_files(spark, f"file://{tmp_path}/documents", doc_ids=[3, 7, -1])
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 7]
    many = [3, 7, *range(-20_000, 0, 2), *range(10**6, 10**6 + 20_000, 3), -(2**63), 2**63 - 1]
    some = token_files.read_token_files(spark, f"file://{tmp_path}/documents", doc_ids=many)
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 7]
    assert token_files.read_token_files(spark, f"file://{tmp_path}/documents", doc_ids=[]).count() == 0
    for n in (1, 2, 64, 65, 1000):
        ids = np.array(sorted(random.Random(n).sample(range(10**9), n)), "i8")
        ranges = token_files.id_ranges(ids)
        assert len(ranges) == min(n, 64) and sum(int(((ids >= a) & (ids <= b)).sum()) for a, b in ranges) == n


def check_packing(got, frame, tokenizer, capacity):
    pieces = []
    for r in frame.collect():
        ids = library_ids(tokenizer, r["text"]) + [0]
        pieces += [(r["doc_id"], i, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(pieces, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(p[3] for p in pieces)


def test_packing(tokenizer, documents, odd, empty):
    for capacity in (2048, 300):
        n, total = check_packing(packing.pack(documents.repartition(20), tokenizer[0], 0, capacity).collect(), documents, tokenizer, capacity)
        assert n <= math.ceil(total / capacity) * 1.02 + 1
    check_packing(packing.pack(odd, tokenizer[0], 0).collect(), odd, tokenizer, 2048)
    assert packing.pack(empty, tokenizer[0], 0).count() == 0


# 6, 9


def vectors(spark, n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, dim)) * np.exp(rng.standard_normal((n, 1)) * spread)
    data[::7] = data[0] + rng.standard_normal((len(data[::7]), dim)) * 0.1
    table = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(n, None), (n + 1, []), (n + 2, [1.0, float("nan")] * (dim // 2)), (n + 3, [0.0] * dim), (n + 4, [None] * dim), (n + 5, [float("inf")] * dim), (n + 6, [1.0, 2.0]), (None, [1.0] * dim), (None, [1.0] * dim), (4, table[4][1]), (100, table[0][1]), (100, table[33][1])]
    return spark.createDataFrame(table + odd, "vec_id long, embedding array<float>")


def brute(table, keep, modulus, k):
    usable = [(r["vec_id"], keep(r["v"])) for r in table.collect()]
    out = []
    for q, v in {(q, tuple(v)) for q, v in usable if q is not None and q % modulus == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v)]
        scored.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_exact_topk(spark, monkeypatch, spread):
    monkeypatch.setattr(exact_topk, "BUCKET", 64)
    table = exact_topk.integer_vectors(vectors(spark, 400, 16, 1, spread))
    got = exact_topk.search(table.where("vec_id % 50 = 0"), table, 5)
    expected = brute(table, list, 50, 5)
    assert rows(got) == expected and sum(q == 100 for q, *_ in expected) == 15


def test_one_bit_recall(spark, monkeypatch):
    monkeypatch.setattr(one_bit, "BLOCK", 300)
    table = one_bit.searchable(vectors(spark, 900, 32, 2, 0.3))
    got = one_bit.search(table.where("vec_id % 20 = 0"), table, 20).collect()
    exact = brute(table, list, 20, 20)
    pairs = {(q, i) for q, _, i, _ in exact}
    assert len(pairs & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.95 * len(pairs)
    assert sum(r["query_id"] == 100 for r in got) == 60 and max(Counter((r["query_id"], r["rank"]) for r in got if r["query_id"] != 100).values()) == 1
    scores = {(q, i): s for q, _, i, s in exact if q != 100}
    assert all(r["score"] == pytest.approx(scores.get((r["query_id"], r["vec_id"]), r["score"]), abs=1e-12) for r in got)


def test_searches_of_wide_components(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [-1e7, 0.0]), (3, [0.5, 0.5]), (4, [0.1, 0.7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with_short = table.where("vec_id > 2").unionByName(spark.createDataFrame([(0, [0.25, -0.5])], table.schema))
    # products of the long vectors exceed 2^53: only their order is certain
    found = exact_topk.integer_vectors(table)
    got = exact_topk.search(found.where("vec_id = 0"), found, 4).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 4, 2]
    found = exact_topk.integer_vectors(with_short)
    assert sorted(map(tuple, exact_topk.search(found.where("vec_id = 0"), found, 5).collect()), key=repr) == brute(found, list, 50, 5)
    found = one_bit.searchable(table)
    got = one_bit.search(found.where("vec_id = 0"), found, 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1e14 + 2), (3, 5e6 + 0.5), (4, 1e6 + 0.7), (2, -1e14)]


def test_equal_vectors_go_by_id(spark):
    same = [0.1 * i for i in range(13)]
    table = one_bit.searchable(spark.createDataFrame([(i, same) for i in range(60)], "vec_id long, embedding array<double>"))
    got = one_bit.search(table.where("vec_id = 0"), table, 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and len({r["score"] for r in got}) == 1

def test_search_rows_stay_small(spark):
    """A base block is sent once, a query block once a lane, and no row holds both; lanes don't follow the shuffle partitions."""
    from geoloom.llm import vectors as v

    base = spark.createDataFrame([((p << 32) + i, 2, b"b") for p in range(10) for i in range(4)], "block long, dim int, vectors binary")
    asked = spark.createDataFrame([(q, 2, b"q") for q in range(3)], "q_block long, dim int, q_vectors binary")
    met = v.meet(asked, base, 5).collect()
    assert sorted(r["block"] for r in met if not r["asks"]) == sorted(r["block"] for r in base.collect())
    assert sorted((r["lane"], r["q_block"]) for r in met if r["asks"]) == [(x, q) for x in range(5) for q in range(3)]
    assert not any(r["vectors"] and r["q_vectors"] for r in met)
    assert v.lanes(spark, 15_000_000, 8192) <= max(58, 4 * spark.sparkContext.defaultParallelism)


def test_block_files_are_cut_by_bytes(spark):
    """Few rows of megabytes each don't become one row group, which is read and written as a whole."""
    import pyarrow.parquet as pq

    from geoloom.llm.common import saved
    from geoloom.llm.vectors import SMALL_GROUPS

    made = saved(spark.createDataFrame([(i, os.urandom(1 << 20)) for i in range(24)], "block long, codes binary").coalesce(1), "codes", **SMALL_GROUPS)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 9


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.search(exact_topk.integer_vectors(none), exact_topk.integer_vectors(none)).count() == 0
    assert one_bit.search(one_bit.searchable(none), one_bit.searchable(none)).count() == 0


# 7


def test_token_count(spark, monkeypatch, documents, odd, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = token_count.load_model(path)
    monkeypatch.setattr(token_count, "HOT_PRETOKENS", 500)
    for frame in (documents, odd):
        expected = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in frame.collect())
        got = token_count.count_tokens(frame, path).collect()
        assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == expected
    assert token_count.count_tokens(empty, path).count() == 0


def test_pretokens_add_up():
    model, rng = token_count.load_model(queries.tokenizer_path("piece_bpe_32k.model")), random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab  \n\t▁<s>é漢́.\x00") for _ in range(rng.randint(0, 25)))
        assert sum(len(model.encode(p.decode())) if p else 1 for p in token_count.pretokens(text.encode())) == len(model.encode(text))


def test_hot_split(spark):
    table = spark.createDataFrame([(i, 1 + 1000 // (i + 1)) for i in range(100)], "key int, n int")
    hot, rest = hot_split(table, "n", 10)
    assert 0 < hot.count() <= 10 and hot.count() + rest.count() == 100
    assert hot.agg(F.min("n")).first()[0] >= rest.agg(F.max("n")).first()[0]


# 8


def test_quality_on_held_out(spark):
    got = queries.op8_quality(spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = got.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.97


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (odd, empty):
        stats = quality.with_statistics(frame, ["doc_id", "score"]).drop("score")
        model = quality.fit(quality.training_rows(stats, none, F.lit(True)))
        got = quality.with_scores(stats, model)
        assert got.count() == frame.count() and got.where("predicted = 0").count() == 0


def plain_statistics(text):
    words = [w for w in re.split(rb"[\t\n\x0b\x0c\r ]+", text) if w]
    n, size = len(words), max(len(text), 1)
    number = lambda pattern: len(re.findall(pattern, text))
    per_word = lambda x: x / n if n else 0.0
    root = lambda x: math.sqrt(min(x, 4.0))
    upper, letters = number(rb"[A-Z]"), number(rb"[A-Za-z]")
    again = sum(words[i] == words[i - 1] for i in range(1, n))
    return [
        math.log(1 + n), root(upper / letters if letters else 0.0), root(per_word(number(rb"!"))), root(per_word(number(rb"\|"))),
        root(per_word(number(rb"[#$%&*^~=<>{}\[\]\\_`]"))), root(per_word(again)), per_word(len(set(words))), math.log(1 + per_word(size)),
        root(per_word(number(rb"[.,]"))), root(per_word(number(rb"[0-9]"))), root(per_word(number(rb"\n"))), root(letters / size),
    ]


@pytest.mark.parametrize("with_odd", [False, True])
def test_op8_against_plain_densities(spark, odd, with_odd):
    """Scores equal those of densities computed without Spark, from whole covariance matrices and their inverses."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    frame = docs.select("doc_id", "text")
    if with_odd:
        long = spark.createDataFrame([(10**6, "x" * 2_000_000), (10**6 + 1, "long words " * 200_000)], "doc_id long, text string")
        frame = frame.unionByName(odd.select((F.col("doc_id") + 10**7).alias("doc_id"), "text")).unionByName(long)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    marks = {}
    for r in labels.collect():
        if r["quality"] in (0, 1):
            marks[r["doc_id"]] = min(r["quality"], marks.get(r["doc_id"], 1))
    texts = [(r["doc_id"], plain_statistics((r["text"] or "").encode())) for r in frame.collect()]
    parts = []
    for c in (0, 1):
        x = np.array([s for d, s in texts if marks.get(d) == c and not held(d)])
        cov = np.cov(x.T, bias=True)
        floor = np.maximum(np.diag(cov), quality.LEAST_SD**2)
        cov = (1 - quality.SHRINKAGE) * cov + np.diag(quality.SHRINKAGE * floor + 0.25 * quality.LEAST_SD**2)
        parts.append((len(x), x.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))
    expected = []
    for d, s in texts:
        logs = [math.log(n) - 0.5 * ((s - m) @ inverse @ (s - m) + det) for n, m, inverse, det in parts]
        expected.append((repr(d), 1 / (1 + math.exp(min(max(logs[0] - logs[1], -700), 700)))))
    stats = quality.with_statistics(frame, ["doc_id"])
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = quality.fit(quality.training_rows(stats, labels, ~held_out))
    got = quality.with_scores(stats, model).collect()
    assert [x[0] for x in sorted(expected)] == [x[0] for x in sorted((repr(r["doc_id"]), r["score"]) for r in got)]
    for (_, a), (_, b) in zip(sorted(expected), sorted((repr(r["doc_id"]), r["score"]) for r in got), strict=True):
        assert math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-9)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    if not with_odd:
        op8 = {r["doc_id"]: (r["held_out"], r["score"]) for r in queries.op8_quality(spark, SMALL).collect()}
        assert all(op8[int(d)][0] == held(int(d)) and math.isclose(op8[int(d)][1], s, rel_tol=1e-5, abs_tol=1e-9) for d, s in expected)


def test_quality_in_one_pass(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stats = quality.with_statistics(docs, ["doc_id"])
    model = quality.fit(quality.training_rows(stats, spark.read.parquet(f"{SMALL}/labels.parquet"), F.lit(True)))
    for frame in (docs, odd):
        expected = quality.with_scores(quality.with_statistics(frame, ["doc_id"]), model).collect()
        assert quality.with_text_scores(frame, ["doc_id"], model).collect() == expected


# 10


def brute_components(texts):
    import xxhash

    prints = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return prints


def closure(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(documents, odd, empty):
    for frame in (documents, odd):
        table = frame.select("doc_id", "text").collect()
        prints = brute_components([r["text"] for r in table])
        expected = sorted((repr(r["doc_id"]), f"{p:016x}", repr(c)) for r, p, c in zip(table, prints, closure(prints, [r["doc_id"] for r in table]), strict=True))
        assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in simhash.near_duplicates(frame).collect()) == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("run", [4096, 3])
def test_simhash_links(spark, monkeypatch, run):
    """Near fingerprints of all kinds; with a small RUN also the way for hot variants."""
    monkeypatch.setattr(simhash, "RUN", run)
    rng = random.Random(run)
    prints = [rng.getrandbits(64) for _ in range(25)]
    for p in list(prints):
        for _ in range(5):
            prints.append(p := p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
    prints += [prints[0] ^ (1 << i) for i in range(40)]
    prints = sorted(set(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.components(simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))).collect()
    roots = {r["node"]: r["root"] for r in got}
    classes = closure(prints, [signed(p) for p in prints])
    assert [roots.get(signed(p), signed(p)) for p in prints] == classes


# The pipeline


def near_groups(ids, texts):
    """The least id of each group of texts whose five-word shingle sets reach 0.8, by brute force."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return {min(d for d, g in zip(ids, group, strict=True) if g == x) for x in set(group)}


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SMALL)
        assert out.dtypes == docs.dtypes, name
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    good, single, hidden, mixed = ([tuple(r) for r in k.collect()] for k in kept[1:])
    everything = {tuple(r) for r in docs.collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
    assert set(good) <= everything and len(bad & {r[0] for r in good}) <= 0.1 * len(bad) and len(good) >= 0.6 * len(everything)
    ids, texts = [r[0] for r in good], [r[1] for r in good]
    assert {r[0] for r in single} == near_groups(ids, texts) and len(single) == len({r[0] for r in single})
    assert {r[0] for r in hidden} == {r[0] for r in single} and not any(base_spans(r[1]) for r in hidden)
    assert set(mixed) <= set(hidden)
    words = lambda t: len(t.split())
    sources = Counter()
    for r in hidden:
        sources[r[3]] += words(r[1])
    assert abs(sum(words(r[1]) for r in mixed) - sum(sources.values())) <= 0.1 * sum(sources.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SMALL).collect()
    assert sum(r["length"] for r in packed if r["piece"] == 0) > 0
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in mixed)


def test_pipeline_odd(spark, odd, empty):
    import corpus_pipeline

    for frame in (odd.select(*corpus_pipeline.COLUMNS), empty.select(*corpus_pipeline.COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SMALL)
            out.count()
            if out.columns == corpus_pipeline.COLUMNS:
                frame = spark.createDataFrame(out.collect(), frame.schema)


def five_word_closure(texts):
    """The smallest place of each text's group, by all pairs of five-word shingle sets."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    root = list(range(len(texts)))
    for _ in range(2):  # until nothing changes, for these small groups
        for i, x in enumerate(sets):
            for j in range(i):
                if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                    low = min(root[i], root[j])
                    root = [low if r in (root[i], root[j]) else r for r in root]
    return root


@pytest.mark.parametrize("run", [32, 2])
def test_pipeline_near_copies(spark, monkeypatch, run):
    """Pairs at 0.8 of any bit distance are found, with a small RUN also the way for long runs."""
    import corpus_pipeline
    from geoloom.llm import near_copies

    monkeypatch.setattr(near_copies, "RUN", run)
    rng = random.Random(run)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 150").collect()]
    for k in range(30):
        words = list(base)
        for at in rng.sample(range(200), k % 8 + 1):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    texts += ["", None, "a b", "A  b", "a b c"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    expected = {i for i, r in enumerate(five_word_closure(texts)) if i == r}
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_copy(spark, docs, SMALL).collect()} == expected
    prints = closure(brute_components(texts), list(range(len(texts))))
    assert expected < set(prints)  # two bits alone miss some


def test_near_copies_of_one_template(spark, monkeypatch):
    """Pages of one template, most of them just not near each other: all links, by far fewer pairs than there are."""
    import corpus_pipeline
    from geoloom.llm import near_copies

    monkeypatch.setattr(near_copies, "RUN", 8)
    compared = []
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda docs, rows, pairs: (compared.append(pairs.distinct().count()), verified(docs, rows, pairs))[1])
    rng = random.Random(1)
    texts = []
    for k in range(400):
        words = [f"w{i}" for i in range(64)]
        for at in rng.sample(range(64), 2):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    expected = {i for i, r in enumerate(five_word_closure(texts)) if i == r}
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_copy(spark, docs, SMALL).collect()} == expected
    assert sum(compared) < 400 * 399 / 2 / 3


def test_pipeline_rows_of_one_id(spark):
    """One id on different texts, and near copies without ids: one row a group stays."""
    import corpus_pipeline

    long = [f"w{i}" for i in range(60)]
    near = [" ".join([*long[:k], "other", *long[k + 1 :]]) for k in (0, 59)]
    rows = [(1, "one text"), (1, "another text"), (2, "another text"), (3, "A"), (3, "again A"), (None, near[0]), (None, near[1]), (None, "alone"), (None, "alone"), (4, "alone")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_copy(spark, docs, SMALL).collect()), key=repr)
    nameless = [r for r in got if r[0] is None]
    assert len(nameless) == 1 and nameless[0][1] in near
    assert [r for r in got if r[0] is not None] == [(1, "another text"), (1, "one text"), (3, "A"), (3, "again A"), (4, "alone")]


def test_op2_returns_the_order(spark):
    """Ranks follow positions, and all columns are those of the SQL."""
    import duckdb

    got = queries.op2_mix(spark, SMALL).collect()
    taken = sorted((r["first_rank"], r["position"], r["last_rank"]) for r in got if r["taken"])
    assert len(taken) > 50 and taken[0][0] == 0 and [p for _, p, _ in taken] == sorted(p for _, p, _ in taken)
    assert max(x[2] for x in taken) == sum(r["taken"] // r["size"] for r in got if r["taken"]) - 1
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = db.execute(queries.OP2_SQL)
    names = [c[0] for c in found.description]
    key = lambda r: tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in sorted(names))
    assert sorted(map(key, got), key=repr) == sorted((key(dict(zip(names, r, strict=True))) for r in found.fetchall()), key=repr)


def test_schedules_by_tenth_of_training(spark):
    """In each tenth of training a source has the share of its own words that its schedule's integral says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(6000)], "doc_id long, text string, source string")
    got = mixing.training_order(mixing.mix(docs)).select("source", "mix_position", "mix_size").collect()
    for source, schedule in zip("abc", mixing.SCHEDULES, strict=True):
        mine = [(r["mix_position"], r["mix_size"]) for r in got if r["source"] == source]
        total = sum(n for _, n in mine)
        weight = lambda t, w=schedule: w[0] + (w[1] - w[0]) * 2 * t if t < 0.5 else w[1] + (w[2] - w[1]) * (2 * t - 1)
        whole = sum(weight((k + 0.5) / 1000) for k in range(1000))
        for tenth in range(10):
            expected = sum(weight((k + 0.5) / 1000) for k in range(tenth * 100, tenth * 100 + 100)) / whole
            found = sum(n for p, n in mine if tenth / 10 <= p < (tenth + 1) / 10) / total
            assert abs(found - expected) < 0.02, (source, tenth)


def test_hot_keys_are_short(spark, monkeypatch):
    """Texts without blanks are one pre-token each and stay out of the broadcast table."""
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model, sent = token_count.load_model(path), []
    texts = ["漢字" * 3000, "QUJD" * 4000, "QUJD" * 4000, "a b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(docs, path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    lm = {r["doc_id"]: r["n_known"] for r in lm_score.score(docs, F.lit(False)).collect()}
    assert lm == {0: 2, 1: 2, 2: 2, 3: 3, 4: 1}
    tables = [x if isinstance(x, dict) else x.hot for x in sent if isinstance(x, (dict, lm_score.Lexicon))]
    assert len(tables) >= 2 and all(len(k or b"") <= 64 for t in tables for k in t)


def test_near_copies_leave_no_scratch(spark):
    """Shuffle files and tables go when they are spent, and texts that stay for sure are not shuffled."""
    import corpus_pipeline
    from geoloom.llm import common

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    common.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert files() <= before
    words = [f"w{i * 7919 % 1009}" for i in range(900)]
    texts = [" ".join(words[i * 40 : i * 40 + 60]) for i in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[3] + " end", texts[5]])] + [(7, texts[7], "en", "s", len(texts[7]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    folder = common.shared_dir(spark).removeprefix("file://")
    old = set(os.listdir(folder))
    kept = corpus_pipeline.keep_one_copy(spark, docs, "")
    made = {x.rpartition("-")[0].split("-")[0] for x in set(os.listdir(folder)) - old}
    assert not made & {"sets", "pairs", "possible", "needed", "meetings", "groups"}
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    # only what the filter can't tell is dealt by its hash
    keyed = docs.select("doc_id").withColumn("row", F.col("doc_id").cast("string"))
    marks = common.marked_by(keyed, "row", common.row_bits(keyed.where("doc_id < 4"), "row"))
    assert {r["doc_id"] for r in marks.where("_maybe").collect()} == {0, 1, 2, 3}
