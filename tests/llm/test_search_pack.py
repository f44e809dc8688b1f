"""Packing, repeats, vector search, decontamination, pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamplight.llm import decontamination, packing, repeats, simhash, toxicity, vector_search
from test_near_copies import survivors
from test_texts import prose


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(packing.tokenizer_path())


def check_pieces(rows, ids, limits, text_ids):
    """Each id in exactly one piece, sequences gapless and within their limits."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(text_ids[doc])
            part = np.array(text_ids[doc][at : at + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(text_ids[doc])
    padding = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(own) <= limits.segments and sum(r["loss_tokens"] for r in own) <= limits.loss
        assert {r["padding"] for r in own} == {0 if at & (at - 1) == 0 else limits.tokens - at}
        padding += own[0]["padding"]
    return padding


TEXTS = [
    None, "", " ", "a", "Hello, World. It's 2 o'clock\tnow\x1cthen end", "ÉCOLE été Straße İstanbul ΣΑΣ é ﬁ ①", "x.. ,, a,b. don't!",
    "<|endoftext|> and <|startoftext|>x", "日本語 text 😀😀", "word " * 5000, "a" * 3000, "\r\n\x0b\x0c \x85  ",
]


def test_equal_hashes_of_other_bytes(plain):
    """A Thue-Morse string and its complement have one polynomial hash modulo 2 ** 64."""
    from lamplight.llm.tokens import Encoder

    coder = Encoder(packing.tokenizer_path())
    for size in (1_024, 2_048, 4_096):
        one = "".join("ab"[i.bit_count() % 2] for i in range(size))
        texts = [one, one.translate(str.maketrans("ab", "ba")), f"x {one} y", one]
        for got, text in zip(coder.ids(texts), texts):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers(plain):
    from lamplight.llm.tokens import Encoder

    coder = Encoder(packing.tokenizer_path())
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        assert [i.tolist() for i in coder.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_is_bounded(monkeypatch, plain):
    from lamplight.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 20)
    from lamplight.llm import tokens

    coder = tokens.Encoder(packing.tokenizer_path())
    rng = random.Random(0)
    for _ in range(5):
        text = prose(rng, 60)
        assert coder.ids([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(coder.known) < 200


def test_packing(spark, docs, plain):
    rng = random.Random(2)
    texts = dict(enumerate([*TEXTS, *[prose(rng, rng.randint(1, 900)) for _ in range(60)]]))
    text_ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    df = docs(list(texts.items()))
    for limits in (packing.Limits(), packing.Limits(64, 3, 50), packing.Limits(100, 1, 100)):
        rows = [r.asDict() for r in packing.sequences(df, ["doc_id"], limits=limits).collect()]
        padding = check_pieces(rows, None, limits, text_ids)
        if limits == packing.Limits():
            assert padding == 0
    half = df.withColumn("prompt", F.when(F.col("doc_id") % 2 == 0, 40))
    limits = packing.Limits(256, 8, 128)
    rows = [r.asDict() for r in packing.sequences(half, ["doc_id"], loss_from="prompt", limits=limits, with_ids=True).collect()]
    check_pieces(rows, None, limits, text_ids)
    assert all(r["ids"] == text_ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in rows)
    assert all(r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], 0 if r["doc_id"] % 2 else 40)) for r in rows)


def test_packing_edge_cases(spark, docs):
    df = docs([(1, "a b"), (1, "a b"), (None, "c"), (2**60 + 1, None)])
    rows = packing.sequences(df, ["doc_id", "lang"]).collect()
    assert Counter(r.doc_id for r in rows)[None] >= 1 and {r.doc_id for r in rows} == {1, None, 2**60 + 1}
    assert sum(r.length for r in rows) == 3 + 3 + 2 + 1
    assert packing.sequences(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        packing.sequences(df.withColumnRenamed("n", "offset"), ["offset"])
    with pytest.raises(ValueError):
        packing.Limits(0)


def brute_repeats(rows, length, keep_first):
    """rows: (id, bytes), first occurrences in id order; returns removed bytes and the kept text of each."""
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    met = set()
    out = {}
    for doc, b in sorted(rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if (w in met) if keep_first else seen[w] > 1:
                gone[i : i + length] = True
            met.add(w)
        runs = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out[doc] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("group", [1, 256])
def test_repeats(spark, docs, monkeypatch, keep_first, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(4)
    shared = [prose(rng, 30) for _ in range(4)]
    texts = [None, "", "short", "é" * 700, "ab" * 400, shared[0], shared[0]]
    for i in range(40):
        body = prose(rng, rng.randint(5, 60))
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            cut = rng.randint(0, 40)
            body = f"{body} {s[cut : cut + rng.randint(60, 150)]} {prose(rng, 5)}"
        texts.append(body)
    texts.append(texts[-1][:90] + texts[-1])
    rows = list(enumerate(texts))
    length = 80
    expected = brute_repeats([(i, (t or "").encode()) for i, t in rows], length, keep_first)
    got = repeats.remove_repeats(docs(rows), length=length, keep_first=keep_first).collect()
    for r in got:
        x = r.repeats
        n, removed, runs, kept = expected[r.doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) == (n, removed, runs, kept), (r.doc_id, r.text)
        assert x.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert len(got) == len(rows)


def test_repeats_edge_cases(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)  # long texts are cut
    rng = random.Random(9)
    long = prose(rng, 900)
    df = docs([(1, long), (None, long), (2, long[1000:3000]), (3, "x"), (3, "x")])
    got = {r.doc_id: r.repeats for r in repeats.remove_repeats(df, keep_first=False).collect()}
    assert got[1].n_removed == got[None].n_removed == len(long) and got[2].n_removed == 2000 and got[3].n_removed == 0
    first = {r.doc_id: r.repeats for r in repeats.remove_repeats(df).collect()}
    assert first[None].n_removed == 0 and first[1].n_removed == len(long) and first[2].n_removed == 2000
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(df.withColumnRenamed("n", "repeats"))


def test_longest_previous_factor():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 60)
    order, ranks = repeats.suffix_array(text, 64)
    assert order.tolist() == sorted(range(60), key=lambda i: text[i:].tolist())
    prefix = repeats.common_prefixes(order, ranks, 64)
    lpf = repeats.longest_previous_factor(order, prefix, np.arange(60))
    match = lambda i, j: next((k for k in range(60 - i) if text[i + k] != text[j + k]), 60 - i)
    assert lpf.tolist() == [max([0, *(match(i, j) for j in range(i))]) for i in range(60)]


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e300])
def test_vector_search(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_search, "CANDIDATES", 40)
    monkeypatch.setattr(vector_search, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=20 if i % 9 else 12) * scale).tolist(), "x") for i in range(150)]
    rows += [(150 + i, rows[i % 3][1], "x") for i in range(30)]  # ties
    rows += [(300, None, "x"), (301, [1.0, None], "x"), (302, [float("nan")], "x"), (303, [float("inf")], "x"), (None, [1.0], "x"), (304, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in vector_search.top_k(df.filter("vec_id % 10 = 0"), df, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    ints = {i: [clip(int(np.floor(1024.0 * x))) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in ints if i % 10 == 0]:
        scores = sorted((-clip(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in ints.items() if i != q)[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert vector_search.top_k(df.limit(0), df, 3).count() == 0 == vector_search.top_k(df, df.limit(0), 3).count()
    with pytest.raises(ValueError):
        vector_search.top_k(df, df, 0)


def test_copies_of_query_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 40)
    df = spark.range(400).selectExpr("id AS vec_id", "array(double(id % 7), 1.0D) AS embedding")
    best = vector_search.top_k(df.filter("vec_id % 100 = 0"), df, 3)
    assert best.count() == 12
    best.collect()
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_few_query_blocks_move_candidates_few_times(spark):
    """Candidates are moved once for each block of queries: 5,000 queries were five blocks."""
    df = spark.range(6_000).selectExpr("id AS vec_id", "array(double(id % 7)) AS embedding")
    best = vector_search.top_k(df.filter("vec_id < 5000"), df.filter("vec_id < 10"), 1)
    assert "sequence(0, 0)" in best._jdf.queryExecution().analyzed().toString() or "sequence(0, 0," in best._jdf.queryExecution().analyzed().toString()


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    return [f"{prose(rng, rng.randint(8, 40)).capitalize()}. {prose(rng, rng.randint(6, 12)).capitalize()}." for _ in range(40)]


def test_wand_finds_all(items):
    index = decontamination.Index([*items, "one two", "dup text of some length here", "dup text of some length here"])
    rng = random.Random(6)
    for _ in range(200):
        own = set()
        for item in rng.sample(items, 2):
            words = decontamination.words(item)
            own |= set(rng.sample(words, rng.randint(1, len(words))))
        sums = Counter()
        for w in own & index.postings.keys():
            for i, x in zip(*index.postings[w][:2]):
                sums[i] += x
        assert {i for i, s in sums.items() if s >= 0.5 - 1e-9} == {i for i, _ in index.search(own)}


def holds(text, item):
    """Whether 0.8 of the shingles of an item, or of a question or answer with at least eight, are in a text."""
    held = decontamination.shingles(decontamination.words(text))
    whole, *halves = [decontamination.shingles(decontamination.words(t)) for t in (item, *decontamination.parts(item))]
    return any(s and len(s & held) / len(s) >= 0.8 for s in [whole, *[h for h in halves if len(h) >= 8]])


def test_decontamination(spark, docs, items, monkeypatch):
    rng = random.Random(7)
    rows = [(None, items[0]), (1, None), (2, ""), (3, prose(rng, 3000) + " " + items[3].upper() + " " + prose(rng, 3000))]
    rows += [(4, items[4] + items[5]), (4, items[4] + items[5]), (6, prose(rng, 500)), (7, items[6][: len(items[6]) // 2])]
    question, answer = next(decontamination.parts(t) for t in items if len(decontamination.words(decontamination.parts(t)[1])) >= 12)
    rows += [(8, f"{prose(rng, 400)} {question} {prose(rng, 400)}"), (9, f"{prose(rng, 400)} {answer} {prose(rng, 400)}")]
    rows += [(100 + i, f"{prose(rng, rng.randint(0, 300))} {rng.choice(items)} {prose(rng, rng.randint(0, 300))}") for i in range(40)]
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (None, None), (77, ""), (78, "!!")], "item_id long, text string")
    df = docs(rows)
    expected = Counter()
    for i, t in rows:
        expected.update((i, k) for k, item in enumerate(items) if holds(t or "", item))
    assert {8, 9} <= {i for i, _ in expected}
    for size in (decontamination.PART_BYTES, 500):
        monkeypatch.setattr(decontamination, "PART_BYTES", size)
        got = decontamination.matches(df, bench).collect()
        assert Counter((r.doc_id, r.item_id) for r in got) == expected
        clean = df.filter(decontamination.is_clean(bench))
        assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in expected}
    assert decontamination.matches(df, bench.limit(0)).count() == 0 == decontamination.matches(df.limit(0), bench).count()
    assert df.filter(decontamination.is_clean(bench.limit(0))).count() == len(rows)


def test_pipeline_by_brute_force(spark, tiny, plain):
    import corpus_pipeline
    from lamplight.llm import pii

    rows = [r.asDict() for r in corpus_pipeline.run(spark, tiny).collect()]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet").filter(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if model.score([t])[0] < 0.5}
    kept = survivors(texts)  # one of each group of five-word Jaccard similarity 0.8 or more
    bench = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(holds(texts[i], item) for item in bench)}
    left = docs.filter(F.col("doc_id").isin(sorted(kept)))
    redacted = {r.doc_id: r.text for r in pii.redact(left).collect()}
    text_ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in redacted.items()}
    assert {r["doc_id"] for r in rows} == kept
    check_pieces(rows, None, packing.Limits(), text_ids)


def test_stages_keep_columns(spark, tiny, docs):
    import corpus_pipeline

    source = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, source.limit(0), tiny).columns == source.columns, name
        assert stage(spark, source, tiny).schema == source.schema, name


def test_words_with_marks_are_encoded_as_words(plain):
    """Runs of marks after a word are a word of their own, so only what the tokenizer may cut elsewhere is given to it whole."""
    from lamplight.llm import tokens

    coder = tokens.Encoder(packing.tokenizer_path())
    whole = []
    encode = coder.encode
    coder.encode = lambda texts, **more: whole.extend(texts) or encode(texts, **more)
    marks = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
    simple = [f"{word}{run}" for word in ("word", "ßöäÿé", "s", "re") for run in ("", *marks, "...", "%%%", "&&&", "!?", marks)]
    odd = ["it's", "x.'s", "a'", "a.b", "(a)", "f(x)", "a<", "a|", "a<|endoftext|>", "naïve1.", "日本.", "÷a", "a÷", "é.", "a.<"]
    for texts in (simple, odd, [" ".join(simple + odd), " ".join(odd + simple)]):
        assert [i.tolist() for i in coder.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not set(whole) & set(simple)
