"""Near copies of the pipeline by brute force over exact five-word Jaccard similarities."""

from __future__ import annotations

import random
import tracemalloc
import weakref

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from lamplight.llm import hashing, near_copies, packing, simhash, tokens
from test_texts import prose, ran


def shingles(text):
    words = simhash._GAP.sub(" ", (text or "").lower()).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(texts):
    """The smallest id of each group that chains of similar pairs join; ``texts`` are by id."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, left, kept = {}, set(sets), set()
    for i, own in sets.items():
        for gram in own or [None]:
            holders.setdefault(gram, []).append(i)

    def similar(i):
        shared = {}
        for gram in sets[i] or [None]:
            for j in holders[gram]:
                shared[j] = shared.get(j, 0) + 1
        return [j for j, n in shared.items() if not sets[i] or 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]

    for i in sorted(sets):
        if i in left:
            kept.add(i)
            frontier = [i]
            left.discard(i)
            while frontier:
                near = [j for j in similar(frontier.pop()) if j in left]
                left.difference_update(near)
                frontier += near
    return kept


def corpus(rng):
    rows = [None, "", " \t", "Two words", "two  WORDS", "one two three four five", "One two three four five six"]
    line = prose(rng, 12)
    for _ in range(30):  # a common line in texts that are not alike otherwise
        rows.append(f"{prose(rng, 14)} {line}")
    for copies, changes in ((60, 1), (60, 3), (40, 6)):  # pairs under, at and over the bound, and chains of them
        centre = prose(rng, 150).split()
        for _ in range(copies):
            words = list(centre)
            for at in rng.sample(range(150), rng.randint(0, changes)):
                words[at] = prose(rng, 1) + "x"
            rows.append(" ".join(words))
    walk = prose(rng, 150).split()
    for step in range(40):
        walk[(7 * step) % 150] = f"w{step}"
        rows.append(" ".join(walk))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [8, 0])
def test_keeps_one_of_each_group(docs, monkeypatch, few):
    monkeypatch.setattr(near_copies, "FEW", few)
    texts = dict(enumerate(corpus(random.Random(few))))
    df = docs(list(texts.items()))
    kept = near_copies.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(survivors(texts))


def test_a_line_of_many_unlike_texts_makes_few_pairs(spark, docs, monkeypatch):
    """5,000 short texts that share a line which is most of their prefix: without a bound 12 million pairs."""
    rng = random.Random(11)
    line = " ".join(f"line{i}" for i in range(60))
    rows = [(i, f"{line} {' '.join(f'own{i}x{k}' for k in range(rng.randint(14, 40)))}") for i in range(5_000)]
    made = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: made.append(pairs.count()) or verified(pairs, *more))
    got = near_copies.one_of_each(docs(rows)).count()
    assert got == len(survivors(dict(rows))) == 5_000
    assert sum(made) < 50_000


def test_blocks_of_a_crowded_shingle(docs, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    monkeypatch.setattr(near_copies, "FEW", 1e9)
    texts = dict(enumerate(corpus(random.Random(3))))
    got = near_copies.one_of_each(docs(list(texts.items())))
    assert sorted(r.doc_id for r in got.collect()) == sorted(survivors(texts))


def test_edges(docs):
    rows = [(5, "same text here now"), (3, "same text here now"), (3, "same text here now"), (None, "Same text here now"), (7, None), (8, "")]
    df = docs(rows)
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == [3, 7]
    assert near_copies.one_of_each(df.limit(0)).count() == 0
    assert near_copies.one_of_each(docs([(None, "a b c"), (None, "a b c")])).count() == 1


def test_pipeline_stage_finds_what_is_at_the_bound(spark, docs):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rng = random.Random(5)
    base = prose(rng, 400).split()
    near = list(base)
    for at in range(10, 400, 60):  # seven changed words: 35 of 396 shingles differ on either side
        near[at] = f"w{at}"
    a, b = shingles(" ".join(base)), shingles(" ".join(near))
    assert 0.8 <= len(a & b) / len(a | b) < 0.9
    assert (simhash.fingerprint_of(" ".join(base)) ^ simhash.fingerprint_of(" ".join(near))).bit_count() > simhash.DISTANCE
    df = docs([(1, " ".join(base)), (2, " ".join(near)), (3, prose(rng, 200))])
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == [1, 3]


def test_given_tables(spark):
    from pathlib import Path

    folder = Path("/root/testdata/sf0.01/documents.parquet")
    if not folder.exists():
        pytest.skip("no test tables")
    df = spark.read.parquet(str(folder))
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    got = near_copies.one_of_each(df).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(survivors(texts))


def alike(rng):
    """Texts by id: 1 and 2 with near fingerprints, 3 and 4 at the bound with distant ones, the others unlike."""
    one, two = prose(rng, 400).split(), prose(rng, 400).split()
    rows = {1: one, 2: [*one[:-1], "changed"], 3: two, 4: list(two)}
    for at in range(10, 400, 60):
        rows[4][at] = f"w{at}"
    rows |= {i: prose(rng, 60).split() for i in range(5, 305)}
    texts = {i: " ".join(words) for i, words in rows.items()}
    apart = lambda i, j: (simhash.fingerprint_of(texts[i]) ^ simhash.fingerprint_of(texts[j])).bit_count()
    assert apart(1, 2) <= simhash.DISTANCE < apart(3, 4)
    return texts


def test_simhash_gives_the_first_candidates(spark, docs, monkeypatch):
    import corpus_pipeline

    texts = alike(random.Random(9))
    made = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: made.append({(r.a, r.b) for r in pairs.collect()}) or verified(pairs, *more))
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs(list(texts.items())), "")
    pair = lambda i, j: tuple(sorted(near_copies.class_of(near_copies.shingles_of(texts[k])) for k in (i, j)))
    assert pair(1, 2) in made[0] and pair(3, 4) not in made[0]
    assert not any(pair(1, 2) in later for later in made[1:])  # contracted, never met again
    assert any(pair(3, 4) in later for later in made[1:])
    assert {r.doc_id for r in got.collect()} == survivors(texts) == set(texts) - {2, 4}


def test_sets_are_made_of_the_texts_of_pairs_only(docs, monkeypatch):
    texts = alike(random.Random(10))
    made = []
    asked = near_copies._asked
    monkeypatch.setattr(near_copies, "_asked", lambda *more: made.append(asked(*more).count()) or asked(*more))
    assert near_copies.one_of_each(docs(list(texts.items()))).count() == len(texts) - 2
    assert 4 <= sum(made) < 30


def test_variants_are_dealt_out(spark):
    """Fingerprints grouped by themselves lie in few partitions, which would make 66 rows of each."""
    prints = spark.range(1000).selectExpr("id % 500 AS fp").groupBy("fp").count().select("fp")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_a_worker_lets_go_of_what_packing_keeps(docs, monkeypatch):
    """Workers are used by the tasks of all stages, so what one stage keeps in them would count in every later one."""
    run = []
    df = docs([(1, "some words")]).selectExpr("doc_id AS id", "text")
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, made, schema: run.append(made) or self)
    near_copies._read(df, ([], []))
    held = weakref.ref(tokens.encoder(packing.tokenizer_path()))
    assert held() is tokens.encoder(packing.tokenizer_path())
    (read,) = list(run[0](iter([pd.DataFrame({"id": [1], "text": ["some words"]})])))
    assert read["n"].tolist() == [1] and held() is None


def test_tokens_of_long_texts_take_little_memory_on_the_way(monkeypatch):
    """1.8 million characters: 64 MB where all are hashed and compared at once, 34 MB piece by piece."""
    monkeypatch.setattr(hashing, "_POWERS", hashing._Powers())
    rng = random.Random(4)
    words = [prose(rng, 1) + str(i) for i in range(3_000)]
    texts = [" ".join(rng.choices(words, k=1_000)) for _ in range(200)]
    coder = tokens.Encoder(packing.tokenizer_path())
    tracemalloc.start()
    try:
        found = coder.ids(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    assert [ids.tolist() for ids in found] == [c.ids for c in plain.encode_batch(texts, add_special_tokens=False)]
    assert most < 45e6


def test_classes_are_made_once_where_rows_are_kept(docs):
    """Made twice, one after the other, they took two workers a task, which were kept for all later stages."""
    plan = near_copies.one_of_each(docs([(1, "some words"), (2, "Some words"), (3, "others")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_what_is_many_times_its_source_is_not_broadcast(spark):
    """Blocks of a crowded shingle seem as small as what they are made from; none may pass through the driver."""
    labelled = spark.range(200).selectExpr("id % 2 AS key", "id AS node", "10L AS n", "9L AS rest", "id AS c")
    assert "SortMergeJoin" in (plan := ran(near_copies._across(labelled))) and "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" not in ran(near_copies._ends(labelled.drop("c"), labelled["node"]))


def test_sketches_rule_out_unlike_pairs_only(spark):
    rng = random.Random(11)
    pool = [rng.getrandbits(64) for _ in range(3_000)]
    sets = []
    for n in (1, 2, 3, 31, 32, 33, 60, 64, 65, 127, 129, 400, 1000):
        own = rng.sample(pool, n)
        sets += [own, rng.sample(pool, n), own[: max(1, n * 4 // 5)], own[: -(-n * 9 // 10)], own + [rng.getrandbits(64) for _ in range(n // 4)]]
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    homes = spark.createDataFrame([(i, i, len(s), near_copies._sketch(s).tolist()) for i, s in enumerate(sets)], "node long, home long, n long, bits array<long>")
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    scratch = near_copies.Scratch(spark, "test")
    likely = {(r.a, r.b) for r in near_copies._likely(spark.createDataFrame(pairs, "a long, b long"), homes, scratch).collect()}
    similarity = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in pairs}
    assert {p for p, s in similarity.items() if s >= 0.8} <= likely
    assert not [p for p in likely if similarity[p] < 0.5 and len(sets[p[0]]) >= 60]


def test_sets_are_not_made_of_unlike_texts_that_share_shingles(docs, monkeypatch):
    rng = random.Random(12)
    texts = {}
    for i in range(0, 80, 2):  # pairs of texts that share two fifths of their shingles, and so some of their first ones
        words = prose(rng, 60)
        texts |= {i: f"{words} {prose(rng, 40)}", i + 1: f"{words} {prose(rng, 40)}"}
    made = []
    asked = near_copies._asked
    monkeypatch.setattr(near_copies, "_asked", lambda *more: made.append(asked(*more).count()) or asked(*more))
    met = []
    verified = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: met.append(pairs.count()) or verified(pairs, *more))
    assert near_copies.one_of_each(docs(list(texts.items()))).count() == 80
    assert sum(met) > 20 and sum(made) < 10


def test_pairs_are_settled_in_turns(docs, monkeypatch):
    monkeypatch.setattr(near_copies, "LEAST_PAIRS", 4)
    monkeypatch.setattr(near_copies, "CLASSES_A_PAIR", 1_000)
    turns = []
    settled = near_copies._settled
    monkeypatch.setattr(near_copies, "_settled", lambda pairs, *more: turns.append(pairs.count()) or settled(pairs, *more))
    rng = random.Random(4)
    words = prose(rng, 150).split()
    texts = {i: " ".join([*words[: 12 * i], f"w{i}", *words[12 * i + 1 :]]) for i in range(9)} | {9: prose(rng, 60)}
    assert {r.doc_id for r in near_copies.one_of_each(docs(list(texts.items()))).collect()} == survivors(texts) == {0, 9}
    assert len(turns) > 1
