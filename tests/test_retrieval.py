"""Retrieval over a small hand-made channel, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamplight import schemas
from lamplight.functions.providers import LexicalEmbedder, OverlapReranker
from lamplight.operators import fusion, neighbours, positions, scoring
from lamplight.operators.scoring import Question
from lamplight.plans import search

DIM = 4


def corpus_rows(n=60, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        channel = "a" if i % 3 else "b"
        vector = [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(DIM)]
        if not any(vector):
            vector[0] = 1.0
        sparse = {r.randrange(6): float(r.randrange(1, 4)) for _ in range(r.randrange(0, 4))}
        rows.append((f"c{i:02d}", channel, f"r{i % 4}", i // 7 + 1, i % 7, f"text {i}", vector, sparse))
    return rows


@pytest.fixture(scope="module")
def chunks(spark):
    ddl = (
        "id string, channel_id string, report_id string, page_number int, chunk_index int, content string,"
        " embedding array<float>, sparse_embedding map<int,float>"
    )
    return spark.createDataFrame(corpus_rows(), ddl).repartition(5).cache()


QUESTION = Question(0, "text 7", (1.0, 0.5, 0.0, -1.0), {1: 2.0, 4: 1.0})


def brute(question, channel, k, zero=False):
    rows = [r for r in corpus_rows() if r[1] == channel]
    q = np.array(question.dense)
    dense = []
    for r in rows:
        v = np.array(r[6])
        dense.append((round(1 - v @ q / (np.linalg.norm(v) * np.linalg.norm(q)), 9), r[0]))
    sparse = [(-sum(w * question.sparse.get(t, 0) for t, w in r[7].items()), r[0]) for r in rows]
    if not zero:
        sparse = [s for s in sparse if s[0] < 0]
    return [i for _, i in sorted(dense)[:k]], [i for _, i in sorted(sparse)[:k]]


@pytest.mark.parametrize("zero", [False, True])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_arms_match_brute_force(chunks, k, zero):
    found = scoring.candidates(search.in_scope(chunks, "a"), [QUESTION], k, zero_overlap=zero)
    rows = scoring.ranked(found, k).orderBy("arm", "rank").collect()
    arms = {a: [r["id"] for r in rows if r["arm"] == a] for a in ("dense", "sparse")}
    assert (arms["dense"], arms["sparse"]) == brute(QUESTION, "a", k, zero)


def test_questions_of_two_channels_share_a_scan(chunks):
    asked = [
        Question("x", "", QUESTION.dense, QUESTION.sparse, "a"),
        Question("y", "", (0.0, 1.0, 1.0, 0.0), {0: 1.0}, "b"),
        Question("z", "", (0.0, 0.0, 1.0, 0.0), {}, "b"),
    ]
    found = scoring.candidates(chunks, asked, 6, scope=F.col("channel_id"))
    rows = scoring.ranked(found, 6).collect()
    for q in asked:
        for arm, expected in zip(("dense", "sparse"), brute(q, q.scope, 6, True)):
            got = sorted((r["rank"], r["id"]) for r in rows if r["question_id"] == q.question_id and r["arm"] == arm)
            assert [i for _, i in got] == expected


def test_more_questions_than_one_pass(chunks, monkeypatch):
    monkeypatch.setattr(scoring, "QUESTIONS_PER_PASS", 2)
    asked = [Question(n, "", tuple(np.roll(QUESTION.dense, n)), {n: 1.0}, "a") for n in range(5)]
    rows = scoring.ranked(scoring.candidates(chunks, asked, 3, scope=F.col("channel_id")), 3).collect()
    assert {r["question_id"] for r in rows} == set(range(5))


def test_wrong_dimension_fails(chunks):
    short = Question(0, "", (1.0, 0.0), {})
    with pytest.raises(Exception, match="2 numbers"):
        scoring.candidates(chunks, [short], 3, sparse=False).collect()


def test_alpha_one_is_dense_order(chunks):
    rows = search.hybrid_query(chunks, "text 7", "a", question=QUESTION, alpha=1.0, neighbours=0, rerank=False, top_k=8)
    got = [r["id"] for r in rows.orderBy("primary_rank").collect()]
    assert got == brute(QUESTION, "a", 8)[0]


def test_result_stays_in_channel_and_has_its_neighbours(chunks):
    rows = search.hybrid_query(chunks, "text 7", "a", question=QUESTION, reranker=OverlapReranker(), top_k=5, neighbours=2)
    got = search.in_display_order(rows).collect()
    assert {r["channel_id"] for r in got} == {"a"}
    primary = [r for r in got if not r["is_neighbour"]]
    assert len(primary) == 5 and sorted(r["primary_rank"] for r in primary) == [1, 2, 3, 4, 5]
    ids = {r["id"] for r in primary}
    assert all(r["neighbour_of"] in ids and r["id"] not in ids for r in got if r["is_neighbour"])
    assert [r["position"] for r in got] == list(range(1, len(got) + 1))


def test_guards(spark, chunks):
    blank = search.hybrid_query(chunks, "  ", "a")
    assert blank.count() == 0 and blank.columns == spark.createDataFrame([], schemas.RESULT).columns
    for bad in (dict(alpha=-0.1), dict(alpha=1.1), dict(prf_beta=1.0), dict(neighbours=-1)):
        with pytest.raises(ValueError):
            search.hybrid_query(chunks, "q", "a", question=QUESTION, **bad)
    with pytest.raises(ValueError):
        search.hybrid_query(chunks, "q", " ", question=QUESTION)
    with pytest.raises(RuntimeError):
        search.hybrid_query(chunks, "q", "a")


def test_pool_sizes():
    assert [fusion.pool_size(*a) for a in ((10, 50, True), (30, 50, True), (30, 50, False), (60, 50, False))] == [50, 90, 50, 60]


def test_feedback_moves_the_question(chunks):
    corpus = search.in_scope(chunks, "a")
    moved = search.expanded_question(corpus, QUESTION, search.first_stage(corpus, [QUESTION]), 0.3, 5)
    first, second = brute(QUESTION, "a", 50)
    score = {}
    for ranks in (first, second):
        for n, i in enumerate(ranks, 1):
            score[i] = score.get(i, 0) + 0.5 / (60 + n)
    best = sorted(score, key=lambda i: (-score[i], i))[:5]
    vector = {r[0]: np.array(r[6]) for r in corpus_rows()}
    mixed = 0.7 * np.array(QUESTION.dense) + 0.3 * np.mean([vector[i] for i in best], axis=0)
    assert np.allclose(moved.dense, mixed / np.linalg.norm(mixed), atol=1e-6)
    assert moved.sparse == QUESTION.sparse


CASES = [
    ([4], 1, [3, 4, 5]),
    ([1], 1, [1, 2]),
    ([3, 5], 1, [2, 3, 4, 4, 5, 6]),
    ([4, 3], 1, [4, 5, 2, 3]),
    ([4], 0, [4]),
]


@pytest.mark.parametrize("parents,n,expected", CASES)
def test_neighbour_sequences(spark, parents, n, expected):
    chunks = spark.createDataFrame(
        [(f"p{i}", "c", "r", i // 2 + 1, i % 2, f"t{i}") for i in range(1, 8)],
        "id string, channel_id string, report_id string, page_number int, chunk_index int, content string",
    )
    order = {f"p{p}": k for k, p in enumerate(parents, 1)}
    hits = chunks.where(F.col("id").isin(*order)).withColumn("question_id", F.lit(0))
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    hits = hits.withColumn("primary_rank", rank[F.col("id")])
    # Pages hold (1), (2, 3), (4, 5), (6, 7); inside a page the even one is first.
    rows = neighbours.attach(hits, chunks, n, bounded=True).orderBy("position").collect()
    assert [int(r["id"][1:]) for r in rows] == expected
    assert [r["is_neighbour"] for r in rows] == [r["id"] not in order for r in rows]


def test_neighbours_of_two_reports(spark):
    chunks = spark.createDataFrame(
        [(f"{r}{i}", "c", r, 1, i, "t") for r in ("R", "S") for i in range(1, 8)],
        "id string, channel_id string, report_id string, page_number int, chunk_index int, content string",
    )
    hits = chunks.where(F.col("id").isin("R2", "S2", "R6")).withColumn("question_id", F.lit(0))
    hits = hits.withColumn("primary_rank", F.expr("case id when 'R2' then 1 when 'S2' then 2 else 3 end"))
    rows = neighbours.attach(hits, chunks, 1, bounded=True).orderBy("position").collect()
    assert [r["id"] for r in rows] == ["R1", "R2", "R3", "R5", "R6", "R7", "S1", "S2", "S3"]


@pytest.mark.parametrize("tile", [2, 3, 4096])
def test_positions_over_tiles(spark, tile):
    r = random.Random(5)
    rows = [(g, p, c) for g in "ab" for p in range(1, 9) for c in r.sample(range(20), 5)]
    df = spark.createDataFrame(rows, "g string, p int, c int")
    got = positions.tiled_positions(df, ["g"], "p", "c", tile=tile).collect()
    for g in "ab":
        ordered = sorted((x["p"], x["c"], x["pos"]) for x in got if x["g"] == g)
        assert [x[2] for x in ordered] == list(range(1, 41))


def test_many_questions_from_a_table(spark, chunks, monkeypatch, tmp_path):
    monkeypatch.setattr(scoring, "QUESTIONS_PER_PASS", 2)
    asked = spark.createDataFrame(
        [(n, f"text {n}", [1.0, 0.0, float(n), 0.5], {n: 1.0}, "a") for n in range(3)],
        "question_id long, text string, dense array<float>, sparse map<int,float>, scope string",
    )
    rows = search.search_table(chunks, asked, f"{tmp_path}/out", top_k=4, neighbours=1, reranker=OverlapReranker())
    got = rows.where("not is_neighbour").groupBy("question_id").count().collect()
    assert {(r[0], r[1]) for r in got} == {(0, 4), (1, 4), (2, 4)}


def test_embedded_question(spark, chunks):
    texts = chunks.select("id", "channel_id", "report_id", "page_number", "chunk_index", "content")
    embedder = LexicalEmbedder(dimension=8)
    stored = texts.withColumns({"embedding": embedder.dense(F.col("content")), "sparse_embedding": embedder.sparse(F.col("content"))})
    rows = search.hybrid_query(stored, "text", "a", embedder, top_k=3, neighbours=0)
    assert rows.count() == 3


# Plans -----------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_channel_filter_prunes_folders(spark, chunks, tmp_path):
    chunks.write.partitionBy("channel_id").parquet(f"{tmp_path}/chunks")
    stored = spark.read.parquet(f"{tmp_path}/chunks")
    found = scoring.candidates(search.in_scope(stored, "a"), [QUESTION], 5)
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(channel_id" in plan
    assert "ReadSchema: struct<id:string,embedding:array<float>,sparse_embedding:map<int,float>>" in plan
    assert "Exchange" not in plan and "Join" not in plan


def test_only_task_winners_are_shuffled(chunks):
    plan = plan_of(scoring.ranked(scoring.candidates(search.in_scope(chunks, "a"), [QUESTION], 5), 5))
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit") < plan.index("MapInArrow")
    assert "Exchange" not in plan[plan.rindex("WindowGroupLimit") : plan.index("MapInArrow")]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_neighbour_plan_limits_before_the_shuffle(chunks):
    hits = chunks.limit(3).withColumns({"question_id": F.lit(0), "primary_rank": F.lit(1)})
    plan = plan_of(neighbours.neighbour_ids(hits, chunks, 1, bounded=True))
    assert plan.count("WindowGroupLimit") == 2 and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [1, 2, 5])
def test_both_neighbour_ways_agree(chunks, n):
    hits = chunks.where("id in ('c04', 'c08', 'c16', 'c20', 'c47')").withColumn("question_id", F.lit(0))
    shape = lambda bounded: sorted(
        (r["parent_id"], r["offset"], r["id"]) for r in neighbours.neighbour_ids(hits, chunks, n, bounded).collect()
    )
    assert shape(True) == shape(False) != []
