"""Stored indexes, session streams and stored objects."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamplight.operators import scoring
from lamplight.operators.scoring import Question
from lamplight.sources import indexes, objects
from lamplight.sources.indexes import DenseIndex, SparseIndex
from lamplight.streaming import sessions as live

K = 10


@pytest.fixture(scope="module")
def chunks(spark):
    """Vectors in clusters and skewed tokens; ties, a vector of length zero, chunks without tokens, two channels."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(1_500):
        vector = centres[rng.integers(12)] + 0.25 * rng.normal(size=8)
        tokens = {int(t): float(rng.integers(1, 6)) for t in rng.zipf(1.6, rng.integers(0, 9)) if t < 400}
        rows.append((i, "one" if i % 3 else "two", [float(x) for x in vector], tokens))
    rows += [(2_000 + i, "one", rows[7][2], {1: 2.0}) for i in range(30)] + [(3_000, "one", [0.0] * 8, {})]
    made = spark.createDataFrame(rows, "id long, channel_id string, embedding array<float>, sparse_embedding map<int,float>")
    return made.cache()


def scanned(chunks, channel, question, dense, zero=True):
    rows = chunks.where(F.col("channel_id") == channel)
    found = scoring.candidates(rows, [question], K, dense=dense, sparse=not dense, zero_overlap=zero)
    return sorted((r["rank"], r["id"], r["score"]) for r in scoring.ranked(found, K).collect())


def listed(found):
    return sorted((r["rank"], r["id"], r["score"] + 0.0) for r in found.collect())


def questions(count=2):
    rng = np.random.default_rng(9)
    for _ in range(count):
        tokens = {int(t): float(w) for t, w in zip(rng.integers(1, 12, 3), rng.integers(1, 4, 3))}
        yield Question(0, "q", tuple(float(x) for x in rng.normal(size=8)), tokens)


@pytest.fixture(scope="module")
def dense(spark, chunks, tmp_path_factory):
    index = DenseIndex(spark, str(tmp_path_factory.mktemp("dense")), "long").fit(chunks, 12)
    index.replace(chunks.where("id % 2 = 0"))
    index.replace(chunks.where("id % 2 = 1"))
    return index


def test_dense_index_is_exact(chunks, dense):
    for question in questions():
        for channel in ("one", "two"):
            assert listed(dense.search(channel, question, K)) == scanned(chunks, channel, question, True)
    assert dense.search("none", question, K).collect() == []


def test_dense_index_prunes_lists(dense, chunks, monkeypatch):
    read = []
    scan = DenseIndex._scan
    monkeypatch.setattr(DenseIndex, "_scan", lambda self, c, lists, *a: read.append(len(lists)) or scan(self, c, lists, *a))
    for row in chunks.where("id < 4").collect():
        dense.search("one", Question(0, "", tuple(row["embedding"]), {}), K).collect()
    assert np.mean(read[1::2]) < 7  # of 12 lists


def test_probed_lists_recall(chunks, dense):
    hit = total = 0
    for row in chunks.where("id < 24 AND channel_id = 'one'").collect():
        question = Question(0, "", tuple(row["embedding"]), {})
        exact = {i for _, i, _ in scanned(chunks, "one", question, True)}
        hit += len(exact & {r["id"] for r in dense.search("one", question, K, probes=4).collect()})
        total += len(exact)
    assert hit / total >= 0.9


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(indexes, "ROW_GROUP", 4_096)


def test_sparse_index_is_exact(spark, chunks, tmp_path, small_groups):
    index = SparseIndex(spark, str(tmp_path / "sparse"), "long")
    index.replace(chunks.where("id % 2 = 0"))
    index.replace(chunks.where("id % 2 = 1"))
    asked = [*questions(), Question(0, "", (), {1: 2.0}), Question(0, "", (), {399: 1.0, 1: -1.0}), Question(0, "", (), {9_999: 1.0})]
    for n, question in enumerate(asked):
        for zero in (n % 2 == 0,):
            assert listed(index.search("one", question, K, zero)) == scanned(chunks, "one", question, False, zero), question
    pruned = index.postings("one", {1: 4.0})._jdf.queryExecution().toString()
    assert "PartitionFilters" in pruned and "bucket" in pruned.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(weight,4.0)" in pruned and "EqualTo(token,1)" in pruned


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_replaced_and_compacted(spark, chunks, tmp_path, kind):
    question = next(questions())
    index = DenseIndex(spark, str(tmp_path), "long").fit(chunks, 4) if kind == "dense" else SparseIndex(spark, str(tmp_path), "long")
    old = chunks.withColumn("embedding", F.reverse("embedding")).where("id < 900")
    index.replace(old)
    index.replace(chunks.where("id < 700"), old.select("id"))  # 700 to 899 are gone, the rest is new
    index.replace(chunks.where("id >= 700 AND id < 750"))
    now = chunks.where("id < 750")
    for _ in range(2):
        assert listed(index.search("one", question, K)) == scanned(now, "one", question, kind == "dense")
        index.compact()
    # A segment without its line is not seen, and is overwritten by the next one.
    number = index._lines()[1] + 1
    index._write(number, chunks.where("id >= 1000"))
    assert listed(index.search("one", question, K)) == scanned(now, "one", question, kind == "dense")
    index.replace(chunks.where("id = 1000"))
    assert index.rows().where("id > 1000").count() == 0


T = datetime(2024, 1, 1)


def at(hours):
    return T + timedelta(hours=hours)


EVENTS = [
    (1, 10, "login", at(0), at(8)), (1, 10, "logout", at(3), None),  # ended
    (2, 10, "login", at(0), at(8)),  # expires
    (3, 11, "login", at(20), at(28)),  # still open
    (4, 11, "logout", at(2), None), (4, 11, "login", at(1), at(9)),  # logout first
    (5, 12, "login", at(0), at(8)), (5, 12, "logout", at(9), None),  # too late an end
    (6, 12, "logout", at(1), None),  # no login
    (7, 13, "login", at(0), at(8)), (7, 13, "logout", at(4), None), (7, 13, "logout", at(2), None),  # the first end counts
]


def test_sessions_by_batches(spark, tmp_path):
    folder, state, out = (str(tmp_path / x) for x in ("events", "state", "out"))
    rng = random.Random(1)
    events = EVENTS[:]
    rng.shuffle(events)
    for part in (events[:6], events[6:], [(-1, None, "tick", at(21), None)]):
        spark.createDataFrame(part, live.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        closed = live.run(spark, folder, state, out, "30 hours")
    got = {r["session_id"]: (r["state"], r["closed_at"]) for r in closed.collect()}
    ended = {1: ("ended", at(3)), 4: ("ended", at(2))}
    assert {k: v for k, v in got.items() if k in ended} == ended and got[7][0] == "ended"
    assert 2 not in got and 3 not in got
    spark.createDataFrame([(-1, None, "tick", at(45), None)], live.EVENTS).write.mode("append").parquet(folder)
    got = {r["session_id"]: (r["state"], r["closed_at"]) for r in live.run(spark, folder, state, out, "30 hours").collect()}
    assert got[2] == ("expired", at(8)) and got[5] == ("expired", at(8)) and 3 not in got and 6 not in got
    assert len(got) == 5 and spark.read.parquet(out).count() == len(got)  # each is given out once


def test_objects_read_back_equal(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("c/raw/1/a b+ü%.pdf", b"\x00\xff"), ("c/markdown/1.md", b"# T\n"), ("c/metadata/1.json", b"{}"), ("empty", b"")]
    objects.put(spark.createDataFrame(rows, objects.SCHEMA), root)
    # An empty object is there, but Spark's file reader passes over it.
    assert sorted((r["key"], bytes(r["content"])) for r in objects.stored(spark, root).collect()) == sorted(r for r in rows if r[1])
    assert (Path(root) / "empty").read_bytes() == b""
    objects.put(spark.createDataFrame([("empty", b"now"), ("empty", b"earlier")], objects.SCHEMA), root)
    assert (Path(root) / "empty").read_bytes() == b"now"
    assert not any(p.is_file() for p in (Path(root) / objects.PENDING).rglob("*"))


@pytest.mark.parametrize("key", ["", "../up", "a//b", "/a", None, "_pending/x"])
def test_bad_keys(key):
    with pytest.raises(ValueError):
        objects.checked_key(key)


def test_failed_job_leaves_no_object(spark, tmp_path, key="../up"):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"good/{i}", b"x") for i in range(20)] + [(key, b"x")], objects.SCHEMA)
    with pytest.raises(Exception, match="not an object key"):
        objects.put(rows, root)
    assert not any(p.is_file() for p in Path(root).rglob("*"))


def test_commit_names_attempts_and_tasks_move(spark, tmp_path):
    root = str(tmp_path / "store")
    writer = objects.ObjectWriter(root, "job")
    put = writer.write(iter([{"key": f"a/{i}", "content": b"x" * i} for i in range(50)]))
    assert vars(put) == {"attempt": put.attempt}  # what goes through the driver does not grow with the objects
    writer.commit([put])
    assert not (Path(root) / "a").exists()
    parts = [pd.DataFrame({"attempt": [put.attempt]})]
    for _ in range(2):  # a task run again finds its objects moved
        assert [int(p["moved"][0]) for p in objects._published(root, iter(parts))] == [50]
    assert sorted(p.name for p in (Path(root) / "a").iterdir()) == sorted(map(str, range(50)))


def test_objects_by_key(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("a/1", b""), ("a/b/2", b"two"), ("c", b"three")]
    objects.put(spark.createDataFrame(rows, objects.SCHEMA), root)
    asked = spark.createDataFrame([*rows, ("a/none", b"")], objects.SCHEMA).select("key", F.lit(1).alias("n"))
    got = {r["key"]: r["content"] if r["content"] is None else bytes(r["content"]) for r in objects.fetch(asked, root).collect()}
    assert got == {**dict(rows), "a/none": None}
    assert {(r["key"], r["size"]) for r in objects.listed(spark, root).collect()} == {("a/1", 0), ("a/b/2", 3), ("c", 5)}


def test_sessions_share_the_state_of_their_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 2)
    folder, state, out = (str(tmp_path / x) for x in ("events", "state", "out"))
    rows = [(i, i % 7, "login", at(i % 50), at(i % 50 + 8)) for i in range(900)]
    rows += [(i, i % 7, "logout", at(i % 50 + 3), None) for i in range(0, 900, 3)]
    for n in range(3):
        spark.createDataFrame(rows[n::3], live.EVENTS).write.mode("append").parquet(folder)
        live.run(spark, folder, state, out, "60 hours")
    states = spark.read.format("statestore").option("stateVarName", "bucket").load(state)
    assert states.count() == 2  # one for each bucket, none for a session
    spark.createDataFrame([(-1, None, "tick", at(30 + 60), None)], live.EVENTS).write.mode("append").parquet(folder)
    got = {r["session_id"]: (r["state"], r["user_id"], r["login_at"], r["closed_at"]) for r in live.run(spark, folder, state, out, "60 hours").collect()}
    want = {i: ("ended", i % 7, at(i % 50), at(i % 50 + 3)) for i in range(0, 900, 3)}
    want |= {i: ("expired", i % 7, at(i % 50), at(i % 50 + 8)) for i in range(900) if i % 3 and i % 50 + 8 < 30}
    assert got == want and spark.read.parquet(out).count() == len(want)


@pytest.mark.parametrize("name, kind", [("src_13_dense_index", DenseIndex), ("src_14_sparse_index", SparseIndex)])
def test_indexed_rows_are_made_once(spark, monkeypatch, name, kind):
    import __spark_entry__ as entry

    plans = []
    replace = kind.replace
    monkeypatch.setattr(
        kind, "replace", lambda self, chunks, gone=None: plans.append(chunks._jdf.queryExecution().optimizedPlan().toString()) or replace(self, chunks, gone)
    )
    entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 2 and not any("Join" in p or "ArrowEvalPython" in p for p in plans)


def test_sparse_products_embed_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["fn_02_sparse_products"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan
