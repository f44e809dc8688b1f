"""Catalog operators and the stored tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamplight import schemas
from lamplight.functions.providers import LexicalEmbedder
from lamplight.operators import catalog
from lamplight.plans import ingest, search
from lamplight.settings import Settings
from lamplight.sources import extract, files
from lamplight.sources.warehouse import Warehouse
from lamplight.streaming import jobs

T0 = datetime(2024, 1, 1)
EMBEDDER = LexicalEmbedder(dimension=8)


@pytest.fixture
def store(spark, tmp_path):
    return Warehouse(spark, f"{tmp_path}/store", Settings(report_buckets=4))


def documents(spark, *rows):
    ddl = "seq long, channel_id string, filename string, title string, metadata map<string,string>, text string"
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], ddl)


def ingest_texts(store, docs, at=T0):
    return ingest.ingest_documents(
        store, docs, extract.text_items(F.col("text")), EMBEDDER, "plain-text", F.lit(at).cast("timestamp")
    )


def stored(store):
    rows = store.read("report_chunks").orderBy("report_id", "chunk_index").collect()
    return [(r["report_id"], r["chunk_index"], r["content"]) for r in rows]


A = ("c1", "a.pdf", "", {"k": "1"}, "Title\nFirst line ends.\n" + "Second line. " * 200)
B = ("c1", "b.pdf", "Named", {}, "Other text here.")
C = ("c2", "a.pdf", "", {}, "Same name, other channel.")


def test_ingest_twice_is_ingest_once(spark, store):
    ingest_texts(store, documents(spark, A, B, C))
    first = stored(store)
    result = ingest_texts(store, documents(spark, A, B, C), datetime(2025, 1, 1))
    assert stored(store) == first and len({r[0] for r in first}) == 3
    reports = {(r["channel_id"], r["filename"]): r for r in store.read("reports").collect()}
    assert reports["c1", "a.pdf"]["title"] == "a" and reports["c1", "b.pdf"]["title"] == "Named"
    assert reports["c1", "a.pdf"]["created_at"] == T0
    assert sum(r["deleted"] for r in result.deleted.collect()) == len(first)
    stats = {r["report_id"]: r for r in result.stats.collect()}
    chunks = stats[reports["c1", "a.pdf"]["id"]]["chunks_inserted"]
    assert chunks == sum(1 for r in first if r[0] == reports["c1", "a.pdf"]["id"])


def test_reingest_replaces_and_can_empty(spark, store):
    ingest_texts(store, documents(spark, A, B, C))
    before = stored(store)
    ingest_texts(store, documents(spark, (*A[:4], "Only this now.")))
    after = stored(store)
    assert [r[2] for r in after if "Only this" in r[2]] == ["Only this now."]
    assert {r for r in before if "Other text" in r[2] or "Same name" in r[2]} <= set(after)
    assert len(after) == 3
    ingest_texts(store, documents(spark, (*A[:4], "  \n "), (*B[:4], "")))
    assert [r[2] for r in stored(store)] == ["Same name, other channel."]


def test_title_and_metadata_are_overwritten(spark, store):
    ingest_texts(store, documents(spark, B))
    ingest_texts(store, documents(spark, (*B[:2], "New", {"x": "y"}, B[4])))
    row = store.read("reports").first()
    assert row["title"] == "New" and row["metadata"] == {"x": "y"}


def test_same_file_twice_in_a_batch_keeps_the_last(spark, store):
    ingest_texts(store, documents(spark, A, (*A[:2], "Second", {}, "Later text.")))
    assert [r[2] for r in stored(store)] == ["Later text."]
    assert store.read("reports").first()["title"] == "Second"


def test_faulty_documents_are_rejected(spark, store):
    docs = documents(spark, A, B).withColumn("fault", F.when(F.col("filename") == "a.pdf", "too small"))
    result = ingest_texts(store, docs)
    assert [r["filename"] for r in result.rejects.collect()] == ["a.pdf"]
    assert [r[2] for r in stored(store)] == ["Other text here."]


def test_query_over_the_store(spark, store):
    ingest_texts(store, documents(spark, A, B, C))
    rows = search.hybrid_query(store.read("report_chunks"), "second line", "c1", EMBEDDER, top_k=2)
    got = search.in_display_order(rows).collect()
    assert {r["channel_id"] for r in got} == {"c1"} and "Second line" in got[0]["content"] + got[1]["content"]
    wire = search.wire_rows(rows).collect()
    assert "Title" in {r["section_title"] for r in wire}


def test_stream_equals_batch(spark, store, tmp_path):
    for name, body in (("a.txt", A[4]), ("b.txt", B[4])):
        (tmp_path / "landing").mkdir(exist_ok=True)
        (tmp_path / "landing" / name).write_text(body)
    shape = lambda rows: rows.select(
        F.hash("path").cast("long").alias("seq"), F.lit("c1").alias("channel_id"),
        files.file_name(F.col("path")).alias("filename"), F.lit("").alias("title"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.decode("content", "UTF-8").alias("text"),
    )
    stream = shape(jobs.file_stream(spark, f"{tmp_path}/landing", "*.txt", per_batch=1))
    query = jobs.ingest_stream(
        store, stream, extract.text_items(F.col("text")), EMBEDDER, "plain-text", f"{tmp_path}/checkpoint"
    )
    query.awaitTermination()
    other = Warehouse(spark, f"{tmp_path}/other", Settings(report_buckets=4))
    batch = spark.read.format("binaryFile").load(f"{tmp_path}/landing")
    ingest_texts(other, shape(batch))
    assert stored(store) == stored(other) != []


def test_pdf_listing_and_faults(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.pdf").write_bytes(b"%PDF-" + b"x" * 40)
    (tmp_path / "two.PDF").write_bytes(b"<html>" + b"x" * 40)
    (tmp_path / "sub" / "three.pdf").write_bytes(b"%PDF-" + b"x" * 26)
    (tmp_path / "note.txt").write_text("no")
    flat = files.validate(files.pdf_files(spark, str(tmp_path)))
    got = {files_name: fault for files_name, fault in flat.select(files.file_name(F.col("path")), "fault").collect()}
    assert got == {"one.pdf": None, "two.PDF": "missing header"}
    deep = files.validate(files.pdf_files(spark, str(tmp_path), recursive=True))
    third = deep.where(F.col("path").endswith("three.pdf")).first()
    assert third["fault"] == "too small" and third["size_bytes"] == 31 and third["header_hex"] == "255044462d787878"


def test_pdf_ingest_with_an_extractor(spark, store, tmp_path):
    class Lines:
        tag = "lines"

        def items(self, content):
            return extract.text_items(F.decode(content, "UTF-8"))

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.pdf").write_bytes(b"%PDF-1.7\nA long enough body text.\n")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"tiny")
    result = ingest.ingest_files(store, f"{tmp_path}/in", "c1", Lines(), EMBEDDER, metadata={"k": "v"})
    assert [r["filename"] for r in result.rejects.collect()] == ["bad.pdf"]
    assert store.read("reports").first()["title"] == "good" and len(stored(store)) == 1


def test_report_counts_and_cascade(spark):
    reports = spark.createDataFrame([("r1", "c", "f1", "t", {}, T0), ("r2", "c", "f2", "t", {}, T0)], schemas.REPORTS)
    chunks = spark.createDataFrame([("r1", 1), ("r1", 1), ("r1", 2)], "report_id string, page_number int")
    got = {r["report_id"]: (r["page_count"], r["chunk_count"]) for r in catalog.report_summaries(reports, chunks).collect()}
    assert got == {"r1": (2, 3), "r2": (0, 0)}
    gone = spark.createDataFrame([("r1",), ("r9",)], "report_id string")
    assert {tuple(r) for r in catalog.chunks_per_report(chunks, gone).collect()} == {("r1", 3), ("r9", 0)}
    assert catalog.without_reports(chunks, gone).count() == 0


def test_links_login_and_features(spark):
    tenants = spark.createDataFrame(
        [(1, "A", None, {}, ["chatbot"]), (2, "B", "u1", {}, None)], schemas.TENANTS
    )
    links = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u3"), (9, "u4")], "channelid int, rag_channel_id string")
    got = {(r["channelid"], r["rag_channel_id"]): r["reason"] for r in catalog.judge_links(tenants, links).collect()}
    assert got == {(1, "u1"): "corpus in use", (1, "u2"): None, (2, "u3"): "already linked", (9, "u4"): "unknown channel"}
    users = spark.createDataFrame(
        [(1, "N", "n", "d1", 1, ["admin_panel"], None), (2, "M", "m", "d2", 2, None, {})], schemas.USERS
    )
    assert catalog.login(users, tenants, "n", "d1").first()["channel_name"] == "A"
    assert catalog.login(users, tenants, "n", "d2").count() == 0
    assert [r["username"] for r in users.where(catalog.has_feature("admin_panel")).collect()] == ["n"]
    shown = {r["name"]: r for r in catalog.tenant_table(tenants).collect()}
    assert shown["A"]["rag_channel_id"] == "— not linked —" and shown["B"]["features"] == ""


def test_sessions(spark):
    logins = spark.createDataFrame([(1, "ip", T0)], "user_id int, ip_address string, login_at timestamp")
    rows = catalog.open_sessions(logins)
    row = rows.first()
    assert (row["expires_at"] - row["login_at"]).total_seconds() == 8 * 3600
    state = lambda h: rows.select(catalog.session_state(F.lit(T0).cast("timestamp") + F.expr(f"INTERVAL {h} HOUR"))).first()[0]
    assert [state(-1), state(0), state(7), state(8)] == ["future", "open", "open", "expired"]


def test_unique_keys_are_enforced(spark, store):
    twice = spark.createDataFrame([("r", 1, 0), ("r", 1, 0)], "report_id string, page_number int, chunk_index int")
    with pytest.raises(ValueError, match="not unique"):
        store.assert_unique("report_chunks", twice)


def test_migrations(spark, tmp_path):
    for name in ("002_b.sql", "001_a.sql", "notes.txt"):
        (tmp_path / name).write_text(f"-- {name}")
    found = files.sql_files(spark, str(tmp_path))
    assert [r["version"] for r in found.collect()] == ["001_a.sql", "002_b.sql"]
    applied = spark.createDataFrame([("001_a.sql", T0)], schemas.MIGRATIONS)
    assert [r["version"] for r in catalog.pending(found, applied).collect()] == ["002_b.sql"]
    after = catalog.record_applied(applied, found, F.lit(T0).cast("timestamp"))
    assert after.count() == 2 and catalog.pending(found, after).count() == 0


def test_repeated_links_and_ends_are_folded(spark):
    tenants = spark.createDataFrame([(1, "a", None), (2, "b", None)], "channelid int, name string, rag_channel_id string")
    links = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "channelid int, rag_channel_id string")
    got = {r["channelid"]: r["rag_channel_id"] for r in catalog.link_tenants(tenants, links).collect()}
    assert got == {1: "x", 2: None}
    sessions = spark.sql("SELECT 's' AS session_id, CAST(NULL AS timestamp) AS ended_at")
    ends = spark.sql("SELECT 's' AS session_id, timestamp '2024-01-02' AS at UNION ALL SELECT 's', timestamp '2024-01-01'")
    rows = catalog.end_sessions(sessions, ends).collect()
    assert len(rows) == 1 and rows[0]["ended_at"].day == 1


def test_null_names_are_blank(spark):
    wanted = spark.createDataFrame([(1, None), (2, "a")], "seq long, name string")
    known = spark.createDataFrame([], "id string, name string")
    got = {r["seq"]: r["reason"] for r in catalog.judge_new_channels(known, wanted).collect()}
    assert got == {1: "blank name", 2: None}


def test_percentiles_are_exact(spark):
    from pyspark.sql import functions as F

    from lamplight.plans import traces

    rows = spark.range(40_000).select(
        (F.col("id") % 3).alias("k"), F.pow(F.rand(1), 9).alias("value")
    ).unionByName(spark.createDataFrame([(7, 1.0), (8, None), (None, 2.0), (None, 4.0)], "k long, value double"))
    rows = rows.cache()
    want = {r["k"]: r for r in rows.groupBy("k").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p")).collect()}
    got = {r["k"]: r for r in traces.latency_by(rows, "k").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r["p50"], r["p95"]) == (None, None) if want[k]["p"] is None else (r["p50"], r["p95"]) == pytest.approx(tuple(want[k]["p"]), rel=1e-12)


def test_models_see_gated_images_only(spark):
    from lamplight.operators import layout

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def caption(image):
        if image is not None:
            seen.add(1)
            return "c"

    class Counting:
        def caption(self, image):
            return caption(image)

    rows = [(1, 1, i, "figure" if i < 3 else "text", "w" * 30, (0.0, 0.0, 50.0, 50.0), 100.0, 100.0, 50.0, b"x") for i in range(20)]
    schema = (
        "doc_id long, page_number int, reading_order int, kind string, text string, bbox struct<x_min:double,y_min:double,"
        "x_max:double,y_max:double>, page_width double, page_height double, pixel_stddev double, image binary"
    )
    got = layout.blocks(spark.createDataFrame(rows, schema), captioner=Counting()).collect()
    assert seen.value == 3 and sum(r["content"] is not None and r["content"].startswith("[Figure: c]") for r in got) == 3
