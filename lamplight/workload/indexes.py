"""Stored indexes, streamed sessions and stored objects."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lamplight.functions import ranking
from lamplight.session import shared_folder, stored
from lamplight.sources import objects, standins as view
from lamplight.sources.indexes import DenseIndex, SparseIndex
from lamplight.sources.standins import sql_strip, with_views
from lamplight.streaming import sessions as live
from lamplight.workload.catalog import DAY
from lamplight.workload.register import query
from lamplight.workload.retrieval import ASKED_TOKENS, CHANNEL, question, sql_dense, sql_sparse

K = ranking.CANDIDATES
LISTS = 16


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@query(
    "src_13_dense_index",
    with_views(["corpus"], "").rstrip() + f", dense AS ({sql_dense()}) SELECT id, dense_rank AS rank, round(score, 6) AS score FROM dense",
)
def _(spark, folder):
    # Half of the chunks is indexed, then replaced and completed: what is found is what a full scan finds.
    # Dealt out and stored: the index reads them several times, and the table may be one split.
    chunks = stored(view.corpus(spark, folder).select("id", "channel_id", "embedding").repartition("id"), "chunks")
    index = DenseIndex(spark, _place(spark, "dense-index"), "long").fit(chunks, LISTS)
    half = chunks.where("id % 2 = 0")
    index.replace(half)
    index.replace(chunks, half.select("id"))
    found = index.search(CHANNEL, question(spark, folder), K)
    return found.select("id", "rank", F.round("score", 6).alias("score"))


def _sparse(spark, folder):
    # Stored: the index reads them several times, and each would embed the texts again.
    chunks = stored(view.corpus(spark, folder).select("id", "channel_id", "sparse_embedding"), "chunks")
    index = SparseIndex(spark, _place(spark, "postings"), "long")
    half = chunks.where("id % 2 = 0")
    index.replace(half)
    index.replace(chunks, half.select("id"))
    return index


@query(
    "src_14_sparse_index",
    with_views(["corpus", "postings"], "").rstrip() + f", {ASKED_TOKENS}, sparse AS ({sql_sparse()}) SELECT id, sparse_rank AS rank, score FROM sparse",
)
def _(spark, folder):
    found = _sparse(spark, folder).search(CHANNEL, question(spark, folder), K)
    return found.select("id", "rank", (F.col("score") + 0.0).alias("score"))


@query(
    "str_02_session_stream",
    with_views(
        ["sessions"],
        f"""SELECT user_id, CASE WHEN ended_at <= TIMESTAMP '{DAY}' AND ended_at < expires_at THEN 'ended' ELSE 'expired' END AS state,
               count(*) AS sessions FROM sessions WHERE login_at <= TIMESTAMP '{DAY}'
                 AND (expires_at <= TIMESTAMP '{DAY}' OR ended_at <= TIMESTAMP '{DAY}') GROUP BY ALL""",
    ),
)
def _(spark, folder):
    # Logins and logouts as a stream of events by day; sessions without an end in time expire by their timers.
    rows = view.sessions(spark, folder).where(F.col("login_at") <= F.lit(DAY).cast("timestamp"))
    place = _place(spark, "session-stream")
    live.landed(rows, F.lit(DAY).cast("timestamp"), f"{place}/events")
    closed = live.run(spark, f"{place}/events", f"{place}/state", f"{place}/closed")
    return closed.groupBy("user_id", "state").agg(F.count("*").alias("sessions"))


@query(
    "snk_09_stored_objects",
    f"""SELECT doc_id, kind, key, md5(body) AS content_md5 FROM (
        SELECT doc_id, 'raw' AS kind, lang || '/raw/' || doc_id || '/doc_' || doc_id || '.txt' AS key, text AS body FROM documents
        UNION ALL SELECT doc_id, 'markdown', lang || '/markdown/' || doc_id || '.md', {sql_strip("text")} FROM documents
        UNION ALL SELECT doc_id, 'metadata', lang || '/metadata/' || doc_id || '.json',
            '{{"document_id":' || doc_id || ',"source":"' || source || '"}}' FROM documents)""",
)
def _(spark, folder):
    docs = view.table(spark, folder, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    name = F.col("doc_id").cast("string")
    key = lambda *parts: F.concat_ws("/", "lang", *parts)
    record = F.to_json(F.struct(F.col("doc_id").alias("document_id"), "source"))
    body = view.text.strip(F.col("text"))
    made = F.array(
        F.struct(F.lit("raw").alias("kind"), key(F.lit("raw"), name, F.concat(F.lit("doc_"), name, F.lit(".txt"))).alias("key"), F.col("text").alias("body")),
        F.struct(F.lit("markdown").alias("kind"), key(F.lit("markdown"), F.concat(name, F.lit(".md"))).alias("key"), body.alias("body")),
        F.struct(F.lit("metadata").alias("kind"), key(F.lit("metadata"), F.concat(name, F.lit(".json"))).alias("key"), record.alias("body")),
    )
    rows = docs.select("doc_id", F.explode(made).alias("o")).select("doc_id", "o.kind", "o.key", F.col("o.body").cast("binary").alias("content"))
    root = _place(spark, "objects")
    objects.put(rows.select("key", "content"), root)
    # Read back from storage by key; what is not there is left out.
    there = objects.fetch(rows.select("doc_id", "kind", "key"), root).filter("content IS NOT NULL")
    return there.select("doc_id", "kind", "key", F.md5("content").alias("content_md5"))
