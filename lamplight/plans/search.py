"""Question to ranked chunks: two arms, fusion, feedback, reranking, neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import islice
from uuid import uuid4

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from lamplight import schemas
from lamplight.functions import ranking, text as words, vectors
from lamplight.functions.providers import Embedder, Reranker
from lamplight.operators import fusion, neighbours as around, scoring
from lamplight.operators.scoring import Question
from lamplight.session import cut_lineage, shared_folder


def check_arguments(channel_id: str, alpha: float, prf_beta: float, neighbours: int) -> None:
    if not channel_id or not channel_id.strip():
        raise ValueError("a query must name its channel")
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must lie in [0, 1]: {alpha}")
    if not 0.0 <= prf_beta < 1.0:
        raise ValueError(f"prf_beta must lie in [0, 1): {prf_beta}")
    if neighbours < 0:
        raise ValueError(f"neighbours must not be negative: {neighbours}")


def embed_question(spark, question: str, embedder: Embedder) -> Question:
    """Vectors of one question; the one row that comes back to the driver."""
    asked = spark.createDataFrame([(question,)], "text string")
    row = asked.select(
        embedder.dense(F.col("text")).alias("dense"), embedder.sparse(F.col("text")).alias("sparse")
    ).first()
    if not row["dense"]:
        raise RuntimeError("the embedder returned no vector for the question")
    return Question(0, question, tuple(row["dense"]), dict(row["sparse"] or {}))


def in_scope(chunks: DataFrame, channel_id: str, report_id: str | None = None) -> DataFrame:
    scoped = chunks.where(F.col("channel_id") == channel_id)
    return scoped if report_id is None else scoped.where(F.col("report_id") == report_id)


def first_stage(
    corpus: DataFrame,
    questions: Sequence[Question],
    candidates: int = ranking.CANDIDATES,
    alpha: float = ranking.ALPHA,
    rrf_k: int = ranking.RRF_K,
    zero_overlap: bool = True,
    scope: Column | None = None,
) -> DataFrame:
    """Fused candidates of every question, with both ranks and the fused score."""
    found = scoring.candidates(corpus, questions, candidates, zero_overlap=zero_overlap, scope=scope)
    return fusion.fuse(scoring.ranked(found, candidates), alpha, rrf_k)


def centroid(rows: DataFrame, vector: str = "embedding", key: str = "question_id") -> DataFrame:
    """Element-wise mean vector per key, from partial sums of whole vectors. Null vectors are passed over."""
    known = rows.where(F.col(vector).isNotNull())
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return known.groupBy(key).agg(vector_to_array(mean).alias("centroid"))


def expanded_question(
    corpus: DataFrame, question: Question, fused: DataFrame, beta: float, topn: int
) -> Question:
    """Feedback: blend the question vector with the mean of its best ``topn`` chunks."""
    best = fusion.fused_pool(fused, topn)
    mean = centroid(corpus.select("id", "embedding").join(F.broadcast(best), "id"))
    original = F.array(*[F.lit(float(x)) for x in question.dense])
    row = mean.select(vectors.unit(vectors.blend(original, F.col("centroid"), beta)).alias("v")).first()
    return question if row is None else replace(question, dense=tuple(row["v"]))


def hybrid_query(
    chunks: DataFrame,
    text: str,
    channel_id: str,
    embedder: Embedder | None = None,
    *,
    top_k: int = ranking.TOP_K,
    candidates: int = ranking.CANDIDATES,
    rrf_k: int = ranking.RRF_K,
    alpha: float = ranking.ALPHA,
    prf_beta: float = ranking.PRF_BETA,
    prf_topn: int = ranking.PRF_TOPN,
    neighbours: int = ranking.NEIGHBOURS,
    report_id: str | None = None,
    rerank: bool = True,
    reranker: Reranker | None = None,
    question: Question | None = None,
    zero_overlap: bool = True,
) -> DataFrame:
    """Top ``top_k`` chunks of one channel for one question, with their neighbours.

    Pass ``question`` to search with ready vectors; otherwise ``embedder`` makes them.
    With ``rerank`` but no ``reranker`` the fused order stands, as it does when a
    model could not be loaded.
    """
    spark = chunks.sparkSession
    if not text or not text.strip():
        return spark.createDataFrame([], schemas.RESULT)
    check_arguments(channel_id, alpha, prf_beta, neighbours)
    if question is None:
        if embedder is None:
            raise RuntimeError("no embedder to turn the question into vectors")
        question = embed_question(spark, text, embedder)
    corpus = in_scope(chunks, channel_id, report_id)
    if prf_beta > 0.0:
        first = first_stage(corpus, [question], candidates, alpha, rrf_k, zero_overlap)
        question = expanded_question(corpus, question, first, prf_beta, prf_topn)
    fused = first_stage(corpus, [question], candidates, alpha, rrf_k, zero_overlap)
    pool = fusion.fused_pool(fused, fusion.pool_size(top_k, candidates, rerank))
    rows = fusion.hydrate(pool, corpus, bounded=True)
    hits = fusion.rerank(rows, reranker if rerank else None, top_k, F.lit(text))
    if neighbours > 0:
        # The hits feed several joins; without this the corpus would be scored for each.
        hits = cut_lineage(hits)
    # The hits are at most ``top_k`` rows, so broadcasting them is bounded by the call.
    # Neighbours come from the whole channel, also when the search was narrowed.
    return result_rows(around.attach(hits, in_scope(chunks, channel_id), neighbours, bounded=True))


def search_all(
    chunks: DataFrame,
    questions: Sequence[Question],
    *,
    top_k: int = ranking.TOP_K,
    candidates: int = ranking.CANDIDATES,
    rrf_k: int = ranking.RRF_K,
    alpha: float = ranking.ALPHA,
    neighbours: int = 0,
    reranker: Reranker | None = None,
    zero_overlap: bool = True,
    scope: Column | None = None,
) -> DataFrame:
    """Many questions in one scan of the corpus, each inside its own channel."""
    where = F.col("channel_id") if scope is None else scope
    fused = first_stage(chunks, questions, candidates, alpha, rrf_k, zero_overlap, where)
    pool = fusion.fused_pool(fused, fusion.pool_size(top_k, candidates, reranker is not None))
    rows = fusion.hydrate(pool, chunks, bounded=False)
    if reranker is not None:
        asked = chunks.sparkSession.createDataFrame(
            [(q.question_id, q.text) for q in questions],
            f"question_id {dict(fused.dtypes)['question_id']}, question string",
        )
        rows = rows.join(asked, "question_id")
    hits = fusion.rerank(rows, reranker, top_k).drop("question")
    if neighbours > 0:
        hits = cut_lineage(hits)
    return around.attach(hits, chunks, neighbours, bounded=False)


def search_table(chunks: DataFrame, questions: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """``search_all`` for a table of questions (question_id, text, dense, sparse, scope).

    The driver holds one pass of questions at a time, whatever the table's length;
    each pass is written to the shared folder before the next one is fetched.
    """
    spark = chunks.sparkSession
    folder = folder or f"{shared_folder(spark)}/search-{uuid4().hex}"
    rows = questions.select("question_id", "text", "dense", "sparse", "scope").toLocalIterator()
    passes = 0
    while batch := list(islice(rows, scoring.QUESTIONS_PER_PASS)):
        asked = [Question(r[0], r[1], tuple(r[2]), dict(r[3]), r[4]) for r in batch]
        search_all(chunks, asked, **options).write.parquet(f"{folder}/pass={passes}")
        passes += 1
    if not passes:
        raise ValueError("no questions")
    return spark.read.option("basePath", folder).parquet(f"{folder}/pass=*").drop("pass")


def result_rows(rows: DataFrame) -> DataFrame:
    """Public columns of a single question's result."""
    names = [
        "id", "channel_id", "report_id", "page_number", "chunk_index", "content", "metadata",
        "rrf_score", "rerank_score", "is_neighbour", "neighbour_of", "primary_rank", "position",
    ]
    return rows.select(*[c for c in names if c in rows.columns])


def in_display_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("position")


def wire_rows(rows: DataFrame) -> DataFrame:
    """The columns a client gets; the chunk's own id stays inside."""
    title = F.col("metadata.section_title") if "metadata" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "report_id",
        "page_number",
        "chunk_index",
        F.coalesce("content", F.lit("")).alias("content"),
        "rerank_score",
        "rrf_score",
        F.coalesce(title, F.lit("")).alias("section_title"),
        "is_neighbour",
        "neighbour_of",
        "position",
    )


def primary_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_neighbour"))


def result_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(~F.col("is_neighbour")).alias("result_count"),
        F.count_if("is_neighbour").alias("neighbour_rows"),
    )


def top_hits(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first hits in display order, for a trace."""
    return (
        primary_rows(rows)
        .orderBy("position")
        .limit(n)
        .select(F.col("page_number").alias("page"), "chunk_index", "rerank_score", "rrf_score")
    )


# Rendering ----------------------------------------------------------------------

# Wording of the rendered answers.
NOTHING_FOUND = "No relevant results found for your question."
PREVIEW_HIT, PREVIEW_NEIGHBOUR = 220, 200


def as_markdown(wire: DataFrame) -> DataFrame:
    """A result set (a page of hits with context) as one chat message."""
    numbered = F.count_if(~F.col("is_neighbour")).over(_display_order())
    score = F.coalesce("rerank_score", "rrf_score")
    title = words.strip(F.coalesce("section_title", F.lit("")))
    body = words.strip(F.coalesce("content", F.lit("")))
    hit = F.concat(
        F.lit("\n---\n**"), numbered.cast("string"), F.lit(".** Page "), F.col("page_number").cast("string"),
        F.when(title != "", F.concat(F.lit(" | Section: *"), title, F.lit("*"))).otherwise(""),
        F.lit(" | Score: "), F.coalesce(F.format_string("%.3f", score), F.lit("N/A")),
        F.when(body != "", F.concat(F.lit("\n\n"), words.blockquote(body))).otherwise(""),
    )
    context = F.concat(
        F.lit("\n   ↳ *Context — Page "), F.col("page_number").cast("string"),
        F.lit(", chunk "), F.col("chunk_index").cast("string"), F.lit("*"),
        F.when(body != "", F.concat(F.lit("\n"), words.blockquote(body))).otherwise(""),
    )
    pieces = wire.withColumn("_piece", F.when(F.col("is_neighbour"), context).otherwise(hit))
    listed = F.array_sort(F.collect_list(F.struct("position", "_piece")))
    return pieces.agg(
        F.count_if(~F.col("is_neighbour")).alias("hits"),
        F.array_join(F.transform(listed, lambda e: e["_piece"]), "\n").alias("body"),
    ).select(
        F.when(F.col("hits") == 0, NOTHING_FOUND)
        .otherwise(F.concat(F.lit("Found **"), F.col("hits").cast("string"), F.lit("** relevant result(s):\n"), "body"))
        .alias("message")
    )


def _display_order() -> WindowSpec:
    return Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)


def as_preview(rows: DataFrame) -> DataFrame:
    """Two preview lines per row of one result set, keyed by ``position``."""
    title = F.col("metadata.section_title") if "metadata" in rows.columns else F.lit(None).cast("string")
    suffix = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("  «"), title, F.lit("»"))).otherwise("")
    rank = F.count_if(~F.col("is_neighbour")).over(_display_order())
    label = (
        F.when(F.col("rerank_score").isNotNull(), F.concat(F.lit("score="), F.format_string("%.3f", "rerank_score")))
        .when(F.col("rrf_score").isNotNull(), F.concat(F.lit("rrf="), F.format_string("%.4f", "rrf_score")))
        .otherwise("—")
    )
    place = F.concat(
        F.lit("page="), F.col("page_number").cast("string"),
        F.lit("  chunk="), F.col("chunk_index").cast("string"), suffix,
    )
    hit = F.concat(
        F.lit("  ["), F.lpad(rank.cast("string"), 2, " "), F.lit("] "), label,
        F.lit("  report="), F.substring("report_id", 1, 8), F.lit("…  "), place,
        F.lit("\n       "), words.shorten(F.col("content"), PREVIEW_HIT),
    )
    context = F.concat(
        F.lit("       ~ neighbour  "), place,
        F.lit("\n         "), words.shorten(F.col("content"), PREVIEW_NEIGHBOUR),
    )
    return rows.select("position", F.when(F.col("is_neighbour"), context).otherwise(hit).alias("preview"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select("position", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
