"""Fusion of the two arms, hydration, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamplight.functions import ranking
from lamplight.functions.providers import Reranker


def pool_size(top_k: int, candidates: int, rerank: bool) -> int:
    """How many fused rows go on; the reranker gets at least three times ``top_k``."""
    size = max(top_k, candidates)
    return max(size, 3 * top_k) if rerank else size


def fuse(ranks: DataFrame, alpha: float = ranking.ALPHA, rrf_k: int = ranking.RRF_K) -> DataFrame:
    """One row per question and chunk with both ranks and the fused score."""
    arms = ranks.select(
        "question_id",
        "id",
        F.when(F.col("arm") == "dense", F.col("rank")).alias("dense_rank"),
        F.when(F.col("arm") == "sparse", F.col("rank")).alias("sparse_rank"),
    )
    fused = arms.groupBy("question_id", "id").agg(
        F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank")
    )
    score = ranking.reciprocal_rank(F.col("dense_rank"), F.col("sparse_rank"), alpha, rrf_k)
    return fused.withColumn("rrf_score", score)


def fused_pool(fused: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("rrf_score"), "id")
    return fused.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= size)


def hydrate(pool: DataFrame, chunks: DataFrame, bounded: bool) -> DataFrame:
    """Fetch the chunk columns of the pooled ids only.

    ``bounded`` says the pool holds one question, hence at most a few hundred rows,
    and may be broadcast; otherwise the planner picks the join from real sizes. The
    vectors have served their purpose and are not read again.
    """
    return chunks.drop("embedding", "sparse_embedding").join(F.broadcast(pool) if bounded else pool, "id")


def rerank(rows: DataFrame, reranker: Reranker | None, top_k: int, question: Column | None = None) -> DataFrame:
    """Best ``top_k`` per question by reranker score, fused order breaking ties.

    Without a reranker the fused order stands and the score is null.
    """
    if reranker is None:
        score = F.lit(None).cast("double")
    else:
        asked = F.col("question") if question is None else question
        score = ranking.sigmoid(reranker.logit(asked, F.coalesce("content", F.lit(""))))
    rows = rows.withColumn("rerank_score", score)
    best_first = F.desc_nulls_last(F.round("rerank_score", 12))
    order = Window.partitionBy("question_id").orderBy(best_first, "fused_rank")
    return rows.withColumn("primary_rank", F.row_number().over(order)).where(F.col("primary_rank") <= top_k)
