"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Retrieval defaults.
ALPHA = 0.5
RRF_K = 60
CANDIDATES = 50
TOP_K = 10
NEIGHBOURS = 1
PRF_BETA = 0.0
PRF_TOPN = 5


def reciprocal_rank(dense_rank: Column, sparse_rank: Column, alpha: float = ALPHA, k: int = RRF_K) -> Column:
    """Weighted reciprocal rank fusion; a missing rank adds nothing."""

    def arm(weight: float, rank: Column) -> Column:
        return F.coalesce(F.lit(float(weight)) * (F.lit(1.0) / (F.lit(float(k)) + rank)), F.lit(0.0))

    return arm(alpha, dense_rank) + arm(1.0 - alpha, sparse_rank)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
