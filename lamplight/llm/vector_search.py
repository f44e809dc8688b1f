"""Exact top-k by inner product: columnar branch-and-bound.

Candidates and queries are dealt to blocks of bounded size, and every query block meets every candidate block once, as
one row of an equi-join on the pair of block numbers. Within a pair, components lie in vertical layout: partial
products are added up for a block of dimensions at a time, and what the remaining dimensions can still add or take
is bounded by the product of the remaining norms. Candidates whose upper bound lies under the k-th best lower bound are
compacted away. Each pair hands on its best k per query; those are merged in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lamplight.llm.tables import unsent

#: Candidates and queries of a block, dimensions of a step. The other side is moved once for each block of a side.
CANDIDATES, QUERIES, DIMENSIONS = 4_096, 8_192, 16
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def digits(vector: str | Column, scale: int = 1_024) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null or non-finite component."""
    column = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(whole, F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _blocks(rows: DataFrame, block: str, size: int, count: int) -> DataFrame:
    """(block, rows): the rows of each block, about ``size`` of them, dealt by a hash of the whole row."""
    number = F.pmod(F.xxhash64("id", "v", "copy"), F.lit(count)).cast("int")
    return rows.select(number.alias(block), F.struct("id", "v").alias("row")).groupBy(block).agg(
        F.collect_list("row").alias(f"{block}_rows")
    )


def _columns(vectors: pa.Array, width: int) -> np.ndarray:
    """Vertical layout, one row per dimension; shorter vectors are padded with zeros."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((width, len(sizes)), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return out


def best_of(
    query: np.ndarray, query_ids: np.ndarray, cand: np.ndarray, cand_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of each query's best ``k`` of one block, its own id left out.

    ``query`` and ``cand`` hold integers, a row per dimension. Scores outside the range of a long are cut to it.
    """
    width = len(cand)
    most = float(np.abs(cand).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, width)
    kind = float if most < EXACT else object
    query, cand = query.astype(kind), cand.astype(kind)
    cuts = [*range(0, width, DIMENSIONS), width] if width else [0, 0]
    squares = lambda m: np.add.accumulate((m.astype(float) ** 2)[::-1], 0)[::-1] if width else m
    rest = lambda m: [np.sqrt(squares(m)[c]) if c < width else np.zeros(m.shape[1]) for c in cuts[1:]]
    query_rest, cand_rest = rest(query), rest(cand)
    first = query[: cuts[1]].T @ cand[: cuts[1]]
    out_q, out_c, out_s = [], [], []
    for q in range(query.shape[1]):
        alive = np.flatnonzero(cand_ids != query_ids[q])
        sums = first[q, alive]
        for step in range(len(cuts) - 1):
            if step:
                sums = sums + query[cuts[step] : cuts[step + 1], q] @ cand[cuts[step] : cuts[step + 1], alive]
            if len(alive) > k and step < len(cuts) - 2:
                # Rounding of the norms is covered by a millionth and one.
                mass = query_rest[step][q] * cand_rest[step][alive] * (1 + 1e-6) + 1
                rough = sums.astype(float)
                bar = np.partition(rough - mass, len(alive) - k)[len(alive) - k]
                # Scores beyond a long are equal once they are cut to it.
                bar = min(bar, float(MOST) * (1 - 1e-6))
                keep = rough + mass >= bar
                if bar > float(LEAST) * (1 - 1e-6) and not keep.all():
                    alive, sums = alive[keep], sums[keep]
        if kind is object:
            sums = np.array([min(max(int(x), LEAST), MOST) for x in sums], object)
        sums = sums.astype(np.int64)
        if len(alive) > 4 * k:
            bar = np.partition(sums, len(sums) - k)[len(sums) - k]
            alive, sums = alive[sums >= bar], sums[sums >= bar]
        order = np.lexsort((cand_ids[alive], -sums.astype(object) if kind is object else -sums))[:k]
        out_q.append(np.full(len(order), q))
        out_c.append(alive[order])
        out_s.append(sums[order])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _scorer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = []
                sides = []
                for name in ("query_rows", "cand_rows"):
                    rows = batch.column(name).slice(i, 1).flatten()
                    sides.append((rows.field("id").to_numpy(zero_copy_only=False), rows.field("v")))
                width = max([0, *(pc.max(pc.list_value_length(v)).as_py() or 0 for _, v in sides)])
                (query_ids, query), (cand_ids, cand) = ((ids, _columns(v, width)) for ids, v in sides)
                for at in range(0, len(query_ids), 128):
                    part = slice(at, at + 128)
                    q, c, s = best_of(query[:, part], query_ids[part], cand, cand_ids, k)
                    found.append((query_ids[part][q], cand_ids[c], s))
                columns = [np.concatenate(x) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best ``k`` candidates of another id, ties to the smaller id.

    Vectors without ``digits`` and null ids take no part; vectors of other length count as padded with zeros. Repeated
    candidate rows are ranked each; repeated query ids share one list. An empty side gives no row.
    """
    if k < 1:
        raise ValueError("k must be positive")

    def usable(df):
        rows = df.select(F.col(id).cast("long").alias("id"), digits(vector).alias("v")).filter("id is not null and v is not null")
        return rows

    cand, query = usable(candidates), usable(queries)
    n, m = cand.count(), query.count()
    cand_blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    # Copies of one row are dealt over the blocks by the place where they were read.
    cand = cand.withColumn("copy", F.spark_partition_id())
    query = query.withColumn("copy", F.lit(0)).dropDuplicates(["id", "v"])
    left = _blocks(cand, "cand", CANDIDATES, cand_blocks).withColumn(
        "query", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    right = _blocks(query, "query", QUERIES, query_blocks).withColumn(
        "cand", F.explode(F.sequence(F.lit(0), F.lit(cand_blocks - 1)))
    )
    # Spark takes the copies of the blocks for one: a side that seemed small would be collected by the driver.
    pairs = left.join(unsent(right), ["cand", "query"]).select("cand_rows", "query_rows")
    best = pairs.mapInArrow(_scorer(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
