"""Centroid clustering over integers with an incremental distance matrix.

Every vector keeps its exact inner product with each centroid. When centroids move, only their nonzero component changes
are multiplied and added to the kept products; the nearest centroid follows from products and centroid norms. Sums of
clusters are kept as well: only vectors that changed cluster are added and taken away. A round is one pass over the
stored vectors and one small aggregation; rounds are written to the shared folder, so that a lost executor costs a task,
and a round's table is deleted once the next is written. What the driver holds are the centroids and the sums of clusters.

Whole numbers stay exact: products are taken in doubles where they cannot exceed 2 ** 53, in longs where they fit, and
in Python's integers beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.tables import Scratch
from lamplight.llm.vector_search import digits

MOST = (1 << 63) - 1


class _Numbers:
    """Arithmetic that is exact for components up to ``most`` in vectors of ``width``."""

    def __init__(self, most: int, width: int):
        # A distance is at most width * (2 * most) ** 2.
        room = 4 * max(1, width) * most * most
        self.kind = "float" if room < 1 << 53 else "long" if room < 1 << 63 else "wide"
        self.stored = "string" if self.kind == "wide" else "long"

    def of(self, x: np.ndarray) -> np.ndarray:
        return x.astype({"float": np.float64, "long": np.int64, "wide": object}[self.kind])

    def whole(self, x: np.ndarray) -> np.ndarray:
        return x if self.kind == "wide" else x.astype(np.int64)

    def lists(self, x: np.ndarray) -> pa.Array:
        flat = self.whole(x).ravel()
        values = pa.array([str(v) for v in flat]) if self.kind == "wide" else pa.array(flat)
        return pa.FixedSizeListArray.from_arrays(values, x.shape[1]).cast(pa.list_(values.type))

    def read(self, lists: pa.Array, width: int) -> np.ndarray:
        flat = lists.flatten()
        values = np.array([int(v) for v in flat.to_pylist()], object) if self.kind == "wide" else flat.to_numpy(zero_copy_only=False)
        return values.reshape(-1, width)


def _assigned(numbers: _Numbers, centroids: list[list[int]], moves: list[list[int]]):
    """A pass over (id, v, dots, cluster): products moved by ``moves``, then the nearest of ``centroids``.

    Without products in its input, a pass takes the moves as those of centroids that were at zero.
    """
    k, width = len(centroids), len(centroids[0])
    norms = np.array([sum(x * x for x in c) for c in centroids], object)
    changed = [np.flatnonzero(np.array(m, object) != 0) for m in moves]
    steps = [numbers.of(np.array([m[i] for i in at], object)) for m, at in zip(moves, changed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, v = batch.num_rows, batch.column("v")
            x = numbers.of(v.flatten().to_numpy(zero_copy_only=False).reshape(n, width))
            first = batch.schema.get_field_index("dots") < 0
            dots = np.zeros((n, k), object if numbers.kind == "wide" else np.int64) if first else numbers.read(batch.column("dots"), k).copy()
            for c in range(k):
                if len(changed[c]):
                    dots[:, c] += numbers.whole(x[:, changed[c]] @ steps[c])
            far = (norms if numbers.kind == "wide" else norms.astype(np.int64)) - 2 * dots
            cluster = far.argmin(1) if n else np.zeros(0, int)
            own = numbers.whole((x * x).sum(1)) + far[np.arange(n), cluster]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), v, numbers.lists(dots), pa.nulls(n, pa.int32()) if first else batch.column("cluster"),
                    pa.array(cluster.astype(np.int32)), pa.array([min(d, MOST) for d in own.tolist()], pa.int64()),
                ],
                ["id", "v", "dots", "was", "cluster", "distance"],
            )

    return run


def _sums(state: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how the number of its vectors and their sum have changed. As many rows as clusters and components.

    Each batch is added up where it lies, in halves of 32 bits, whose sums over a batch fit longs; a count is the component
    after the last.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], 1)
            to, off = batch.column("cluster").to_numpy(), batch.column("was").fill_null(-1).to_numpy()
            ends = sorted({*to.tolist(), *off.tolist()} - {-1})
            high, low = v >> 32, v & 0xFFFFFFFF
            parts = [[part[to == c].sum(0) - part[off == c].sum(0) for c in ends] for part in (high, low)]
            flat = [np.array(p, np.int64).ravel() for p in parts]
            place = np.tile(np.arange(width + 1), len(ends))
            columns = [np.repeat(np.array(ends, np.int64), width + 1), place, *flat]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["c", "i", "high", "low"])

    moved = state.filter("was IS NULL OR was <> cluster").select("v", "was", "cluster")
    parts = moved.mapInArrow(added, "c long, i long, high long, low long").groupBy("c", "i")
    total = [F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("high", "low")]
    sums: dict[int, list[int]] = {}
    for r in parts.agg(*total).collect():
        sums.setdefault(r["c"], [0] * (width + 1))[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return {c: (s[width], s[:width]) for c, s in sums.items()}


def digest(centroid: list[int]) -> str:
    """Lowercase hex sha256 of a centroid's components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", width: int = 64, scale: int = 1_024, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector, in whole numbers.

    Vectors of ``width`` components, none of them null or non-finite, are kept, each as floor(scale * x). Centroids start
    as the ``k`` kept vectors whose ids, as text after ``salt``, have the smallest sha256 (all, if there are fewer; of
    repeated ids the smaller vector first; null ids start none unless nothing else is left). A round assigns each vector
    to the nearest centroid (ties: the smaller number), then sets every non-empty centroid to the floor of its vectors'
    mean; after the last round vectors are assigned once more. Rounds that change no centroid are not repeated.

    Repeated rows count each; other columns do not matter; an empty table, or no kept vector, gives no row. Components are
    longs (larger ones are cut to these); distances and sums beyond a long are cut to it.
    """
    if k < 1 or rounds < 0 or width < 1:
        raise ValueError("k and width must be positive, rounds not negative")
    spark = rows.sparkSession
    schema = f"id {rows.schema[id].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    scratch = Scratch(spark, "centroids")
    kept = scratch.keep(rows.select(F.col(id).alias("id"), digits(vector, scale).alias("v")).filter(F.size("v") == width))
    # The least long has no absolute value; -1 - x stands for it, and one is added below.
    reach = F.greatest(F.array_max("v"), F.bitwise_not(F.array_min("v")))
    n, most = kept.agg(F.count("*"), F.coalesce(F.max(reach), F.lit(0))).first()
    if n == 0:
        scratch.drop(kept)
        return spark.createDataFrame([], schema).withColumnRenamed("id", id)
    most = int(most) + 1
    numbers = _Numbers(most, width)
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    now = [list(r["v"]) for r in kept.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()]
    made = f"id {kept.schema['id'].dataType.simpleString()}, v array<long>, dots array<{numbers.stored}>, was int, cluster int, distance long"

    def passed(source: DataFrame, columns: list[str], moves: list[list[int]]) -> DataFrame:
        new = scratch.keep(source.select(*columns).mapInArrow(_assigned(numbers, now, moves), made))
        scratch.drop(source)
        return new

    state = passed(kept, ["id", "v"], now)
    held = {c: (0, [0] * width) for c in range(len(now))}
    for _ in range(rounds):
        for c, (more, sums) in _sums(state, width).items():
            held[c] = (held[c][0] + more, [a + b for a, b in zip(held[c][1], sums)])
        after = [[s // count for s in sums] if count else now[c] for c, (count, sums) in sorted(held.items())]
        moves = [[b - a for a, b in zip(old, new)] for old, new in zip(now, after)]
        if after == now:
            break
        now = after
        state = passed(state, ["id", "v", "dots", "cluster"], moves)
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")
    totals = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(total).collect()}
    facts = spark.createDataFrame(
        [(c, min(d, MOST), min(sum(totals.values()), MOST), digest(now[c])) for c, d in sorted(totals.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # As many rows as centroids.
    told = state.select("id", "cluster", "distance").join(F.broadcast(facts), "cluster")
    return told.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
