"""Connected components by alternating large and small stars.

Each round is a few shuffles on node ids; the number of rounds grows with the logarithm of the longest path. Between
rounds the edges are cut from their lineage in the shared folder. Hot nodes are folded by partial aggregation; joins on
them are left to the adaptive skew join, and none passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamplight.llm.tables import unsent
from lamplight.session import cut_lineage

MOST_ROUNDS = 60


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).withColumn("m", F.least("a", "m"))
    upper = both.filter("b > a").join(unsent(least), "a")
    return upper.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below are linked to the least of these. Edges hold the larger node first."""
    least = _least_neighbour(edges)
    below = edges.join(unsent(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge (a, b), component the least node reachable.

    Loops, repeated and reversed edges are allowed; edges with a null end are passed over. Nodes without an edge to
    another node are not listed.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = cut_lineage(edges)
    state = None
    for _ in range(MOST_ROUNDS):
        edges = cut_lineage(_small_star(_large_star(edges)))
        # Stars only: every edge's lower end is nobody's upper end. The sums settle exactly when the edges do.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
