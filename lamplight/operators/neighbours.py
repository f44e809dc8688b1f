"""The chunks next to each hit, in reading order of its report.

All reports of all hits go through one join. For one question, ranking by distance on
each side of a hit with a small limit lets every task drop all but ``n`` rows per hit
and side before anything is shuffled, so a huge report costs a scan, not a sort in one
task. For many questions, positions are looked up instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lamplight.operators.positions import reading_positions

LAYOUT = ("channel_id", "report_bucket")


def _by_distance(hits: DataFrame, chunks: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """A few hits, broadcast: rank the chunks of their reports by distance on each side."""
    parents = hits.select(
        "question_id",
        "report_id",
        *keys,
        F.col("id").alias("parent_id"),
        F.col("page_number").alias("_page"),
        F.col("chunk_index").alias("_chunk"),
    )
    around = chunks.select("id", "report_id", *keys, "page_number", "chunk_index").join(
        F.broadcast(parents), ["report_id", *keys]
    )
    here = F.struct(F.struct("page_number", "chunk_index").alias("k"))
    there = F.struct(F.struct("_page", "_chunk").alias("k"))
    around = around.where(here != there).withColumn("_side", F.when(here > there, 1).otherwise(-1))
    nearest = Window.partitionBy("question_id", "parent_id", "_side").orderBy(
        F.col("page_number") * F.col("_side"), F.col("chunk_index") * F.col("_side")
    )
    close = around.withColumn("_near", F.row_number().over(nearest)).where(F.col("_near") <= n)
    return close.select(
        "question_id", "parent_id", "id", *keys, (F.col("_near") * F.col("_side")).cast("long").alias("offset")
    )


def _by_position(hits: DataFrame, chunks: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Any number of hits: number the chunks of their reports, look up the exact positions.

    Work grows with the chunks plus the hits, never with their product, even when one
    report holds most of both.
    """
    touched = hits.select("report_id", *keys).distinct()
    narrow = chunks.select("id", "report_id", *keys, "page_number", "chunk_index")
    placed = reading_positions(narrow.join(touched, ["report_id", *keys], "left_semi"))
    placed = placed.select("id", "report_id", *keys, "pos")
    parents = hits.select("question_id", F.col("id").alias("parent_id")).join(
        placed.select(F.col("id").alias("parent_id"), "report_id", F.col("pos").alias("_at")), "parent_id"
    )
    steps = F.array(*[F.lit(o).cast("long") for o in (*range(-n, 0), *range(1, n + 1))])
    wanted = parents.withColumn("offset", F.explode(steps)).withColumn("pos", F.col("_at") + F.col("offset"))
    return wanted.join(placed, ["report_id", "pos"]).select("question_id", "parent_id", "id", *keys, "offset")


def neighbour_ids(hits: DataFrame, chunks: DataFrame, n: int, bounded: bool) -> DataFrame:
    """(question_id, parent_id, id, offset) for offsets -n..-1 and 1..n around each hit.

    A neighbour that is itself a hit keeps its position but is not returned. ``bounded``
    says the hits are those of one question, at most its ``top_k``.
    """
    keys = [c for c in LAYOUT if c in chunks.columns and c in hits.columns]
    close = (_by_distance if bounded else _by_position)(hits, chunks, n, keys)
    anchors = hits.select("question_id", "id")
    return close.join(F.broadcast(anchors) if bounded else anchors, ["question_id", "id"], "left_anti")


def attach(hits: DataFrame, chunks: DataFrame, n: int, bounded: bool) -> DataFrame:
    """Hits and their neighbours in display order.

    Hits are shown report by report, reports by their best hit; ``position`` numbers
    that order while ``primary_rank`` keeps the order over all reports. A chunk between
    two hits appears once for each of them.
    """
    primary = hits.select(
        "*",
        F.lit(False).alias("is_neighbour"),
        F.lit(None).cast(hits.schema["id"].dataType).alias("neighbour_of"),
        F.lit(0).cast("long").alias("offset"),
    )
    rows = primary
    if n > 0:
        found = neighbour_ids(hits, chunks, n, bounded)
        keys = [c for c in LAYOUT if c in found.columns]
        extra = [c for c in hits.columns if c in chunks.columns and c not in ("id", *keys)]
        content = chunks.select("id", *keys, *extra).join(
            F.broadcast(found) if bounded else found, ["id", *keys]
        )
        rank = hits.select("question_id", F.col("id").alias("parent_id"), "primary_rank")
        neighbours = content.join(rank, ["question_id", "parent_id"]).select(
            "question_id",
            "id",
            *keys,
            *extra,
            "primary_rank",
            F.lit(True).alias("is_neighbour"),
            F.col("parent_id").alias("neighbour_of"),
            "offset",
        )
        rows = primary.unionByName(neighbours, allowMissingColumns=True)
    report_rank = F.min("primary_rank").over(Window.partitionBy("question_id", "report_id"))
    order = Window.partitionBy("question_id").orderBy("_report_rank", "primary_rank", "offset")
    return (
        rows.withColumn("_report_rank", report_rank)
        .withColumn("position", F.row_number().over(order))
        .drop("_report_rank")
    )
