"""Reading positions inside a report without sorting a whole report in one task.

A report may hold a large share of all rows, so a window over the report alone is
out. Rows are numbered inside small tiles of the ordering key, tiles are counted,
and running tile totals give each tile its offset. Rows shuffle once, by tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TILE = 4096


def running_offsets(sizes: DataFrame, group: list[str], order: list[str], tile: int = TILE) -> DataFrame:
    """``sizes`` (group, order, n) plus ``offset``: the sum of n over earlier rows of the group.

    The first order column is an integer; its blocks of ``tile`` values are totalled
    first, so no window spans more than one block's rows or one group's blocks.
    """
    rows = sizes.withColumn("_block", F.floor(F.col(order[0]) / tile))
    in_block = Window.partitionBy(*group, "_block").orderBy(*order)
    over_blocks = Window.partitionBy(*group).orderBy("_block")
    before = (Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*group, "_block").agg(F.sum("n").alias("_n"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(over_blocks.rowsBetween(*before)), F.lit(0)))
    return (
        rows.withColumn("_within", F.coalesce(F.sum("n").over(in_block.rowsBetween(*before)), F.lit(0)))
        .join(blocks.drop("_n"), [*group, "_block"])
        .withColumn("offset", F.col("_within") + F.col("_before"))
        .drop("_block", "_within", "_before", "n")
    )


def tiled_positions(
    rows: DataFrame, group: list[str], major: str, minor: str, name: str = "pos", tile: int = TILE
) -> DataFrame:
    """Number rows 1.. inside ``group`` in (major, minor) order.

    ``major`` and ``minor`` are integers and unique together in a group, so a tile
    of one major value and ``tile`` minor values is never larger than ``tile`` rows.
    """
    rows = rows.withColumn("_tile", F.floor(F.col(minor) / tile))
    key = [*group, major, "_tile"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    offsets = running_offsets(sizes, group, [major, "_tile"], tile)
    in_tile = Window.partitionBy(*key).orderBy(minor)
    return (
        rows.withColumn("_in_tile", F.row_number().over(in_tile))
        .join(offsets, key)
        .withColumn(name, (F.col("_in_tile") + F.col("offset")).cast("long"))
        .drop("_tile", "_in_tile", "offset")
    )


def reading_positions(chunks: DataFrame) -> DataFrame:
    return tiled_positions(chunks, ["report_id"], "page_number", "chunk_index")
