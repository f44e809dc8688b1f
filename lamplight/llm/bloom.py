"""A blocked Bloom filter in DataFrame functions: which rows may have a key of a list, told where they lie.

A key touches eight bits of one block of 256, so a probe reads one row of the filter. The filter is an aggregation of the
list; it never passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys a block of 256 bits is made for: about one false hit in two thousand probes.
KEYS_A_BLOCK = 16
#: Blocks that are sent to all tasks at most (2 MB of bits).
MOST_BLOCKS = 1 << 16


def blocks_for(count: int) -> int:
    return max(1, -(-count // KEYS_A_BLOCK))


def bits(key: str | Column, blocks: int) -> list[Column]:
    """The number of the key's block, and its bits in the four longs of it."""
    places = F.xxhash64(key, F.lit(1))

    def bit(n):
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(places, 6 * n).bitwiseAND(63).cast("int"))

    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")
    return [block, *[bit(2 * w).bitwiseOR(bit(2 * w + 1)).alias(f"w{w}") for w in range(4)]]


def filter_of(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, held0 .. held3): the blocks that hold a key."""
    placed = keys.select(*bits(key, blocks))
    return placed.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"held{w}") for w in range(4)])


def marked(rows: DataFrame, keys: DataFrame, count: int, to: str, key: str = "key", most: int = MOST_BLOCKS) -> DataFrame:
    """``rows`` with a boolean ``to``: false only where ``key`` is none of the ``count`` ``keys``. No row is moved.

    The filter has ``most`` blocks at most; of more keys than these are made for, it lets through more than it need.
    """
    blocks = min(blocks_for(count), most)
    block, *words = bits(key, blocks)
    names = {"block": "bloom__block", **{f"w{i}": f"bloom__w{i}" for i in range(4)}}
    held = filter_of(keys, blocks, key).withColumnRenamed("block", "bloom__block")
    met = rows.withColumns({names["block"]: block, **{names[f"w{i}"]: w for i, w in enumerate(words)}}).join(
        F.broadcast(held), "bloom__block", "left"
    )
    hit = F.expr(" AND ".join(f"(held{i} & bloom__w{i}) = bloom__w{i}" for i in range(4)))
    return met.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(to))
