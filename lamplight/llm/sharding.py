"""Permutation-filled lookup table: constant-time placement of keys on shards.

Every shard has its own order of preference over the slots of a prime-sized table: it starts at an offset and
steps by a skip, both hashed from its name. Shards take turns; at its turn a shard claims the first slot of
its order that is still free. A key is hashed to a slot and belongs to the shard that holds it. When a shard leaves
or joins, nearly all slots keep their holder, and the holders differ by one slot at most in number.

The table's size depends on the parameters alone, so the broadcast is bounded: ``slots`` is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A table of more slots is refused, so that its broadcast stays under a megabyte.
MOST_SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def key_hash(*keys: str | Column) -> Column:
    """A non-negative 60-bit hash of the keys' text; a null key counts as the empty text."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """One row per slot: ``slot`` int, ``shard`` int (index in ``shards``).

    No shard, a size that is no prime, or fewer slots than shards is a ValueError. Shards of the same name would share
    one order and are refused too.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    count = len(shards)
    names = F.array(*[F.lit(name) for name in shards])
    offsets = F.transform(names, lambda n: key_hash(F.concat(n, F.lit("/offset"))) % slots)
    skips = F.transform(names, lambda n: key_hash(F.concat(n, F.lit("/skip"))) % (slots - 1) + 1)
    # held[s]: the shard that holds slot s, or -1; tried[i]: how far shard i has come in its order.
    start = F.struct(
        offsets.alias("offset"), skips.alias("skip"), F.array_repeat(F.lit(-1), slots).alias("held"),
        F.array_repeat(F.lit(0), count).alias("tried"),
    )

    def put(array, place, value, length):
        return F.concat(F.slice(array, 1, place), F.array(value), F.slice(array, place + 2, length))

    def slot_of(state, who, j):
        return ((F.get(state["offset"], who) + j * F.get(state["skip"], who)) % slots).cast("int")

    def claim(state, turn):
        who = turn % count
        first = F.get(state["tried"], who)
        free = lambda upto: F.get(
            F.filter(F.sequence(first, upto), lambda j: F.get(state["held"], slot_of(state, who, j)) == -1), 0
        )
        # Mostly one of the next few is free; the rest of the order is looked through only if not.
        step = F.coalesce(free(F.least(first + 31, F.lit(slots - 1))), free(F.lit(slots - 1)))
        with_step = F.array(step)  # bound by a lambda, so that it is searched once
        return F.aggregate(
            with_step, state,
            lambda old, j: F.struct(
                old["offset"].alias("offset"), old["skip"].alias("skip"),
                put(old["held"], slot_of(old, who, j), who, slots).alias("held"),
                put(old["tried"], who, j + 1, count).alias("tried"),
            ),
        )

    filled = spark.range(1).select(
        F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, claim, lambda s: s["held"]).alias("held")
    )
    return filled.select(F.posexplode("held").alias("slot", "shard"))


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int, to: str = "shard") -> DataFrame:
    """``df`` with the index of each row's shard in a new column ``to``, and the slot in ``to_slot``.

    Rows are never moved or dropped: null keys count as the empty text, repeated keys go to one shard, an empty table
    gives an empty table. To spread one hot key, pass further columns (a row id) as keys. A column of the new names
    in ``df`` is a ValueError.
    """
    slot = f"{to}_slot"
    if taken := {to, slot} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    held = lookup_table(df.sparkSession, shards, slots).select(
        F.col("slot").alias(slot), F.col("shard").alias(to)
    )
    placed = df.withColumn(slot, (key_hash(*keys) % slots).cast("int"))
    return placed.join(F.broadcast(held), slot).select(*df.columns, slot, to)
