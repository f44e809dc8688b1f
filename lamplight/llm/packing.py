"""Packing by vector bin packing with the dot-product heuristic.

A text's ids, an end mark after them, are cut into full sequences and a rest. A rest is a vector of what it takes of
three limits: tokens, segments and loss-bearing tokens. Sequences are filled one at a time: among the rests that fit,
the one whose vector has the largest dot product with what is free in the sequence is placed. Where none fits whole, the
best one is cut to fill the sequence, and what is left of it waits on. So only a sequence that has used up its segments or
its loss-bearing tokens is padded. What is left at the end of a run of ``WAITING`` rests is dealt to sequences whose
lengths are powers of two, which need no padding.

Packing happens where the rows are read: nothing is shuffled, and a sequence never spans two partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.tables import release, text_of, turn_to
from lamplight.llm.tokens import WORK, encoder

TOKENIZER = "word_bpe_49k.json"
END = 1
WAITING = 512

PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long,"
    " loss_tokens long, padding long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 2_048
    segments: int = 128
    loss: int = 2_048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _loss(start: int, length: int, loss_from: int) -> int:
    return max(0, start + length - max(start, loss_from))


def _prefix(start: int, length: int, loss_from: int, room: int) -> int:
    """The longest prefix of a piece with no more than ``room`` loss-bearing tokens."""
    return min(length, max(0, loss_from - start) + room)


def pack(items: list[tuple[int, int, int, int]], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length) in order; items are (document, start, length, loss_from).

    Every token of every item lands in exactly one piece. Items may be of any length; repeated ones are packed as they are.
    """
    full = np.array([limits.tokens, limits.segments, limits.loss], float)
    left = [list(i) for i in items if i[2] > 0]
    need = np.array([(i[2], 1, _loss(i[1], i[2], i[3])) for i in left], float).reshape(-1, 3)
    out: list[list[tuple[int, int, int]]] = []
    bin_: list[tuple[int, int, int]] = []
    free = full.copy()
    waiting = len(left)

    def close():
        out.append(bin_.copy())
        bin_.clear()
        free[:] = full

    while waiting:
        gain = (need / full) @ (free / full)
        fits = (need <= free).all(1) & (need[:, 1] > 0)
        if fits.any():
            at = int(np.argmax(np.where(fits, gain, -1)))
            length = left[at][2]
        else:
            at = int(np.argmax(np.where(need[:, 1] > 0, gain, -1)))
            doc, start, length, loss_from = left[at]
            length = min(int(free[0]), _prefix(start, length, loss_from, int(free[2])))
            if free[1] < 1 or length < 1:
                close()
                continue
        doc, start, _, loss_from = left[at]
        bin_.append((doc, start, length))
        free -= (length, 1, _loss(start, length, loss_from))
        left[at][1], left[at][2] = start + length, left[at][2] - length
        if left[at][2]:
            need[at] = left[at][2], 1, _loss(left[at][1], left[at][2], loss_from)
        else:
            need[at] = 0
            waiting -= 1
        if free[0] < 1:
            close()
    if bin_:
        out += _powers(bin_)
    return out


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in sequences whose lengths are the powers of two that make up their sum, largest first."""
    total = sum(p[2] for p in pieces)
    out = []
    queue = [list(p) for p in pieces]
    for power in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        sequence = []
        while power:
            doc, start, length = queue[0]
            take = min(length, power)
            sequence.append((doc, start, take))
            power -= take
            if take == length:
                queue.pop(0)
            else:
                queue[0][1:] = start + take, length - take
        out.append(sequence)
    return out


def sequences(
    docs: DataFrame,
    ids: list[str],
    text: str = "text",
    loss_from: str | None = None,
    limits: Limits = Limits(),
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the columns ``ids`` of its document, and where the piece comes from and lies.

    ``start``, ``length``: the piece in its document's ids; ``ids_crc32`` of its ids as little-endian unsigned 32-bit
    integers; ``doc_tokens`` with the end mark; ``sequence_id``, ``offset``: its place; ``segment``: its number in the
    sequence; ``loss_tokens`` in it; ``padding`` of its sequence, 0 at a power of two. ``with_ids`` adds the ids themselves.
    Ids of a document before ``loss_from`` (a column; null counts as 0) bear no loss. A null or empty text is its end
    mark alone. Repeated rows are packed each for itself. A sequence id holds the partition's number above
    40 bits; a partition packs its rows in the order in which it reads them.
    """
    path = path or tokenizer_path()
    carried = docs.select(
        # as text, since a null would turn a batch of integers into floats
        *[F.col(c).cast("string").alias(f"id_{i}") for i, c in enumerate(ids)], text_of(text).alias("text"),
        (F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0)).cast("long").alias("loss_from"),
    )
    names = [f"id_{i}" for i in range(len(ids))]
    schema = ", ".join([*(f"{n} string" for n in names), PIECES, *(["ids array<long>"] if with_ids else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to(WORK)
        coder = encoder(path)
        base = TaskContext.get().partitionId() << 40
        made = 0
        held: list[tuple] = []  # (id values, ids, loss_from) of the documents that wait
        items: list[tuple[int, int, int, int]] = []

        def rows(packed):
            nonlocal made
            out = []
            for sequence in packed:
                at, total = 0, sum(p[2] for p in sequence)
                padding = 0 if total & (total - 1) == 0 else limits.tokens - total
                for segment, (doc, start, length) in enumerate(sequence):
                    values, coded, first = held[doc]
                    part = coded[start : start + length]
                    row = (
                        *values, start, length, zlib.crc32(part.tobytes()), len(coded), base + made, at, segment,
                        _loss(start, length, first), padding,
                    )
                    out.append((*row, part.tolist()) if with_ids else row)
                    at += length
                made += 1
            columns = [*names, *(c.split()[0] for c in PIECES.split(", ")), *(["ids"] if with_ids else [])]
            return pd.DataFrame(out, columns=columns)

        for batch in batches:
            # The more texts go together, the fewer of their stretches are different.
            ids = coder.ids(batch["text"].tolist())
            for at in range(0, len(batch), 512):
                part, coded = batch.iloc[at : at + 512], ids[at : at + 512]
                values = list(part[names].itertuples(index=False, name=None)) if names else [()] * len(part)
                full = []
                for value, own, first in zip(values, coded, part["loss_from"].tolist()):
                    own = np.append(own, np.uint32(END)).astype("<u4")
                    held.append((value, own, first))
                    start, doc = 0, len(held) - 1
                    while len(own) - start >= limits.tokens and _loss(start, limits.tokens, first) <= limits.loss:
                        full.append([(doc, start, limits.tokens)])
                        start += limits.tokens
                    if start < len(own):
                        items.append((doc, start, len(own) - start, first))
                if full:
                    yield rows(full)
                if len(items) >= WAITING:
                    yield rows(pack(items, limits))
                    held.clear()
                    items.clear()
        yield rows(pack(items, limits))
        release()

    # Ids travel under other names, so that clashes with the new columns are the caller's to see.
    taken = {c.split()[0] for c in PIECES.split(", ")} & set(ids)
    if taken:
        raise ValueError(f"id columns {sorted(taken)} clash with the pieces' own")
    pieces = carried.mapInPandas(run, schema)
    back = [F.col(n).cast(docs.schema[c].dataType).alias(c) for n, c in zip(names, ids)]
    return pieces.select(*back, *[c for c in pieces.columns if c not in names])
