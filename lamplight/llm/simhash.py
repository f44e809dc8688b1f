"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits, cut into two segments of 32 bits, differ in at most one bit
of one segment. Each segment is therefore indexed as it is and once for each of its bits left out; fingerprints that
share a key are verified on all 64 bits. Equal fingerprints are folded before.

Groups of a key are never gathered beyond ``GROUP`` fingerprints. A larger group is split by what its members must still
share: within it the other segment's three differing bits at most are cut in two halves again, of which one differs in at
most one bit, and so on down to single bytes, where no more than 2 ** 11 distinct fingerprints can meet. No link is
lost on the way, and no group emits its pairs: each gives a spanning forest of its links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lamplight.llm.bloom import marked
from lamplight.llm.components import components
from lamplight.llm.tables import text_of, turn_to, unsent
from lamplight.session import cut_lineage

DISTANCE = 3
GROUP = 256

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_SEED = 42
_BLOCK = 65_536


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text's word shingles: a bit is set if it is in over half of the hashes.

    Only A to Z are lower-cased. A text of fewer words is one shingle; a text without words has fingerprint zero.
    """
    words = [w for w in _GAP.split((text or "").translate(_LOWER)) if w]
    if not words:
        return 0
    grams = words if width == 1 else map(" ".join, zip(*[words[i:] for i in range(width)]))
    if len(words) < width:
        grams = [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, _SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK]
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | Column = "text", width: int = 3) -> Column:
    """The fingerprint as a signed long; null texts count as empty."""

    @pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        turn_to()
        prints = np.array([fingerprint_of(t, width) for t in texts], np.uint64)
        return pd.Series(prints.view(np.int64))

    # Never null, and known to be: a join on it would else have it made once more, for a test for nulls.
    return F.coalesce(made(text_of(text)), F.lit(0).cast("long"))


def as_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def _variants(at: str, width: int, left: str) -> str:
    """SQL for the keys of the segment of ``width`` bits from bit ``at``: as it is, and with each bit left out.

    A key holds the left-out bit's number (``width`` for none), where the segment lies and its other bits in place;
    ``left`` is where the bits lie that have not been matched yet.
    """
    segment = f"(shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L)"
    return f"""transform(sequence(0, {width}), i -> named_struct('left', {left}, 'variant',
      if(i = {width}, {segment}, {segment} & ~shiftleft(1L, i))
      + shiftleft(cast(i AS bigint), 40) + shiftleft(cast({at} AS bigint), 50)))"""


def _level(rows: DataFrame, width: int) -> DataFrame:
    """One row (key, fp, left) for each variant of the two segments of ``width`` bits from bit ``left``.

    ``key`` in ``rows`` is what the members of a group share already.
    """
    low, high = _variants("left", width, f"left + {width}"), _variants(f"left + {width}", width, "left")
    fresh = rows.select("key", "fp", F.explode(F.expr(f"concat({low}, {high})")).alias("v"))
    return fresh.select(F.xxhash64("key", "v.variant").alias("key"), "fp", F.col("v.left").alias("left"))


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bounded group of distinct fingerprints."""
    n = len(fps)
    label = np.arange(n)
    edges = []
    for i in range(n - 1):
        near = np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= DISTANCE
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                edges.append((i, j))
    return edges


def _linked(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within the groups of a partition sorted by key; a group may run over from batch to batch."""
    turn_to()
    rest = None
    for part in groups:
        part = part if rest is None else pd.concat([rest, part], ignore_index=True)
        key = part["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = part.iloc[last:]
        yield _links(part.iloc[:last])
    if rest is not None:
        yield _links(rest)


def _links(part: pd.DataFrame) -> pd.DataFrame:
    key, fp = part["key"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], int)
    ends = np.r_[starts[1:], len(key)]
    a, b = [], []
    pairs = ends - starts == 2
    first = starts[pairs]
    near = np.bitwise_count(fp[first] ^ fp[first + 1]) <= DISTANCE
    a.append(fp[first[near]])
    b.append(fp[first[near] + 1])
    for s, e in zip(starts[~pairs].tolist(), ends[~pairs].tolist()):
        if found := _spanning(fp[s:e]):
            i, j = np.array(found).T
            a.append(fp[s:e][i])
            b.append(fp[s:e][j])
    out = pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})
    return out.drop_duplicates()


#: Widths of the segments cut at each level. At the last one 8 bits and three left-out ones are free.
WIDTHS = (32, 16, 8)


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that join exactly the distinct fingerprints ``fp`` which chains of links join."""
    # Dealt out before each fingerprint becomes 66 rows: by its bytes the input would seem to fit into a task or two. By a hash,
    # since by the fingerprint itself the step is left out where rows are grouped by it already, and then merged into few.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("left")).repartition(tasks, F.xxhash64("fp"))
    found = None
    for width in WIDTHS:
        level = _level(rows, width)
        counts = cut_lineage(level.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        # Nearly all variants are of one fingerprint alone: these are told where they are made, and not moved again.
        some = marked(level, counts, counts.count(), "maybe").filter("maybe").drop("maybe")
        shared = some.join(unsent(counts), "key")
        last = width == WIDTHS[-1]
        small = shared if last else shared.filter(F.col("n") <= GROUP)
        dealt = small.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        edges = dealt.mapInPandas(_linked, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not last:
            if counts.filter(F.col("n") > GROUP).isEmpty():
                break
            rows = cut_lineage(shared.filter(F.col("n") > GROUP).select("key", "fp", "left"))
    return found.distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id that a document reaches over links, itself included.

    Equal fingerprints are linked, those of empty texts too. Repeated ids are kept as rows; a null id is reached as any
    other but is never the smallest, unless all ids of a component are null. An empty table gives an empty one.
    """
    prints = cut_lineage(docs.select(F.col(id), fingerprint(text).alias("fp")))
    reached = _reached(prints, id)
    smallest = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = reached.select("fp", "component").join(unsent(smallest), "component").select("fp", "component_id")
    return prints.join(unsent(classes), "fp").select(id, "fp", "component_id")


def _reached(prints: DataFrame, id: str) -> DataFrame:
    """(fp, least, component): of each distinct fingerprint the least id that has it, and its component."""
    distinct = prints.groupBy("fp").agg(F.min(id).alias("least"))
    joined = unsent(components(links(distinct.select("fp"))))
    return distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        distinct["fp"], "least", F.coalesce("component", distinct["fp"]).alias("component")
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component left: the one of the smallest id (a null id only where all are null).

    Of rows that repeat that id and fingerprint one stays, any of them.
    """
    print_ = f"{text}__fp"
    if print_ in docs.columns:
        raise ValueError(f"a column {print_} is there already")
    printed = docs.withColumn(print_, fingerprint(text))
    reached = _reached(cut_lineage(printed.select(F.col(id), F.col(print_).alias("fp"))), id)
    first = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    kept = reached.groupBy("component").agg(F.min(first).alias("first")).select(
        F.col("first.fp").alias("kept_fp"), F.col("first.least").alias("kept_id")
    )
    match = (printed[print_] == kept["kept_fp"]) & printed[id].eqNullSafe(kept["kept_id"])
    # The id is part of the key, so a group of copies is spread over all tasks.
    return printed.join(unsent(kept), match, "left_semi").dropDuplicates([print_, id]).select(*docs.columns)
