"""Hard negatives by exact search in an inverted multi-index.

Vectors are cut in two halves, each with its own codebook; a cell is a pair of codes. An anchor's score with any row of a
cell lies within the sum of its two half-scores: half product with the code, give or take the half's norm times the
radius of the code. The multi-sequence heap gives cells by falling upper bound without listing them all first.

Four passes, each a join of (anchor, cell) rows with the stored blocks of cells: the first cells of the heap give the best
positives so far, and with them a bar; all further cells whose bound reaches the bar make the positives certain. The
scores of the positives set the windows. The first cells that may hold scores of a window give negatives so far; all
further cells that may hold better ones within it make them certain. A bound that is not reached certifies that the
cells after it hold nothing; nothing else is left out, so results are exact.

Codebooks are fitted on ``SAMPLE`` rows at most; every row is indexed. Cells are cut into blocks of ``BLOCK`` rows by row
number, and the anchors that visit one are dealt into groups, so that neither a crowded cell nor copies of one row meet
in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lamplight.llm.tables import Scratch, sampled

SAMPLE, BLOCK, GROUP = 16_384, 2_048, 512
#: Codes of a half are chosen so that a cell holds about ``CELL`` rows, ``MOST_CODES`` at most.
CELL, MOST_CODES = 512, 128
#: The first pass visits cells until they hold this many rows for each row that is asked for.
FIRST = 32
#: Sums below this are exact in doubles; those beyond a long are cut to it.
EXACT, LEAST, MOST = 1 << 53, -(1 << 63), (1 << 63) - 1


def _codebook(points: np.ndarray, codes: int) -> np.ndarray:
    """Up to ``codes`` centres of the sampled half-vectors: a few rounds of k-means from evenly spaced rows."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)]
    for _ in range(8):
        own = _nearest(points, centres)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = points[own == c].mean(0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


class Index:
    """Codebooks, radii and cell sizes: at most ``MOST_CODES`` codes a half, whatever the number of rows."""

    def __init__(self, width: int, books: tuple[np.ndarray, np.ndarray]):
        self.width, self.books = width, books
        self.half = (width + 1) // 2
        self.sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
        self.radii = np.zeros((2, *self.sizes.shape))
        self.parts = self.sizes

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(float)
        return x[:, : self.half], x[:, self.half :]

    def encode(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The codes of both halves, and the distances to them."""
        codes, far = [], []
        for part, book in zip(self.halves(x), self.books):
            codes.append(_nearest(part, book))
            far.append(np.sqrt(((part - book[codes[-1]]) ** 2).sum(1)))
        return codes, far

    def fill(self, rows: list) -> None:
        """Takes over (c1, c2, n, r1, r2) of each cell."""
        for c1, c2, n, r1, r2 in rows:
            self.sizes[c1, c2] = n
            self.radii[:, c1, c2] = r1, r2
        self.parts = -(-self.sizes // BLOCK)

    def bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The upper bounds of each half's codes, and upper and lower bounds of each cell, rounding covered."""
        mids, norms = [], []
        for part, book in zip(self.halves(anchor[None]), self.books):
            mids.append(part[0] @ book.T)
            norms.append(float(np.sqrt((part[0] ** 2).sum())))
        widest = [self.radii[0].max(1), self.radii[1].max(0)]
        reach = norms[0] * self.radii[0] + norms[1] * self.radii[1]
        middle = mids[0][:, None] + mids[1][None, :]
        size = sum(norms[h] * (np.sqrt((self.books[h] ** 2).sum(1).max()) + widest[h].max()) for h in (0, 1))
        slack = 1 + 1e-9 * size
        halves = [mids[h] + norms[h] * widest[h] + slack for h in (0, 1)]
        return halves, middle + reach + slack, middle - reach - slack

    def visits(self, halves: list[np.ndarray]) -> Iterator[tuple[int, int, float]]:
        """(c1, c2, bound) by falling sum of the half-bounds: the multi-sequence heap."""
        orders = [np.argsort(-h, kind="stable") for h in halves]
        a, b = (h[o].tolist() for h, o in zip(halves, orders))
        heap, seen = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield int(orders[0][i]), int(orders[1][j]), -bound
            for at in ((i + 1, j), (i, j + 1)):
                if at[0] < len(a) and at[1] < len(b) and at not in seen:
                    seen.add(at)
                    heapq.heappush(heap, (-(a[at[0]] + b[at[1]]), *at))


def _matrix(vectors, width: int) -> np.ndarray:
    """One row for each vector, filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for at, v in enumerate(vectors):
        out[at, : len(v)] = v
    return out


def _dense(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The same from an Arrow list array."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _built(rows: DataFrame, width: int, n: int, scratch: Scratch) -> tuple[Index, DataFrame]:
    """The index, and (cell, part, members): its blocks, each a list of (id, label, v)."""
    codes = int(min(MOST_CODES, max(1, round((n / CELL) ** 0.5))))
    sample = sampled(rows, SAMPLE, "id", "v").select("v").limit(2 * SAMPLE).toPandas()["v"]
    if not len(sample):
        sample = rows.select("v").limit(1).toPandas()["v"]
    points = _matrix(sample, width)
    half = (width + 1) // 2
    x = points.astype(float)
    index = Index(width, (_codebook(x[:, :half], codes), _codebook(x[:, half:], codes)))

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            (c1, c2), (r1, r2) = index.encode(_matrix(part["v"], width))
            yield part.assign(c1=c1.astype(np.int32), c2=c2.astype(np.int32), r1=r1, r2=r2)

    label = rows.schema["label"].dataType.simpleString()
    of_cells = scratch.keep(rows.mapInPandas(coded, f"id long, label {label}, v array<long>, c1 int, c2 int, r1 double, r2 double"))
    cells = of_cells.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    index.fill([tuple(r) for r in cells.collect()])
    wide = len(index.books[1])
    # Numbers of rows as they lie in the stored table: the same on every run, and copies follow one another.
    number = F.monotonically_increasing_id()
    cell = (F.col("c1") * wide + F.col("c2")).alias("cell")
    parts = F.array(*[F.lit(int(p)) for p in index.parts.ravel()])
    numbered = of_cells.select(cell, number.alias("number"), F.struct("id", "label", "v").alias("member"))
    dealt = numbered.withColumn("part", F.pmod(F.col("number"), F.get(parts, F.col("cell"))).cast("int"))
    blocks = scratch.keep(dealt.groupBy("cell", "part").agg(F.collect_list("member").alias("members")))
    scratch.drop(of_cells)
    return index, blocks


def _cut(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), LEAST), MOST) for s in scores.ravel()], np.int64).reshape(scores.shape)


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integers, those beyond a long cut to it."""
    most = int(max(1, np.abs(anchors.astype(float)).max(initial=0))) * int(max(1, np.abs(rows.astype(float)).max(initial=0)))
    if most * max(1, rows.shape[1]) < EXACT:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return _cut(anchors.astype(object) @ rows.astype(object).T)


def _pass(index: Index, blocks: DataFrame, anchors: DataFrame, groups: int, k: int, low: int, high: int, chosen, by_window: bool) -> DataFrame:
    """One pass: the (anchor, cell) rows that ``chosen`` gives, joined with the blocks, and the best ``k`` of each block.

    ``anchors`` are (anchor, id, label, v, windows), ``windows`` the scores of positives; a score s fits that of p if
    low * p <= 100 * s <= high * p. Gives (anchor, at, other, score), ``at`` the window's number, or 0 for positives.
    """
    width, wide = index.width, len(index.books[1])

    def visited(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = {"anchor": [], "cell": [], "part": []}
            for row in part.itertuples(index=False):
                for c1, c2 in chosen(row, _matrix([row.v], width)[0]):
                    for p in range(int(index.parts[c1, c2])):
                        rows["anchor"].append(row.anchor)
                        rows["cell"].append(c1 * wide + c2)
                        rows["part"].append(p)
            yield pd.DataFrame({"anchor": np.array(rows["anchor"], np.int64), "cell": np.array(rows["cell"], np.int32), "part": np.array(rows["part"], np.int32)})

    pairs = anchors.mapInPandas(visited, "anchor long, cell int, part int")
    member = F.struct("anchor", "id", "label", "v", "windows").alias("asked")
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("group")
    asked = pairs.join(anchors, "anchor").select("cell", "part", group, member)
    asked = asked.groupBy("cell", "part", "group").agg(F.collect_list("asked").alias("asked"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, members = (batch.column(name).slice(i, 1).flatten() for name in ("asked", "members"))
                column = lambda rows, name: rows.field(name).to_numpy(zero_copy_only=False)
                ids, labels = column(members, "id"), column(members, "label")
                scores = _products(_dense(asked.field("v"), width), _dense(members.field("v"), width))
                out = []
                facts = zip(column(asked, "anchor"), column(asked, "id"), column(asked, "label"), asked.field("windows").to_pylist())
                for (anchor, own_id, label, windows), own in zip(facts, scores):
                    same = labels == label
                    fits = ~same if by_window else same & (ids != own_id)
                    for at, p in enumerate(windows if by_window else [None]):
                        held = np.flatnonzero(fits)
                        if by_window:
                            # In Python's integers: least and greatest score of the window.
                            least, greatest = -(-low * p // 100), high * p // 100
                            held = held[(own[held] >= max(least, LEAST)) & (own[held] <= min(greatest, MOST))]
                        # A descending order of longs without negating the least of them.
                        best = held[np.lexsort((ids[held], ~own[held]))[:k]]
                        out.append((np.full(len(best), anchor), np.full(len(best), at, np.int32), ids[best], own[best]))
                columns = [np.concatenate(c) for c in zip(*out)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "at", "other", "score"])

    met = asked.join(blocks, ["cell", "part"]).select("asked", "members")
    return met.mapInArrow(scored, "anchor long, at int, other long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id: str = "id", label: str = "label", vector: str = "v",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Vectors hold longs; a score is the inner product, higher ones first, ties by the smaller id. An anchor's positives are
    its first ``positives`` rows of its label and another id. For each, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score are given, ranked from 1.

    Rows of ``rows`` and ``anchors`` with a null id, label or vector, or with a null component, take no part. Shorter vectors
    count as padded with zeros. Repeated rows are candidates each; equal anchors share one list, and anchors of one id that
    differ have one each. Scores beyond a long are cut to it. Other columns do not matter; an empty side gives no row.
    """
    if positives < 1 or negatives < 1:
        raise ValueError("positives and negatives must be positive")
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "hard-negatives")
    kind = rows.schema[label].dataType.simpleString()

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast(kind).alias("label"), F.col(vector).cast("array<long>").alias("v"))
        return own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))

    usable_rows = scratch.keep(usable(rows))
    asked = usable(anchors).distinct().withColumn("windows", F.array().cast("array<long>"))
    asked = scratch.keep(asked.select(F.monotonically_increasing_id().alias("anchor"), "*"))
    n, width = usable_rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m, widest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n or not m:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index, blocks = _built(usable_rows, max(2, width, widest), n, scratch)
    groups = max(1, -(-m // GROUP))
    window = (low, high)

    def first_cells(row, x):
        """Cells from the heap until they hold enough rows; those that lie above all windows are passed over."""
        halves, _, least = index.bounds(x)
        held, wanted, ceiling = 0, FIRST * (negatives if len(row.windows) else positives), None
        if len(row.windows):
            ceiling = max(window[1] * int(p) // 100 for p in row.windows)
        for c1, c2, _ in index.visits(halves):
            if index.sizes[c1, c2] and (ceiling is None or least[c1, c2] <= ceiling):
                yield c1, c2
                held += index.sizes[c1, c2]
                if held >= wanted:
                    return

    def further_cells(row, x):
        """The cells not visited at first that may hold a score between the bar and the ceiling."""
        done = set(first_cells(row, x))
        halves, most, least = index.bounds(x)
        ceiling = max(window[1] * int(p) // 100 for p in row.windows) if len(row.windows) else None
        for c1, c2, bound in index.visits(halves):
            if bound < row.bar:
                return
            if (c1, c2) in done or not index.sizes[c1, c2] or most[c1, c2] < row.bar:
                continue
            if ceiling is None or least[c1, c2] <= ceiling:
                yield c1, c2

    def certain(asked: DataFrame, k: int, by_window: bool, floor) -> DataFrame:
        """(anchor, at, other, score, rank) of the best ``k``: the first cells, then all that the bar does not rule out."""
        early = scratch.keep(_best(_pass(index, blocks, asked, groups, k, *window, first_cells, by_window), k))
        full = early.groupBy("anchor", "at").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        barred = floor(asked).join(full, ["anchor", "at"], "left")
        # A window with too few hits yet is open down to its own end; an anchor's bar is the lowest of its windows.
        bars = barred.groupBy("anchor").agg(
            F.min(F.when(F.col("n") >= k, F.col("worst")).otherwise(F.coalesce(F.col("least"), F.lit(LEAST)))).alias("bar")
        )
        again = asked.join(bars, "anchor").select(*asked.columns, F.when(F.col("bar") > LEAST, F.col("bar").cast("double")).otherwise(F.lit(float("-inf"))).alias("bar"))
        late = _pass(index, blocks, again, groups, k, *window, further_cells, by_window)
        return scratch.keep(_best(early.drop("rank").unionByName(late), k))

    near = certain(
        asked, positives, False, lambda a: a.select("anchor", F.lit(0).alias("at"), F.lit(None).cast("long").alias("least"))
    )
    listed = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))
    ready = scratch.keep(asked.drop("windows").join(listed, "anchor").select("anchor", "id", "label", "v", F.col("p.score").alias("windows"), F.col("p.other").alias("others")))
    # The least score of a window, rounded down: a bar that is too low only costs time.
    least = F.floor(F.col("p").cast("decimal(20,0)") * low / 100)
    open_windows = (F.col("p").cast("decimal(20,0)") * (high - low)) >= 0
    floors = lambda a: a.select("anchor", F.posexplode("windows").alias("at", "p")).filter(open_windows).select(
        "anchor", "at", F.greatest(least, F.lit(LEAST).cast("decimal(20,0)")).cast("long").alias("least")
    )
    hard = certain(ready, negatives, True, floors)
    told = hard.join(ready.select("anchor", "id", "windows", "others"), "anchor")
    return told.select(
        F.col("id").alias("anchor_id"), F.get("others", "at").alias("positive_id"), F.col("rank"), F.col("other").alias("negative_id"),
        F.get("windows", "at").alias("positive_score"), F.col("score").alias("negative_score"),
    )
