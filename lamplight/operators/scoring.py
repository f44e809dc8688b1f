"""First-stage retrieval: both candidate lists of every question in one corpus scan.

The corpus is never joined with the questions row by row. Each task holds the
question vectors, scores whole Arrow batches against them, and keeps only its best
``k`` rows per question and arm; those few rows are all that is shuffled. A hot
tenant is split over tasks like any other data, since nothing is grouped by tenant.

The question vectors travel in the task closure. They are bounded: at most
``QUESTIONS_PER_PASS`` of them per scan, longer question lists take more scans.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lamplight.functions.memory import release

QUESTIONS_PER_PASS = 256
# Cells of the dense score matrix per slice of a batch (64 MB of doubles).
CELLS_PER_SLICE = 8_000_000

# Parts in which the tasks' lists are merged before the last merge.
MERGE_FAN = 32

# Fixed value: scores are compared at nine digits, so engines agree on ties.
SCORE_DIGITS = 9


@dataclass(frozen=True)
class Question:
    """A question inside one channel, as text and as vectors."""

    question_id: object
    text: str = ""
    dense: tuple[float, ...] = ()
    sparse: dict[int, float] = field(default_factory=dict)
    scope: object = None


class _Best:
    """Running best ``k`` (score, id) pairs of one question; smaller is better."""

    __slots__ = ("k", "rows", "bar")

    def __init__(self, k: int):
        self.k, self.rows, self.bar = k, [], np.inf

    def offer(self, scores: np.ndarray, ids) -> None:
        at = np.flatnonzero(scores <= self.bar)
        if at.size > self.k:
            # Of the rows tied at the cut only those of the smallest ids can stay.
            found = scores[at]
            cut = np.partition(found, self.k - 1)[self.k - 1]
            under, tied = at[found < cut], at[found == cut]
            least = pc.select_k_unstable(ids.take(pa.array(tied)), self.k - len(under), [("", "ascending")])
            at = np.concatenate([under, tied[least.to_numpy(zero_copy_only=False)]])
        if not at.size:
            return
        fresh = zip(scores[at].tolist(), ids.take(pa.array(at)).to_pylist())
        self.rows = heapq.nsmallest(self.k, [*self.rows, *fresh])
        if len(self.rows) == self.k:
            self.bar = self.rows[-1][0]


def _dense_block(vectors: pa.ListArray, dimension: int) -> np.ndarray:
    lengths = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or (lengths != dimension).any():
        raise ValueError(f"every vector must have {dimension} numbers")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def _sparse_block(maps: pa.MapArray, tokens: np.ndarray, owners, n_questions: int) -> np.ndarray:
    """Inner products of a block of maps with every question, rows by questions.

    ``owners`` lists, token by token, the questions using it and their weights.
    """
    starts, questions, weights = owners
    offsets = maps.offsets.to_numpy()
    base = offsets[0]
    keys = maps.keys.to_numpy(zero_copy_only=False)[base : offsets[-1]]
    values = maps.items.to_numpy(zero_copy_only=False)[base : offsets[-1]].astype(np.float64)
    rows = np.repeat(np.arange(len(maps)), np.diff(offsets))
    slot = np.minimum(np.searchsorted(tokens, keys), len(tokens) - 1)
    hit = tokens[slot] == keys
    rows, slot, values = rows[hit], slot[hit], values[hit]
    fan = starts[slot + 1] - starts[slot]
    pick = np.repeat(starts[slot], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    cells = np.repeat(rows, fan) * n_questions + questions[pick]
    products = np.repeat(values, fan) * weights[pick]
    size = len(maps) * n_questions
    return np.bincount(cells, weights=products, minlength=size).reshape(len(maps), n_questions)


def _token_owners(questions: Sequence[Question]):
    uses = sorted((t, n, float(w)) for n, q in enumerate(questions) for t, w in q.sparse.items())
    tokens, first = np.unique(np.array([u[0] for u in uses], dtype=np.int64), return_index=True)
    starts = np.append(first, len(uses))
    return tokens, (
        starts,
        np.array([u[1] for u in uses], dtype=np.int64),
        np.array([u[2] for u in uses], dtype=np.float64),
    )


def _scorer(questions: Sequence[Question], k: int, dense: bool, sparse: bool, zero_overlap: bool, id_type):
    """A batch-to-candidates function for ``mapInArrow``.

    Batches carry ``id``, ``scope`` and the vector columns the arms need.
    """
    matrix = np.array([q.dense for q in questions], dtype=np.float64) if dense else None
    lengths = np.linalg.norm(matrix, axis=1) if dense else None
    tokens, owners = _token_owners(questions) if sparse else (None, None)
    scopes = [q.scope for q in questions]
    labels = [q.question_id for q in questions]
    arms = (["dense"] if dense else []) + (["sparse"] if sparse else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(arm, n): _Best(k) for arm in arms for n in range(len(questions))}
        step = max(1, CELLS_PER_SLICE // max(1, len(questions)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                block = whole.slice(at, step)
                ids, where = block.column("id"), block.column("scope")
                mine = {s: np.asarray(pc.equal(where, s)) for s in set(scopes) if s is not None}
                scores = {}
                if dense:
                    v = _dense_block(block.column("embedding"), matrix.shape[1])
                    scale = np.linalg.norm(v, axis=1)[:, None] * lengths[None, :]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        scores["dense"] = np.round(1.0 - (v @ matrix.T) / scale, SCORE_DIGITS)
                if sparse and len(tokens):
                    ip = _sparse_block(block.column("sparse_embedding"), tokens, owners, len(questions))
                    scores["sparse"] = np.round(-ip, SCORE_DIGITS)
                elif sparse:
                    scores["sparse"] = np.zeros((block.num_rows, len(questions)))
                for arm, table in scores.items():
                    for n in range(len(questions)):
                        column = table[:, n]
                        allowed = np.ones(len(column), bool) if scopes[n] is None else mine[scopes[n]]
                        if arm == "sparse" and not zero_overlap:
                            allowed = allowed & (column < 0)
                        column = np.where(allowed & ~np.isnan(column), column, np.nan)
                        best[arm, n].offer(column, ids)
            whole = block = None  # not held while the next batch is read
            release()
        rows = [(labels[n], arm, i, s) for (arm, n), b in best.items() for s, i in b.rows]
        if rows:
            q, a, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(a), pa.array(i, type=id_type), pa.array(s, type=pa.float64())],
                names=["question_id", "arm", "id", "score"],
            )

    return run


def candidates(
    corpus: DataFrame,
    questions: Sequence[Question],
    k: int,
    dense: bool = True,
    sparse: bool = True,
    zero_overlap: bool = True,
    scope: Column | None = None,
) -> DataFrame:
    """Per task, the best ``k`` rows of each question and arm.

    ``scope`` names the tenant column when questions of several tenants share a
    scan; a question then sees rows of its own tenant only.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if not questions:
        raise ValueError("no questions")
    if k < 1:
        raise ValueError("k must be at least 1")
    narrow = corpus.select(
        "id",
        (F.lit(0) if scope is None else scope).alias("scope"),
        *(["embedding"] if dense else []),
        *(["sparse_embedding"] if sparse else []),
    )
    id_field = corpus.schema["id"]
    label = "bigint" if isinstance(questions[0].question_id, int) else "string"
    schema = f"question_id {label}, arm string, id {id_field.dataType.simpleString()}, score double"
    passes = [
        narrow.mapInArrow(
            _scorer(
                questions[at : at + QUESTIONS_PER_PASS],
                k,
                dense,
                sparse,
                zero_overlap,
                to_arrow_type(id_field.dataType),
            ),
            schema,
        )
        for at in range(0, len(questions), QUESTIONS_PER_PASS)
    ]
    return reduce(DataFrame.unionAll, passes)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Merge the tasks' lists: rank by (score, id) and keep ``k`` per question and arm.

    A scan of very many tasks leaves very many short lists, so they are merged in
    ``MERGE_FAN`` parts first and the parts' winners after that.
    """
    best_first = [F.col("score"), F.col("id")]
    part = F.pmod(F.hash("id"), F.lit(MERGE_FAN))
    parts = Window.partitionBy("question_id", "arm", "_part").orderBy(*best_first)
    whole = Window.partitionBy("question_id", "arm").orderBy(*best_first)
    merged = (
        found.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(parts))
        .where(F.col("_rank") <= k)
        .drop("_part", "_rank")
    )
    return merged.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= k)
