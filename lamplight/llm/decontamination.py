"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every text is cut into overlapping passages of words, long enough that a copied item lies whole in one of them. A passage
queries the index: impacts are scaled by each entry's score against itself, so that one threshold holds for all, and WAND
with the maxima of blocks of postings skips entries that cannot reach it. The entries of an item are its whole, its question
and its answer (its last sentence), the latter two where they have ``LEAST`` shingles. All entries above the threshold are
then verified on five-word shingles: an item is found where a passage holds ``SIMILARITY`` of an entry's own, so a document
that has only the question or only the answer is found too.

The index is broadcast. Its size is bounded: items beyond ``PART_BYTES`` of text are indexed in further parts, each of which
all texts meet.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lamplight.llm.tables import release, text_of, turn_to

WORDS = 5
SIMILARITY = 0.8
#: Shingles that a question or an answer needs to tell by itself; shorter ones could be met by chance.
LEAST = 8
THRESHOLD = 0.5
BLOCK = 16
K1, B = 1.2, 0.75
PART_BYTES = 16 << 20

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

FOUND = "array<struct<item:int,score:double,question:double,answer:double>>"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(tokens: list[str], width: int = WORDS) -> set[tuple[str, ...]]:
    """All runs of ``width`` words; of fewer words the whole, of none nothing."""
    if not tokens:
        return set()
    return {tuple(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))}


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence of at least ``WORDS`` words answers; a lone one is halved."""
    sentences = _SENTENCE.split(text.strip())
    for cut in range(len(sentences) - 1, 0, -1):
        answer = " ".join(sentences[cut:])
        if len(words(answer)) >= WORDS:
            return " ".join(sentences[:cut]), answer
    half = text.split()
    return " ".join(half[: len(half) // 2]), " ".join(half[len(half) // 2 :])


@dataclass
class Index:
    """``postings``: of a term the entries by number, their impacts, and the ends and maxima of its blocks. ``owner``: the
    item of an entry. Document frequencies and the mean length are those of the items."""

    texts: list[str]
    threshold: float = THRESHOLD
    postings: dict[str, tuple] = field(default_factory=dict)

    def __post_init__(self):
        tokens = [words(t) for t in self.texts]
        n, mean = len(tokens), sum(map(len, tokens)) / max(1, len(tokens)) or 1.0
        spread = Counter(w for t in tokens for w in set(t))
        self.longest = max(map(len, tokens), default=0)
        self.shingles = [tuple(map(shingles, (t, *map(words, parts(text))))) for t, text in zip(tokens, self.texts)]
        self.owner = list(range(n))
        self.own = [whole for whole, _, _ in self.shingles]
        for item, text in enumerate(self.texts):
            for part, held in zip(parts(text), self.shingles[item][1:]):
                if len(held) >= LEAST:
                    tokens.append(words(part))
                    self.owner.append(item)
                    self.own.append(held)
        idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in spread.items()}
        impacts: dict[str, list] = {}
        for item, own in enumerate(tokens):
            counts = Counter(own)
            weigh = {w: idf[w] * k * (K1 + 1) / (k + K1 * (1 - B + B * len(own) / mean)) for w, k in counts.items()}
            whole = sum(weigh.values())
            for w, x in weigh.items():
                impacts.setdefault(w, []).append((item, x / whole))
        for w, rows in impacts.items():
            cut = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            self.postings[w] = (
                [i for i, _ in rows], [x for _, x in rows], [c[-1][0] for c in cut], [max(x for _, x in c) for c in cut],
                max(x for _, x in rows),
            )
        # Of each entry the commonest terms, as far as they lift it to half of the threshold, are left to the search: a
        # passage that reaches the threshold has the other half from the entry's remaining terms.
        self.need = np.full(len(tokens), self.threshold)
        kept: dict[str, list[int]] = {}
        for item, own in enumerate(tokens):
            lifted = 0.0
            for w in sorted(set(own), key=lambda w: (-spread[w], len(w), w)):
                at = bisect_left(self.postings[w][0], item)
                lifted += self.postings[w][1][at]
                if lifted <= self.threshold / 2:
                    self.need[item] = self.threshold - lifted
                else:
                    kept.setdefault(w, []).append(at)
        self.term = {w: i for i, w in enumerate(sorted(kept))}
        rows = [[self.postings[w][c][at] for at in kept[w]] for c in (0, 1) for w in self.term]
        items, weights = rows[: len(kept)], rows[len(kept) :]
        self.first = np.r_[0, np.cumsum([len(r) for r in items])].astype(np.int64)
        self.item = np.array([x for r in items for x in r], np.int64)
        self.weight = np.array([x for r in weights for x in r], float)

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """All entries whose scaled score reaches the threshold: WAND with block maxima."""
        lists = [[0, *self.postings[w]] for w in sorted(terms) if w in self.postings]
        found = []
        while lists:
            lists.sort(key=lambda c: c[1][c[0]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(lists):
                bound += c[5]
                if bound >= self.threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            near, last = 0.0, math.inf
            for c in lists[: pivot + 1]:
                block = bisect_left(c[3], item)
                if block < len(c[3]):
                    near += c[4][block]
                    last = min(last, c[3][block])
            if near < self.threshold - 1e-9:
                # No item up to the first end of these blocks can reach it; beyond, the next list may join.
                after = last + 1
                if pivot + 1 < len(lists):
                    after = min(after, lists[pivot + 1][1][lists[pivot + 1][0]])
                after = max(after, item + 1)
                moved = lists[: pivot + 1]
            elif lists[0][1][lists[0][0]] == item:
                score = sum(c[2][c[0]] for c in lists[: pivot + 1])
                if score >= self.threshold - 1e-9:
                    found.append((item, score))
                after, moved = item + 1, lists[: pivot + 1]
            else:
                after, moved = item, [c for c in lists[:pivot] if c[1][c[0]] < item]
            for c in moved:
                c[0] = bisect_left(c[1], after, c[0])
            lists = [c for c in lists if c[0] < len(c[1])]
        return found

    def passages(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Spans of the overlapping passages in which some entry may reach the threshold by its less common terms.

        A passage is two neighbouring stretches, each as long as the longest item.
        """
        get, step = self.term.get, max(1, self.longest)
        terms = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return []
        width, n = len(self.term), len(self.need)
        hits = np.unique(at // step * width + terms[at])
        stretch, term = hits // width, hits % width
        size = self.first[term + 1] - self.first[term]
        start = np.repeat(self.first[term] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        item, weight, stretch = self.item[start], self.weight[start], np.repeat(stretch, size)
        # Stretch s belongs to the passages s - 1 and s.
        key = np.r_[stretch * n + item, (stretch - 1) * n + item]
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sums = np.add.reduceat(np.r_[weight, weight][order], cut)
        reached = np.unique(np.maximum(key[cut][sums >= self.need[key[cut] % n] - 1e-9] // n, 0))
        return [(int(s) * step, min(len(tokens), int(s + 2) * step)) for s in reached]

    def verify(self, entry: int, held: set) -> tuple[bool, float, float]:
        """Whether the entry is there, and the shares of its item's question and answer that are."""
        share = lambda own: len(own & held) / len(own) if own else 1.0
        _, question, answer = self.shingles[self.owner[entry]]
        own = self.own[entry]
        return bool(own) and share(own) >= SIMILARITY, share(question), share(answer)

    def items_in(self, text: str) -> list[dict]:
        """The items that a text holds, each with its best score and the shares of question and answer in that passage."""
        tokens = words(text)
        best: dict[int, dict] = {}
        for start, end in self.passages(tokens):
            own = tokens[start:end]
            hits = self.search(set(own))
            held = None
            for entry, score in hits:
                item = self.owner[entry]
                width = len(next(iter(self.own[entry]), ()))
                if width < WORDS:  # an item of fewer words is one shingle of its own width
                    present = shingles(own, width)
                else:
                    held = present = shingles(own) if held is None else held
                there, question, answer = self.verify(entry, present)
                if there and (item not in best or best[item]["score"] < score):
                    best[item] = {"item": item, "score": score, "question": question, "answer": answer}
        return [best[i] for i in sorted(best)]


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[tuple[list, Index]]:
    """The items in parts of at most ``PART_BYTES`` of text each (at least one item), with their ids.

    Null, empty and wordless items can't be found and are passed over; repeated rows count once.
    """
    rows = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter("text is not null").distinct()
    out, ids, texts, size = [], [], [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        if not words(row.text):
            continue
        if texts and size + len(row.text) > PART_BYTES:
            out.append((ids, Index(texts)))
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += len(row.text)
    if texts:
        out.append((ids, Index(texts)))
    return out


def _searcher(index: Index):
    shared = index

    @pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.Series:
        turn_to()
        hits = pd.Series([shared.items_in(t) for t in texts])
        release()
        return hits

    return found


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) for each item that a document holds, best passage each.

    Null and empty texts hold none; repeated documents give repeated rows; an empty table on either side gives no row.
    """
    out = None
    for ids, index in indexes(benchmark):
        names = F.array(*[F.lit(i) for i in ids])
        hits = docs.select(F.col(id), F.explode(_searcher(index)(text_of(text))).alias("hit"))
        part = hits.select(
            F.col(id), F.get(names, "hit.item").alias("item_id"), F.col("hit.score").alias("score"),
            F.col("hit.question").alias("question_overlap"), F.col("hit.answer").alias("answer_overlap"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = benchmark.schema["item_id"].dataType
        none = [F.lit(None).cast(kind).alias("item_id")]
        none += [F.lit(None).cast("double").alias(c) for c in ("score", "question_overlap", "answer_overlap")]
        return docs.select(F.col(id), *none).limit(0)
    return out


def is_clean(benchmark: DataFrame, text: str | Column = "text") -> Column:
    """Whether a text holds no item of the benchmark."""
    clean = F.lit(True)
    for _, index in indexes(benchmark):
        clean = clean & (F.size(_searcher(index)(text_of(text))) == 0)
    return clean
