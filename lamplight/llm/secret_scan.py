"""Secrets: fixed patterns, and random-looking strings told from identifiers by two character Markov models.

One model is trained on strings labelled random (what the fixed patterns caught, and strings drawn from the alphabets of
keys by a seeded generator, half of the weight each), the other on ordinary words and identifiers: all words of all
documents outside of what was caught. Spark adds up the pairs of characters. A token is random where its mean log-likelihood
ratio per character reaches a bar set from those of all ordinary words, the higher the shorter the token. Offsets are code points, the end exclusive. Matches of a pattern are leftmost
and do not overlap within a kind; a match that is too short is dropped and not tried again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lamplight.llm.tables import text_of

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run of the class, as the plain form finds it
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
BREAK = re.compile(r"[^A-Za-z0-9+/_=-]")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CODE = {c: i for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET)
#: Code of a byte, -1 outside the alphabet; the stop belongs to the alphabet but ends a word.
CODES = np.full(256, -1, np.int16)
CODES[list(ALPHABET.encode())] = np.arange(SIZE)
STOP = CODE["."]
DRAWN = 2_000
#: Words of this many characters and more set the bar, all but this share of them below it.
LONG, BELOW = 8, 0.999
#: Deviations of ordinary words' means that a token of ``LONG`` characters must lie above their mean.
AWAY = 6.0
#: Means of words are counted in bins of this width.
BINS, LOW, HIGH = 4096, -16.0, 16.0
#: Characters looked at together, up to the next end of a word.
STRETCH = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the fixed patterns, by start and then kind."""
    spans = []
    if HINT.search(text):
        spans += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans)


@dataclass(frozen=True)
class Model:
    """ratio[a, b]: log-likelihood ratio, random over ordinary, of character b after a; bar: what a token's mean needs;
    low, spread: mean and deviation of ordinary words' means."""

    ratio: np.ndarray
    bar: float
    low: float = 0.0
    spread: float = 0.0

    def ratios(self, token: str) -> np.ndarray:
        codes = CODES[np.frombuffer(token.encode("ascii"), np.uint8)]
        return self.ratio[codes[:-1], codes[1:]]

    def mean(self, token: str) -> float:
        found = self.ratios(token)
        return float(found.mean()) if len(found) else 0.0

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        """The fixed patterns' spans, and random-looking tokens that touch none of them."""
        found = base_spans(text)
        extra, at = [], 0
        reach = np.maximum.accumulate([e for _, _, e, _ in found]) if found else []
        for m in CANDIDATE.finditer(text):
            while at < len(found) and found[at][0] < m.end():
                at += 1
            if at and reach[at - 1] > m.start():
                continue
            # A mean of n characters scatters as one over the root of n.
            away = AWAY * self.spread * (LONG / (m.end() - m.start())) ** 0.5
            if self.mean(m[0]) >= max(self.bar, self.low + away):
                extra.append((m.start(), 3, m.end(), "random"))
        return sorted(found + extra)


def split(text: str) -> tuple[list[str], str]:
    """What the fixed patterns caught, and the text without it."""
    spans = base_spans(text)
    if not spans:
        return [], text
    caught = [ASSIGN.match(text, s)[2] if kind == "assign" else text[s:e] for s, _, e, kind in spans]
    rest, at = [], 0
    for s, _, e, _ in spans:
        rest.append(text[at:s])
        at = max(at, e)
    return caught, " ".join([*rest, text[at:]])


def _words(text: str):
    """Codes, and start and end of each word in them, of stretches of the text that end where a word does."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        codes = CODES[np.frombuffer(text[at:end].encode("utf-8", "replace"), np.uint8)]
        inside = np.concatenate(([0], (codes >= 0) & (codes != STOP), [0]))
        turns = np.flatnonzero(np.diff(inside))
        yield codes, turns[::2], turns[1::2]
        at = end


def pairs(text: str) -> np.ndarray:
    """How often each character of the alphabet follows each other within words; row by row."""
    counts = np.zeros(SIZE * SIZE, np.int64)
    for codes, _, _ in _words(text):
        both = (codes[:-1] >= 0) & (codes[1:] >= 0) & (codes[:-1] != STOP) & (codes[1:] != STOP)
        counts += np.bincount(codes[:-1][both].astype(np.int64) * SIZE + codes[1:][both], minlength=SIZE * SIZE)
    return counts


def means(text: str, ratio: np.ndarray) -> np.ndarray:
    """Mean ratio of each word of ``LONG`` and more characters, counted in bins."""
    counts = np.zeros(BINS, np.int64)
    for codes, starts, ends in _words(text):
        long = ends - starts >= LONG
        starts, ends = starts[long], ends[long]
        if len(starts):
            sums = np.concatenate(([0.0], np.cumsum(ratio[codes[:-1], codes[1:]])))
            found = (sums[ends - 1] - sums[starts]) / (ends - starts - 1)
            bins = np.clip((found - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
            counts += np.bincount(bins, minlength=BINS)
    return counts


def drawn(seed: int = 7) -> list[str]:
    """Strings labelled random: drawn from the alphabets of keys."""
    rng = np.random.default_rng(seed)
    alphabets = (ALPHABET[:64], ALPHABET[:62], ALPHABET[26:36] + ALPHABET[52:62], ALPHABET[:26] + ALPHABET[52:62])
    return ["".join(rng.choice(list(alphabets[i % 4]), 32)) for i in range(DRAWN)]


def _log_shares(counts: np.ndarray) -> np.ndarray:
    counts = counts.reshape(SIZE, SIZE) + 0.5
    return np.log(counts / counts.sum(1, keepdims=True))


def ratios(caught: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios from the pairs of what was caught and of ordinary words."""
    random = pairs(" ".join(drawn())).astype(float)
    if caught.sum():
        random += caught * (random.sum() / caught.sum())
    return _log_shares(random) - _log_shares(ordinary)


def calibrated(ratio: np.ndarray, ordinary: np.ndarray) -> Model:
    """The bar lies halfway between the mean of drawn strings and that of ordinary words, and above all but a share of
    these. ``ordinary``: the words' means in bins."""
    model = Model(ratio, 0.0)
    high = np.mean([model.mean(s) for s in drawn()])
    edges = LOW + (HIGH - LOW) * np.arange(1, BINS + 1) / BINS
    total = ordinary.sum()
    low = float((ordinary * edges).sum() / total) if total else 0.0
    spread = float(((ordinary * (edges - low) ** 2).sum() / total) ** 0.5) if total else 0.0
    most = edges[np.searchsorted(np.cumsum(ordinary), BELOW * total)] if total else 0.0
    return Model(ratio, float(max((high + low) / 2, most)), low, spread)


def _added(docs: DataFrame, count, size: int) -> np.ndarray:
    """Sum of ``count(text)``, an array of ``size`` numbers, over all texts: a task adds its own, Spark the rest. What is
    collected has ``size`` rows at most."""

    def tasks(frames):
        total = np.zeros(size, np.int64)
        for frame in frames:
            for text in frame["text"]:
                total += count(text)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    rows = docs.select(text_of("text").alias("text")).mapInPandas(tasks, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(size, np.int64)
    for row in rows.collect():
        total[row.cell] = row.n
    return total


def train(docs: DataFrame) -> Model:
    """A model from all documents, whole texts each; null texts count as empty, repeated rows as often as they occur. Columns
    other than ``text`` are not read."""

    def both(text: str) -> np.ndarray:
        caught, rest = split(text)
        return np.concatenate([pairs(" ".join(caught)), pairs(rest)])

    found = _added(docs, both, 2 * SIZE * SIZE)
    ratio = ratios(found[: SIZE * SIZE], found[SIZE * SIZE :])
    return calibrated(ratio, _added(docs, lambda text: means(split(text)[1], ratio), BINS))


def find(model: Model, text: str | Column = "text") -> Column:
    """Array of (start, rank, end, kind) by start and then kind as listed in ``KINDS``; none for null and empty texts."""
    shared = model

    @pandas_udf("array<struct<start:int,rank:int,end:int,kind:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        names = ("start", "rank", "end", "kind")
        return pd.Series([[dict(zip(names, s)) for s in shared.spans(t)] for t in texts])

    return spans(text_of(text))
