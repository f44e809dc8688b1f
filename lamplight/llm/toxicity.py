"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary text, one on what toxic texts say and ordinary
ones do not (their telling words, in the order of the text). The toxic dictionary ends with the ordinary one, so that both
parse common text alike and differ only where a passage repeats what toxic documents say. A text is lower-cased and cut into overlapping windows; each window is compressed with either
dictionary, and the bytes saved by the toxic one are its evidence. The threshold on a window's saving is calibrated on
ordinary training text, and a logistic model turns the evidence of a text's windows into a score.

Training looks at about ``sample`` labelled rows of each class (by a hash of the id), whole texts each. Words are counted and
evidence is gathered by Spark; the driver gets the telling words, what ``zstandard`` is trained on and three numbers a row.
Repeated rows count as often as they occur in the fit, and once in the words' counts. Scoring reads whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lamplight.llm.tables import Scratch, release, sampled, text_of, turn_to

WINDOW, STEP, LEAD = 96, 72, 32
SAMPLE = 4_000
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 4_096
#: Telling words of a training string of the toxic dictionary.
RUN = 4
#: One search for both dictionaries, thorough enough to find what they hold: else the difference is noise.
SEARCH = {
    "strategy": zstandard.STRATEGY_LAZY2, "hash_log": 17, "chain_log": 17, "window_log": 17, "min_match": 4, "search_log": 6,
    "write_content_size": False, "write_checksum": False, "write_dict_id": False,
}
WORD = re.compile(r"[^\W\d_]+")
EVIDENCE = "struct<most:double,hits:double,count:double>"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    saving: int
    weights: tuple[float, ...]

    def score(self, texts) -> np.ndarray:
        evidence = evidence_of(texts, self.ordinary, self.toxic, self.saving)
        return 1 / (1 + np.exp(-np.clip(_features(evidence) @ np.array(self.weights), -30, 30)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    search = zstandard.ZstdCompressionParameters(**SEARCH)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=search)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=search)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=search)


def evidence_of(texts, ordinary: bytes, toxic: bytes, saving: int) -> np.ndarray:
    """Per text: largest saving of a window, number of windows that save ``saving`` or more, number of windows."""
    plain, rude = _compressor(ordinary).compress, _compressor(toxic).compress
    # What both dictionaries end with goes around each window: a block that saves little is else stored as it is, and
    # no match is looked for in a block's last bytes.
    lead = ordinary[-LEAD:]
    out = np.zeros((len(texts), 3))
    for row, text in enumerate(texts):
        data = b" " + (text or "").lower().encode("utf-8", "replace") + b" "
        most = hits = count = 0
        for at in range(0, max(1, len(data) - (WINDOW - STEP)), STEP):
            window = lead + data[at : at + WINDOW] + lead
            saved = len(plain(window)) - len(rude(window))
            count += 1
            if saved > most:
                most = saved
            hits += saved >= saving
        out[row] = most, hits, count
    return out


def _features(evidence: np.ndarray) -> np.ndarray:
    most, hits, count = evidence.T
    return np.stack(
        [np.ones(len(evidence)), np.minimum(most, 12) / 4, np.log1p(hits), np.minimum(1, 10 * hits / np.maximum(count, 1))], 1
    )


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; both classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1]) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def telling(rows: DataFrame) -> list[str]:
    """Words that many more toxic texts use than ordinary ones, by a likelihood-ratio test that allows for the number of
    words tested; the most telling last. ``rows``: doc_id, toxic, text.

    A text counts for a word only if it uses it between two words between which no text of a smaller id does: neither copies
    of a text nor a long text that repeats a word count more than once.
    """
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return []
    words = rows.select("doc_id", "toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w"))
    edge = F.array(F.lit(""))
    around = F.arrays_zip(F.concat(edge, "w").alias("before"), F.col("w").alias("word"), F.concat(F.slice("w", 2, 1 << 30), edge).alias("after"))
    uses = words.select("doc_id", "toxic", F.explode(around).alias("u")).select("doc_id", "toxic", "u.*").filter("word is not null")
    first = uses.groupBy("toxic", "before", "word", "after").agg(F.min("doc_id").alias("doc_id"))
    once = first.select("toxic", "word", "doc_id").distinct()
    counts = once.groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    scratch = Scratch(rows.sparkSession, "telling")
    tested = scratch.keep(counts.filter((F.col("a") > 1) & (F.col("a") * m > F.col("b") * n)))
    bar = 2 * float(np.log(tested.count() + 1)) + 4
    rate = (F.col("a") + F.col("b")) / (n + m)

    def part(k: Column, of: int) -> Column:
        share = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
        return share(k, of * rate) + share(of - k, of * (1 - rate))

    g = F.when(rate < 1, 2 * (part(F.col("a"), n) + part(F.col("b"), m))).otherwise(0.0)
    found = tested.withColumn("g", g).filter((F.col("g") >= bar) & (F.col("a") * m >= 4 * F.col("b") * n)).select("g", "word").collect()
    scratch.drop(tested)
    return [r.word for r in sorted(found, key=lambda r: (r.g, r.word))]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary by zstandard; where there is too little text to train on, the text's last bytes serve."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def runs_of(texts, words: set[str]) -> list[bytes]:
    """What the toxic dictionary is trained on: of each text the telling words in order, ``RUN`` to a string."""
    out = []
    for text in texts:
        said = [f" {w} " for w in WORD.findall((text or "").lower()) if w in words]
        out += ["".join(said[i : i + RUN]).encode() for i in range(0, len(said), RUN)]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic and whole text of about ``sample`` labelled rows of each class (by a hash of the id).

    ``labels``: doc_id, toxic. Rows with a null in either are passed over; an id labelled twice counts once.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for kind in (1, 0):
        part = sampled(known.filter(F.col("toxic") == kind), sample, "doc_id")
        ids = part if ids is None else ids.unionByName(part)
    # The broadcast side has about two samples of rows.
    return docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")


def _evidence(ordinary: bytes, toxic: bytes, saving: int) -> Column:
    @pandas_udf(EVIDENCE)
    def gathered(texts: pd.Series) -> pd.DataFrame:
        turn_to()
        return pd.DataFrame(evidence_of(texts.tolist(), ordinary, toxic, saving), columns=["most", "hits", "count"])

    return gathered("text")


def train_on(rows: DataFrame) -> Model:
    """A model from doc_id, toxic (0 or 1) and text. With one class missing or nothing telling, scores are near 0.5 or
    below it."""
    scratch = Scratch(rows.sparkSession, "toxicity")
    rows = scratch.keep(rows)
    words = set(telling(rows))

    @pandas_udf("array<binary>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([[t.lower().encode("utf-8", "replace")[i : i + 400] for i in range(0, len(t), 400)] for t in texts])

    @pandas_udf("array<binary>")
    def said(texts: pd.Series) -> pd.Series:
        return pd.Series([runs_of([t], words) for t in texts])

    def strings(kind: int, column: Column) -> list[bytes]:
        chosen = rows.filter(F.col("toxic") == kind).select("doc_id", column.alias("s")).collect()
        return [bytes(s) for r in sorted(chosen, key=lambda r: (r.doc_id, r.s)) for s in r.s]

    common = _trained(ORDINARY_BYTES, [s for s in strings(0, pieces("text")) if len(s) >= 16])
    rude = _trained(TOXIC_BYTES, strings(1, said("text"))) if words else b""
    toxic = rude + common

    def gathered(saving: int) -> tuple[np.ndarray, np.ndarray]:
        found = rows.select("toxic", _evidence(common, toxic, saving).alias("e")).select("toxic", "e.*").toPandas()
        return found[["most", "hits", "count"]].to_numpy(float), found["toxic"].to_numpy(float)

    evidence, y = gathered(1)
    if not y.sum() or y.all():
        scratch.drop(rows)
        return Model(common, common, 1, (-0.01, 0.0, 0.0, 0.0))
    saving = max(1, int(np.quantile(evidence[y == 0, 0], 0.99)) + 1)
    evidence, y = gathered(saving)
    scratch.drop(rows)
    order = np.lexsort((*evidence.T, y))  # the fit is the same on every run
    return Model(common, toxic, saving, tuple(float(w) for w in _fit(_features(evidence[order]), y[order])))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return train_on(training_rows(docs, labels, sample))


def score(model: Model, text: str | Column = "text") -> Column:
    """The score of each text, 0 to 1. Null and empty texts carry no evidence and get the model's base score."""
    shared = model

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        turn_to()
        scores = pd.Series(shared.score(texts.tolist()))
        release()
        return scores

    return scored(text_of(text))


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 5 == 0, F.lit(False))
