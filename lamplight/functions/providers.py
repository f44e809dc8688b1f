"""Model stages as column expressions.

A provider turns columns into a column, so a model-backed one wraps an iterator
pandas UDF that loads its weights once per worker, and the built-in stand-ins are
deterministic and need no weights. Plans take providers as arguments and never
know which kind they got.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from lamplight.functions.memory import in_pieces
from lamplight.settings import DEFAULTS


class Embedder(Protocol):
    """Dense and sparse vectors of a text."""

    name: str
    dimension: int
    sparse_dimension: int

    def dense(self, text: Column) -> Column: ...

    def sparse(self, text: Column) -> Column: ...


class Reranker(Protocol):
    """Raw relevance logit of a (question, passage) pair."""

    def logit(self, question: Column, passage: Column) -> Column: ...


class LineReader(Protocol):
    """Recognised lines of an image: array<struct<text, score>>. A null image must cost no model call."""

    def lines(self, image: Column) -> Column: ...


class Captioner(Protocol):
    """One-sentence caption of an image, '' when there is none. A null image must cost no model call."""

    def caption(self, image: Column) -> Column: ...


class FormulaReader(Protocol):
    """LaTeX of an image, '' when there is none. A null image must cost no model call."""

    def latex(self, image: Column) -> Column: ...


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def token_id(word: str, dimension: int = DEFAULTS.embed_sparse_dim) -> int:
    """Stand-in vocabulary: eight hex digits of the digest, folded to the dimension."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension


def _token_cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row number and word code of every word in a batch, and the words themselves."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(lower, pattern=r"[^\p{L}\p{N}]+")
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().dictionary_encode()
    codes, vocabulary = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    real = np.array([w != "" for w in vocabulary], dtype=bool)
    if len(codes):
        rows, codes = rows[real[codes]], codes[real[codes]]
    return rows, codes, vocabulary


def _sparse_rows(texts: pa.Array, dimension: int) -> pa.Array:
    rows, codes, vocabulary = _token_cells(texts)
    tokens = np.array([token_id(w, dimension) for w in vocabulary], dtype=np.int64)
    cells = rows * dimension + (tokens[codes] if len(codes) else codes)
    cells, counts = np.unique(cells, return_counts=True)
    offsets = np.searchsorted(cells, np.arange(len(texts) + 1) * dimension)
    return pa.MapArray.from_arrays(
        pa.array(offsets, type=pa.int32()),
        pa.array(cells % dimension, type=pa.int32()),
        pa.array(counts, type=pa.float32()),
    )


def _dense_rows(texts: pa.Array, dimension: int) -> pa.Array:
    """Signed feature hashing of the words, scaled to unit length."""
    rows, codes, vocabulary = _token_cells(texts)
    digests = [hashlib.md5(w.encode()).digest() for w in vocabulary]
    slot = np.array([int.from_bytes(d[:4], "big") % dimension for d in digests], dtype=np.int64)
    sign = np.array([1.0 if d[4] & 1 else -1.0 for d in digests])
    size = len(texts) * dimension
    if len(codes):
        matrix = np.bincount(rows * dimension + slot[codes], weights=sign[codes], minlength=size)
    else:
        matrix = np.zeros(size)
    matrix = matrix.reshape(len(texts), dimension)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, length, out=matrix, where=length > 0).astype(np.float32)
    bounds = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimension)
    return pa.ListArray.from_arrays(bounds, pa.array(matrix.ravel()))


@dataclass(frozen=True)
class LexicalEmbedder:
    """Term counts as sparse weights and hashed words as a dense vector."""

    name: str = "lexical"
    dimension: int = 64
    sparse_dimension: int = DEFAULTS.embed_sparse_dim

    def sparse(self, text: Column) -> Column:
        dimension = self.sparse_dimension

        def rows(texts: pa.Array) -> pa.Array:
            return in_pieces(lambda part: _sparse_rows(part, dimension), texts)

        return F.arrow_udf(rows, "map<int,float>")(text)

    def dense(self, text: Column) -> Column:
        dimension = self.dimension

        def rows(texts: pa.Array) -> pa.Array:
            return in_pieces(lambda part: _dense_rows(part, dimension), texts)

        return F.arrow_udf(rows, "array<float>")(text)


@dataclass(frozen=True)
class OverlapReranker:
    """Share of the question's distinct words found in the passage, as a logit."""

    scale: float = 4.0

    def logit(self, question: Column, passage: Column) -> Column:
        asked = F.array_distinct(words(question))
        found = F.size(F.array_intersect(asked, words(passage)))
        share = found / F.greatest(F.size(asked), F.lit(1))
        return self.scale * (share - 0.5)


@dataclass(frozen=True)
class NoLines:
    def lines(self, image: Column) -> Column:
        return F.lit(None).cast("array<struct<text: string, score: double>>")


@dataclass(frozen=True)
class NoCaption:
    def caption(self, image: Column) -> Column:
        return F.lit("")


@dataclass(frozen=True)
class NoFormula:
    def latex(self, image: Column) -> Column:
        return F.lit("")


def recognised_text(lines: Column, min_score: float = DEFAULTS.ocr_min_confidence) -> Column:
    """Confident, non-blank lines joined by newlines; '' when none is left."""
    from lamplight.functions.text import has_text, strip

    kept = F.filter(
        lines, lambda x: (F.coalesce(x["score"], F.lit(0.0)) >= min_score) & has_text(x["text"])
    )
    return F.coalesce(F.array_join(F.transform(kept, lambda x: strip(x["text"])), "\n"), F.lit(""))


def _crop_spread(
    rgb: pa.Array, width: pa.Array, height: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array
) -> pa.Array:
    out = []
    columns = [c.to_pylist() for c in (width, height, x0, y0, x1, y1)]
    for pixels, w, h, a, b, c, d in zip(rgb, *columns):
        raw = pixels.as_py()
        if raw is None or None in (w, h, a, b, c, d) or c <= a or d <= b or len(raw) < w * h * 3:
            out.append(None)
            continue
        image = np.frombuffer(raw, dtype=np.uint8, count=w * h * 3).reshape(h, w, 3)
        out.append(float(image[b:d, a:c].std()))
    return pa.array(out, type=pa.float64())


def crop_stddev(rgb: Column, width: Column, height: Column, crop: Column) -> Column:
    """Standard deviation of the pixels in a crop of a raw RGB image."""
    udf = F.arrow_udf(_crop_spread, "double")
    return udf(rgb, width, height, crop["x_min"], crop["y_min"], crop["x_max"], crop["y_max"])
