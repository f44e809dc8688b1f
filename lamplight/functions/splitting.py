"""Splitting of long texts and packing of blocks into chunks.

Both are folds over one document, so they run inside one input row: the document
arrives as one row, its blocks as an array, and leaves as an array of chunks. No
shuffle, and no group larger than the document Spark already read as one row.

The splitter follows the published description of recursive character splitting:
cut at the coarsest separator that occurs, keep each separator at the head of the
piece it opens, recurse into pieces that are still too long, and merge neighbours
up to the limit with a trailing overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from lamplight import schemas
from lamplight.functions.memory import in_pieces
from lamplight.functions.text import HEADING_JOIN
from lamplight.settings import DEFAULTS

# Separators from paragraph to character, Latin and Arabic.
SEPARATORS = ("\n\n", "\n", ". ", "؟ ", "۔ ", "! ", "? ", "؛ ", "; ", " ", "")

# Blocks that are never cut or merged.
ATOMIC = frozenset({"table", "figure", "formula"})


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    """Positions in [start, end) where a piece begins, ``start`` included."""
    points = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        if at > start:
            points.append(at)
        at = text.find(separator, at + len(separator), end)
    return points


def _windows(bounds: list[int], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Merge adjacent pieces into spans of at most ``limit`` characters.

    ``bounds`` holds the piece edges in order. After a span is emitted, leading
    pieces go until the rest is no longer than ``overlap`` and the next piece fits.
    """
    first = 0
    for nxt in range(len(bounds) - 1):
        edge = bounds[nxt + 1]
        if edge - bounds[first] > limit and nxt > first:
            yield bounds[first], bounds[nxt]
            while first < nxt and (
                bounds[nxt] - bounds[first] > overlap or edge - bounds[first] > limit
            ):
                first += 1
    if len(bounds) > 1:
        yield bounds[first], bounds[-1]


def _spans(
    text: str, start: int, end: int, level: int, limit: int, overlap: int
) -> Iterator[tuple[int, int]]:
    while level < len(SEPARATORS) - 1 and text.find(SEPARATORS[level], start, end) < 0:
        level += 1
    separator = SEPARATORS[level]
    edges = list(range(start, end)) if separator == "" else _cuts(text, start, end, separator)
    edges.append(end)
    run = [start]
    for left, right in zip(edges, edges[1:]):
        if right - left < limit:
            run.append(right)
            continue
        yield from _windows(run, limit, overlap)
        if level + 1 < len(SEPARATORS):
            yield from _spans(text, left, right, level + 1, limit, overlap)
        else:
            yield left, right
        run = [right]
    yield from _windows(run, limit, overlap)


def split_long_text(
    text: str, limit: int = DEFAULTS.chunk_chars, overlap: int = DEFAULTS.chunk_overlap
) -> list[str]:
    pieces = (text[a:b].strip() for a, b in _spans(text, 0, len(text), 0, limit, overlap))
    return [p for p in pieces if p]


def split_text(text: str | None) -> list[str]:
    body = (text or "").strip()
    return split_long_text(body) if body else []


def _split(texts: pa.Array) -> pa.Array:
    return pa.array((split_text(t) for t in texts.to_pylist()), type=pa.list_(pa.string()))


def split(text: Column) -> Column:
    """Chunk strings of one plain text, as an array."""
    return F.arrow_udf(_split, "array<string>")(text)


class _Packer:
    """Walks the blocks of one document in reading order and collects chunks."""

    def __init__(self, limit: int):
        self.limit = limit
        self.out: list[dict] = []
        self.title = ""
        self.open: dict | None = None

    def _chunk(self, block, text: str, piece: int | None = None) -> dict:
        cites = [] if block["bbox"] is None else [_citation(block)]
        return {
            "content": text,
            "block_types": [block["type"]],
            "section_title": self.title,
            "page_number": block["page_number"],
            "bboxes": cites,
            "piece": piece,
        }

    def close(self) -> None:
        if self.open is not None:
            self.out.append(self.open)
            self.open = None

    def heading(self, block, text: str) -> None:
        waiting = self.open is not None and self.open["block_types"] == ["heading"]
        if waiting:
            text = self.open["content"] + HEADING_JOIN + text
        self.title = text
        if waiting:
            self.open["content"] = text
            self.open["section_title"] = self.title
            if block["bbox"] is not None:
                self.open["bboxes"].append(_citation(block))
        else:
            self.close()
            self.open = self._chunk(block, text)

    def body(self, block, text: str) -> None:
        if len(text) > self.limit:
            self.close()
            pieces = split_long_text(text, self.limit)
            self.out.extend(self._chunk(block, part, n) for n, part in enumerate(pieces))
            return
        room = self.open is not None and len(self.open["content"]) + 2 + len(text) <= self.limit
        if not room:
            self.close()
            self.open = self._chunk(block, text)
            return
        self.open["content"] += "\n\n" + text
        self.open["block_types"].append(block["type"])
        if block["bbox"] is not None:
            self.open["bboxes"].append(_citation(block))
        if self.open["page_number"] is None:
            self.open["page_number"] = block["page_number"]

    def take(self, block) -> None:
        text = (block["content"] or "").strip()
        if not text:
            return
        if block["type"] in ATOMIC:
            self.close()
            self.out.append(self._chunk(block, text))
        elif block["type"] == "heading":
            self.heading(block, text)
        else:
            self.body(block, text)


def _citation(block) -> dict:
    b = block["bbox"]
    return {"page": block["page_number"], "bbox": [b["x_min"], b["y_min"], b["x_max"], b["y_max"]]}


def pack_document(blocks, limit: int = DEFAULTS.chunk_chars) -> list[dict]:
    """Chunks of one document, in order."""
    packer = _Packer(limit)
    rows = [dict(b, type=b["type"] or "text") for b in (() if blocks is None else blocks)]
    for block in sorted(rows, key=lambda b: int(b["reading_order"] or 0)):
        packer.take(block)
    packer.close()
    return packer.out


_CITATIONS = pa.list_(pa.struct([("page", pa.int32()), ("bbox", pa.list_(pa.float64()))]))

_PACKED = pa.list_(
    pa.struct(
        [
            ("content", pa.string()),
            ("block_types", pa.list_(pa.string())),
            ("section_title", pa.string()),
            ("page_number", pa.int32()),
            ("bboxes", _CITATIONS),
            ("piece", pa.int32()),
        ]
    )
)


def _pack(blocks: pa.Array) -> pa.Array:
    return pa.array([pack_document(b.as_py()) for b in blocks], type=_PACKED)


def pack(blocks: Column) -> Column:
    """Array of blocks to array of packed chunks."""

    def rows(blocks: pa.Array) -> pa.Array:
        return in_pieces(_pack, blocks)

    rows.__name__ = _pack.__name__  # as plans show it
    return F.arrow_udf(rows, f"array<{schemas.PACKED}>")(blocks)
