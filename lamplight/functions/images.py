"""PNG page images: decoded in Arrow batches, measured where they lie."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# The signature, channels of each colour type, first row and column and steps of the seven interlace passes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]

#: An image of more pixels is refused, so that a small file cannot unpack beyond a worker's memory.
MOST_PIXELS = 1 << 27

SPREAD = "struct<width:int,height:int,spread:double,fault:string>"


def unfilter(raw: bytes, stride: int, step: int) -> np.ndarray:
    """Rows of ``stride`` bytes, each behind the byte that names its filter; ``step``: bytes from a pixel to the next."""
    rows = np.frombuffer(raw, np.uint8)
    rows = rows[: len(rows) // (stride + 1) * (stride + 1)].reshape(-1, stride + 1)
    out = np.zeros((len(rows) + 1, stride), np.uint8)
    lanes = -(-stride // step)
    for y, row in enumerate(rows):
        kind, line, above, made = row[0], row[1:], out[y], out[y + 1]
        if kind == 0:
            made[:] = line
        elif kind == 1:
            lane = np.zeros(lanes * step, np.uint8)
            lane[:stride] = line
            made[:] = np.cumsum(lane.reshape(lanes, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            np.add(line, above, out=made)
        elif kind in (3, 4):
            values, up = line.tolist(), above.tolist()
            for i in range(stride):
                left = values[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + up[i]) >> 1
                else:
                    corner = up[i - step] if i >= step else 0
                    near = [abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)]
                    guess = (left, up[i], corner)[near.index(min(near))]
                values[i] = (values[i] + guess) & 255
            made[:] = values
        else:
            raise ValueError(f"filter {kind}")
    return out[1:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Rows of bytes as (height, width, channels) of whole samples."""
    if depth == 16:
        wide = rows.reshape(len(rows), -1, 2).astype(np.uint16)
        flat = wide[..., 0] << 8 | wide[..., 1]
    elif depth == 8:
        flat = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        flat = bits @ (1 << np.arange(depth - 1, -1, -1))
    return flat[:, : width * channels].reshape(len(rows), width, channels)


def decode(png: bytes) -> np.ndarray:
    """(height, width, 3) bytes of red, green and blue; alpha is left out. A damaged file is a ValueError."""
    if not png.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, parts, palette, head, ended = len(SIGNATURE), [], None, None, False
    while at + 12 <= len(png) and not ended:
        (size,), name = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if len(png) < at + 12 + size or zlib.crc32(name + body) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("chunk damaged")
        if name == b"IHDR":
            if size != 13:
                raise ValueError("header damaged")
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
        ended = name == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("file cut short")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("header out of range")
    channels = CHANNELS[colour]
    layout = [p for p in PASSES if p[0] < height and p[1] < width] if interlaced else [(0, 0, 1, 1)]
    cells = [(-(-(height - y) // dy), -(-(width - x) // dx)) for y, x, dy, dx in layout]
    strides = [(w * channels * depth + 7) // 8 for _, w in cells]
    wanted = sum(h * (s + 1) for (h, _), s in zip(cells, strides))
    try:
        raw = zlib.decompressobj().decompress(b"".join(parts), wanted)
    except zlib.error as error:
        raise ValueError("data damaged") from error
    if len(raw) < wanted:
        raise ValueError("data cut short")
    image, used = np.zeros((height, width, channels), np.uint16), 0
    for (y, x, dy, dx), (h, w), stride in zip(layout, cells, strides):
        rows = unfilter(raw[used : used + h * (stride + 1)], stride, max(1, channels * depth // 8))
        image[y::dy, x::dx] = _samples(rows, w, channels, depth)
        used += h * (stride + 1)
    if colour == 3:
        if palette is None or image.max() >= len(palette):
            raise ValueError("palette too short")
        return palette[image[..., 0]]
    image = image >> 8 if depth == 16 else image * (255 // ((1 << depth) - 1))
    return (image[..., :3] if channels > 2 else image[..., :1].repeat(3, axis=2)).astype(np.uint8)


def _spreads(png: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    out = []
    for content, *box in zip(png, *(c.to_pylist() for c in (x0, y0, x1, y1))):
        row = dict.fromkeys(("width", "height", "spread", "fault"))
        if content.is_valid:
            try:
                image = decode(content.as_py())
                row.update(width=image.shape[1], height=image.shape[0])
                left, top, right, bottom = [
                    edge if b is None else max(0, b) for b, edge in zip(box, (0, 0, image.shape[1], image.shape[0]))
                ]
                crop = image[top:bottom, left:right]
                row["spread"] = float(crop.std()) if crop.size else None
            except ValueError as error:
                row["fault"] = str(error)
        out.append(row)
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("spread", pa.float64()), ("fault", pa.string())])
    return pa.array(out, type=kind)


def png_spread(png: Column, crop: Column) -> Column:
    """Width and height of a PNG page and the standard deviation of the pixels of a crop: struct ``SPREAD``.

    Null edges are those of the page. Null images give nulls, damaged ones their fault, empty crops no spread.
    """
    return F.arrow_udf(_spreads, SPREAD)(png, crop["x_min"], crop["y_min"], crop["x_max"], crop["y_max"])
