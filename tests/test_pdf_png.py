"""PDF text layers and PNG pages, read from files made here."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamplight import cli
from lamplight.functions import images
from lamplight.service import Service
from lamplight.settings import Settings
from lamplight.sources import pdf
from lamplight.sources.warehouse import Warehouse


def escaped(text: str) -> bytes:
    raw = text.encode("cp1252")
    return b"(" + b"".join(b"\\" + bytes([c]) if c in b"()\\" else bytes([c]) for c in raw) + b")"


def stream(body: bytes, packed: bool, more: bytes = b"") -> bytes:
    if packed:
        body, more = zlib.compress(body), more + b"/Filter/FlateDecode"
    return b"<<%s/Length %d>>stream\n%s\nendstream" % (more, len(body), body)


def make_pdf(pages: list[list[tuple[str, float, float]]], packed: bool = True, bundled: bool = False) -> bytes:
    """Pages of (text, size, height). ``bundled``: all but the streams lie in an object stream."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    plain = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 600 800]/Resources<</Font<</F1 3 0 R>>>>>>" % (kids, len(pages)),
        3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>",
    }
    streams = {}
    for i, lines in enumerate(pages):
        plain[10 + 2 * i] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i)
        drawn = b"\n".join(b"BT /F1 %g Tf 1 0 0 1 50 %g Tm %s Tj ET" % (size, y, escaped(text)) for text, size, y in lines)
        streams[11 + 2 * i] = stream(drawn, packed)
    if bundled:
        heads, body = [], b""
        for number, value in plain.items():
            heads.append(b"%d %d" % (number, len(body)))
            body += value + b" "
        head = b" ".join(heads) + b" "
        streams[500] = stream(head + body, packed, b"/Type/ObjStm/N %d/First %d" % (len(plain), len(head)))
        plain = {}
    out = b"%PDF-1.7\n"
    for number, value in {**plain, **streams}.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (number, value)
    return out + b"trailer<</Root 1 0 R>>\nstartxref\n0\n%%EOF"


REPORT = [
    [("Port report", 20, 750), ("The harbour opens at dawn", 10, 700), ("and closes (late) at dusk.", 10, 688), ("1. first", 10, 660)],
    [("Café – prices", 10, 700), ("see the appendix", 7, 40)],
]
WANTED = [
    ("SectionHeaderItem", "Port report", 1), ("TextItem", "The harbour opens at dawn and closes (late) at dusk.", 1),
    ("ListItem", "1. first", 1), ("TextItem", "Café – prices", 2), ("FootnoteItem", "see the appendix", 2),
]


@pytest.mark.parametrize("packed,bundled", [(False, False), (True, False), (True, True)])
def test_regions(packed, bundled):
    items, pages = pdf.items_of(make_pdf(REPORT, packed, bundled))
    assert pages == 2 and [(i["class_name"], i["text"], i["page_number"]) for i in items] == WANTED
    box = items[0]["bbox"]
    assert box["x_min"] == pytest.approx(50 * 150 / 72) and box["y_max"] == pytest.approx(50 * 150 / 72)
    assert box["x_max"] > box["x_min"] and box["y_min"] < box["y_max"]


def test_every_line_comes_back():
    rng = random.Random(4)
    for _ in range(30):
        words = lambda: "".join(rng.choice("abc ()\\<>[]{}/%éß“7.") for _ in range(rng.randint(1, 40)))
        pages = [[(words(), 10, 780 - 30 * i) for i in range(rng.randint(0, 20))] for _ in range(rng.randint(1, 5))]
        items, count = pdf.items_of(make_pdf(pages, rng.random() < 0.5, rng.random() < 0.5))
        wanted = [(" ".join(t.split()), n) for n, lines in enumerate(pages, 1) for t, _, _ in lines if t.strip()]
        assert count == len(pages) and [(i["text"], i["page_number"]) for i in items] == wanted


def test_fonts_kerning_and_forms():
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]>>",
        b"<</Type/Page/Contents[4 0 R 5 0 R]/Resources<</Font<</A 6 0 R/B 7 0 R>>/XObject<</X 8 0 R>>>>>>",
        stream(b"BT /A 10 Tf 100 700 Td <00010002> Tj 0 -30 Td [<0003> -20 <0004> -900 <0001>] TJ ET", True),
        stream(b"q 1 0 0 1 0 -100 cm /X Do Q BI /W 1 ID (((( EI BT /B 10 Tf 14 TL 100 500 Td (\\101\\002) Tj T* (x) ' ET", False),
        b"<</Type/Font/Subtype/Type0/ToUnicode 9 0 R/DescendantFonts[<</DW 500/W[1[600 500] 3 4 500]>>]>>",
        b"<</Type/Font/Subtype/Type1/Encoding<</Differences[2/eacute/uni20AC]>>/FirstChar 65/Widths[700]>>",
        stream(b"BT /B 10 Tf 100 700 Td (form) Tj ET", True, b"/Type/XObject/Subtype/Form/Resources<</Font<</B 7 0 R>>>>"),
        stream(table, True),
    ]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (i, o) for i, o in enumerate(objects, 1))
    assert [i["text"] for i in pdf.items_of(data)[0]] == ["Ab", "cd A", "form", "Aé", "x"]


def test_damaged_files_become_faults(spark):
    good = make_pdf(REPORT)
    locked = good.replace(b"trailer<<", b"trailer<</Encrypt 9 0 R")
    rng = random.Random(5)
    cut = [bytes(b ^ (rng.random() < 0.05) * rng.randrange(256) for b in good) for _ in range(40)] + [good[: 7 * i] for i in range(60)]
    rows = [(0, good), (1, locked), (2, b"%PDF-1.7 nothing"), (3, b""), (4, None)] + [(10 + i, c) for i, c in enumerate(cut)]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: r.p for r in df.select("id", pdf.PdfText().parse(F.col("content")).alias("p")).collect()}
    assert got[0].fault is None and len(got[0]["items"]) == len(WANTED)
    assert "encrypted" in got[1].fault and "no pages" in got[2].fault and "no pages" in got[3].fault
    assert got[4].fault is None and got[4]["items"] == []
    assert all(p.fault or p.pages for i, p in got.items() if i != 4)


def test_ingest_of_pdf_files(spark, tmp_path, capsys):
    service = Service(Warehouse(spark, f"{tmp_path}/store", Settings(report_buckets=2)), extractor=pdf.PdfText())
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(make_pdf(REPORT))
    (folder / "b.pdf").write_bytes(b"%PDF-1.7" + b" damaged" * 9)
    (folder / "c.pdf").write_bytes(make_pdf([[("Nothing about boats is said here.", 10, 700)]]))
    channel = service.create_channel("News")
    command = lambda *argv: cli.run(service, cli.parser().parse_args(["--root", service.store.root, *argv]))
    assert command("ingest", str(folder), "--channel-id", channel, "--stop-on-error", "--no-tables", "--no-ocr") == 1
    assert "succeeded 1 / 2" in capsys.readouterr().out
    assert command("ingest", str(folder), "--channel-id", channel) == 1
    shown = capsys.readouterr()
    assert "succeeded 2 / 3" in shown.out and "no pages" in shown.err
    chunks = service.store.read("report_chunks").collect()
    assert any("harbour opens" in c.content for c in chunks)
    assert all(c.metadata.bboxes and c.metadata.extractor == "pdf-text" for c in chunks)
    command("query", "harbour dawn", "--channel-id", channel, "--top-k", "1", "--neighbours", "0")
    assert "harbour opens" in capsys.readouterr().out


# PNG


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def make_png(samples: np.ndarray, depth: int, colour: int, rng, interlaced: bool = False, palette=None) -> bytes:
    """An encoder with a random filter for each row, byte by byte after the format's definition."""
    height, width, channels = samples.shape
    step, raw = max(1, channels * depth // 8), b""
    layout = images.PASSES if interlaced else [(0, 0, 1, 1)]
    for y0, x0, dy, dx in layout:
        part = samples[y0::dy, x0::dx]
        if not part.size:
            continue
        above = None
        for row in part:
            bits = "".join(format(int(v), f"0{depth}b") for v in row.ravel())
            bits += "0" * (-len(bits) % 8)
            line = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
            above, kind, out = above or [0] * len(line), rng.randrange(5), []
            for i, v in enumerate(line):
                a, b = (line[i - step] if i >= step else 0), above[i]
                c = above[i - step] if i >= step else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
            raw += bytes([kind, *out])
            above = line
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    data = zlib.compress(raw)
    chunks = [chunk(b"IHDR", head), *([chunk(b"PLTE", palette.tobytes())] if palette is not None else [])]
    chunks += [chunk(b"IDAT", data[: len(data) // 2]), chunk(b"IDAT", data[len(data) // 2 :]), chunk(b"IEND", b"")]
    return images.SIGNATURE + b"".join(chunks)


KINDS = [(0, d) for d in (1, 2, 4, 8, 16)] + [(2, 8), (2, 16), (4, 8), (4, 16), (6, 8), (6, 16)] + [(3, d) for d in (1, 2, 4, 8)]


@pytest.mark.parametrize("colour,depth", KINDS)
def test_png_round_trip(colour, depth):
    rng = random.Random(colour * 100 + depth)
    make = np.random.default_rng(depth)
    for interlaced in (False, True):
        for height, width in [(1, 1), (3, 5), (9, 13), (17, 8)]:
            samples = make.integers(0, 1 << depth, (height, width, images.CHANNELS[colour]))
            palette = make.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
            got = images.decode(make_png(samples, depth, colour, rng, interlaced, palette))
            if colour == 3:
                wanted = palette[samples[..., 0]]
            else:
                eight = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
                wanted = eight[..., :3] if colour in (2, 6) else np.repeat(eight[..., :1], 3, axis=2)
            assert (got == wanted).all()


def test_spread_of_crops(spark):
    rng, make = random.Random(1), np.random.default_rng(1)
    samples = make.integers(0, 256, (20, 30, 3))
    good = make_png(samples, 8, 2, rng)
    bad = good[:60] + b"\x00" + good[61:]
    rows = [(0, good, 2, 3, 12, 9), (1, good, None, None, None, None), (2, good, 5, 5, 5, 9), (3, bad, 0, 0, 5, 5)]
    rows += [(4, None, 0, 0, 5, 5), (5, b"x", 0, 0, 5, 5), (6, good[:-9], 0, 0, 5, 5), (7, good, -3, -3, 99, 99)]
    df = spark.createDataFrame(rows, "id int, png binary, x_min int, y_min int, x_max int, y_max int")
    crop = F.struct("x_min", "y_min", "x_max", "y_max")
    got = {r.id: r.s for r in df.select("id", images.png_spread(F.col("png"), crop).alias("s")).collect()}
    assert got[0].spread == pytest.approx(samples[3:9, 2:12].std()) and (got[0].width, got[0].height) == (30, 20)
    assert got[1].spread == got[7].spread == pytest.approx(samples.std())
    assert got[2].spread is None and got[2].fault is None
    assert all(got[i].fault and got[i].spread is None for i in (3, 5, 6)) and got[4].fault is None
