"""Column functions on hand-made inputs."""

from __future__ import annotations

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from lamplight.functions import geometry, ids, providers, ranking, text, vectors
from lamplight.operators import layout


def values(spark, column, cases, ddl):
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], f"n int, x {ddl}")
    return [r[0] for r in rows.orderBy("n").select(column(F.col("x"))).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_strip_matches_unicode_strip(spark):
    cases = ["  a b ", " x　", "\x1fq\x85", "   ", "", "​z", "\tlines\n\n"]
    assert values(spark, text.strip, cases, "string") == [c.strip() for c in cases]
    assert values(spark, text.has_text, cases, "string") == [bool(c.strip()) for c in cases]
    assert values(spark, text.squash, cases, "string") == [" ".join(c.split()) for c in cases]


def test_nfkc(spark):
    cases = ["ﻣﻮاﻓﻖ", "ﬁ ①", "plain", "", "ción\nzweï", None]
    got = values(spark, text.nfkc, cases, "string")
    assert got[:4] == ["موافق", "fi 1", "plain", ""]
    assert got[4] == unicodedata.normalize("NFKC", cases[4]) and got[5] is None
    assert values(spark, text.nfkc, got, "string") == got
    lists = [["ﬁ", "a"], [], None, ["a", None, "①"]]
    assert values(spark, text.nfkc_all, lists, "array<string>") == [["fi", "a"], [], None, ["a", None, "1"]]


def test_language(spark):
    cases = ["", "1234", "hello", "موافق", "abcdefghi م", "abc موافقات", "مواف abcd"]
    assert values(spark, text.language, cases, "string") == ["mixed", "mixed", "en", "ar", "mixed", "mixed", "mixed"]


def test_safe_filename(spark):
    cases = ["Q4 report (final).pdf", "???", "__a b__", "تقرير 2024.pdf"]
    assert values(spark, text.safe_filename, cases, "string") == [
        "Q4_report__final_.pdf", "document.pdf", "a_b", "تقرير_2024.pdf",
    ]


def test_table_markdown(spark):
    grids = [[["a|b", "c\nd"], ["e"]], [], [[]], [["only"]], None]
    got = values(spark, text.table_markdown, grids, "array<array<string>>")
    assert got == ["| a\\|b | c d |\n| --- | --- |\n| e |  |", "", "", "| only |\n| --- |", ""]
    whole = values(spark, text.table_markdown, [[["x" * 60_000]]], "array<array<string>>")[0]
    assert len(whole) == 60_000 + len("|  |\n| --- |")
    long = values(spark, lambda g: text.table_markdown(g, 50_000), [[["x" * 60_000]]], "array<array<string>>")[0]
    assert long.endswith("x\n| … truncated … |") and len(long) == 50_000 + len(text.TRUNCATED_TABLE)


def test_markers(spark):
    rows = spark.createDataFrame([("cap", "ocr"), ("cap", ""), ("", "ocr"), ("", "")], "c string, o string")
    got = [r[0] for r in rows.select(text.figure_marker(F.col("c"), F.col("o"))).collect()]
    assert got == ["[Figure: cap]\nocr", "[Figure: cap]", "[Figure]\nocr", "[Figure]"]
    latex = ["$x^2$", "", "y", "$z", "a" * 6000]
    short = ["$$ x^2 $$", None, "$$ y $$", "$$ $z $$"]
    assert values(spark, text.formula_marker, latex, "string") == [*short, "$$ " + "a" * 6000 + " $$"]
    cut = values(spark, lambda c: text.formula_marker(c, 5000), latex, "string")
    assert cut == [*short, "$$ " + "a" * 5000 + " $$"]


def test_blockquote_and_shorten(spark):
    assert values(spark, text.blockquote, ["a\n\nb", "  ", None], "string") == ["> a\n>\n> b", "", ""]
    import textwrap

    cases = ["one two three four", "x" * 40, "short", "a b-c dd-ee ff-gg hh", "  spaced   out  words here ok "]
    for width in (12, 16, 20):
        expected = [textwrap.shorten(c, width=width, placeholder=" …") for c in cases]
        assert values(spark, lambda x: text.shorten(x, width), cases, "string") == expected


def test_key_values(spark):
    cases = [["a=1", " b = 2=3"], ["a=1", "a=2"], ["novalue"], [" =x"], []]
    assert values(spark, text.key_values, cases, "array<string>") == [
        {"a": "1", "b": " 2=3"}, {"a": "2"}, None, None, {},
    ]


def test_connection_keywords(spark):
    cases = [
        "postgres://u:p@h/db",
        "host=h dbname=d",
        "Host=h;Port=5;Database=d;Username=u;Password=p w\\'x;Junk=1",
        "",
    ]
    assert values(spark, text.connection_keywords, cases, "string") == [
        cases[0], cases[1], "host=h port=5 dbname=d user=u password='p w\\\\\\'x'", "",
    ]


def test_object_key(spark):
    key = text.object_key("channels", F.lit("c"), F.lit(""), F.lit("raw\\x"), F.lit("f.pdf"))
    assert one(spark, key) == "channels/c/raw/x/f.pdf"


def test_uuid(spark):
    good = "0A1B2C3D-4E5F-6071-8293-A4B5C6D7E8F9"
    cases = [good, good.replace("-", ""), "{" + good + "}", "nope", good + "0"]
    assert values(spark, ids.canonical_uuid, cases, "string") == [good.lower()] * 3 + [None, None]


def test_pixel_boxes(spark):
    box = lambda *a: geometry.box_to_pixels(*[F.lit(x).cast("double") for x in a[:4]], F.lit(a[4]), F.lit(a[5]).cast("double"))
    top = one(spark, box(72, 100, 144, 142, False, 842))
    flipped = one(spark, box(72, 742, 144, 700, True, 842))
    assert tuple(round(v, 3) for v in top) == (150, 208.333, 300, 295.833) == tuple(round(v, 3) for v in flipped)
    assert tuple(one(spark, box(None, 1, 2, 3, False, 842))) == (0, 0, 0, 0)


def test_crops_round_half_to_even(spark):
    box = geometry.box(F.lit(2.5), F.lit(-3.5), F.lit(3.5), F.lit(99.0))
    assert tuple(one(spark, geometry.crop_box(box, F.lit(50), F.lit(60)))) == (2, 0, 4, 60)
    assert one(spark, geometry.area_ratio(box, F.lit(0), F.lit(60))) == 0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, vectors.cosine_distance(a, b)) == 1.0
    moved = one(spark, vectors.unit(vectors.blend(a, b, 0.3)))
    assert moved == pytest.approx([0.9191450300, 0.3939192986], abs=1e-6)
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    left = F.create_map(F.lit(1), F.lit(2.0), F.lit(5), F.lit(1.0))
    right = F.create_map(F.lit(5), F.lit(4.0), F.lit(7), F.lit(9.0))
    assert one(spark, vectors.sparse_dot(left, right)) == 4.0


def test_scores(spark):
    rank = lambda d, s, a: one(spark, ranking.reciprocal_rank(F.lit(d).cast("long"), F.lit(s).cast("long"), a))
    assert rank(1, None, 0.5) == pytest.approx(0.00819672131)
    assert rank(1, 2, 0.5) == pytest.approx(0.01626123744)
    assert rank(1, 3, 0.7) == pytest.approx(0.01623731460)
    assert rank(None, None, 0.5) == 0
    assert [one(spark, ranking.sigmoid(F.lit(x))) for x in (2.0, -2.0, 0.0)] == pytest.approx(
        [0.8807970780, 0.1192029220, 0.5]
    )


def test_page_types(spark):
    cases = {
        "empty": (0, 0, 0, 0, 0, False),
        "toc": (10, 1, 9, 0, 0, True),
        "table": (3, 0, 1, 2, 0, False),
        "chart": (3, 0, 1, 0, 2, False),
        "cover": (2, 1, 1, 0, 0, False),
        "text": (4, 0, 4, 0, 0, False),
        "mixed": (2, 0, 1, 1, 0, False),
    }
    for label, counts in cases.items():
        assert one(spark, layout.page_type(*[F.lit(c) for c in counts])) == label
    assert one(spark, layout.page_type(*[F.lit(c) for c in (4, 1, 3, 0, 0, False)])) == "mixed"


def test_recognised_lines(spark):
    lines = [[("low", 0.49), (" ok ", 0.5), ("  ", 0.9), ("two", 0.8)], [], None]
    got = values(spark, providers.recognised_text, lines, "array<struct<text: string, score: double>>")
    assert got == ["ok\ntwo", "", ""]


def test_crop_spread(spark):
    flat, mixed = bytes([7] * 48), bytes([0, 255] * 24)
    rows = spark.createDataFrame([(flat,), (mixed,), (b"short",)], "rgb binary")
    crop = F.struct(F.lit(0).alias("x_min"), F.lit(0).alias("y_min"), F.lit(4).alias("x_max"), F.lit(4).alias("y_max"))
    got = [r[0] for r in rows.select(providers.crop_stddev(F.col("rgb"), F.lit(4), F.lit(4), crop)).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(127.5) and got[2] is None


def test_lexical_embedder(spark):
    rows = spark.createDataFrame([("the cat, the dog",), ("",), (None,)], "t string")
    embedder = providers.LexicalEmbedder()
    got = rows.select(embedder.dense(F.col("t")), embedder.sparse(F.col("t"))).collect()
    assert math.isclose(sum(x * x for x in got[0][0]), 1.0, rel_tol=1e-5)
    assert got[0][1] == {providers.token_id("the"): 2.0, providers.token_id("cat"): 1.0, providers.token_id("dog"): 1.0}
    assert len(got[1][0]) == 64 and got[1][1] == {} and got[2][1] == {}


def test_batches_are_worked_on_in_pieces(monkeypatch):
    import pyarrow as pa

    from lamplight.functions import memory, providers, splitting, text

    texts = pa.array([None if i % 7 == 0 else f"Ünit {i} ﬁ " * (i % 50) for i in range(400)])
    lists = pa.array([None if t is None else t.split(" ") for t in texts.to_pylist()], pa.list_(pa.string()))
    words = [[{"type": "text", "content": t, "reading_order": 0, "page_number": 1, "bbox": None}] for t in texts.to_pylist()]
    seen = []
    monkeypatch.setattr(memory, "PIECE_BYTES", 2_000)
    for made, values in (
        (lambda a: providers._sparse_rows(a, 1000), texts),
        (lambda a: providers._dense_rows(a, 8), texts),
        (text._nfkc_lists, lists),
        (splitting._pack, pa.array(words)),
    ):
        for part in (values, values[:0], values[3:90]):
            got = memory.in_pieces(lambda a: seen.append(a.nbytes) or made(a), part)
            assert got.to_pylist() == made(part).to_pylist()
    assert max(seen) < 8_000
