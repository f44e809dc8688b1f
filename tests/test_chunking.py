"""Splitter and packer against hand-worked cases and a direct reading of the rules."""

from __future__ import annotations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lamplight import schemas
from lamplight.functions.splitting import pack, pack_document, split_long_text, split_text

BOX = {"x_min": 0.0, "y_min": 1.0, "x_max": 2.0, "y_max": 3.0}


def block(kind, content, page=1, order=None, bbox=None):
    return {"type": kind, "content": content, "page_number": page, "reading_order": order or 0, "bbox": bbox}


def packed(*blocks):
    return pack_document([dict(b, reading_order=n) for n, b in enumerate(blocks)])


def shape(chunks):
    return [(c["content"], c["block_types"], c["section_title"], c["page_number"]) for c in chunks]


def test_text_blocks_join():
    assert shape(packed(block("text", "A"), block("text", " B "))) == [("A\n\nB", ["text", "text"], "", 1)]


def test_heading_opens_a_chunk():
    assert shape(packed(block("heading", "H"), block("text", "A"))) == [("H\n\nA", ["heading", "text"], "H", 1)]


def test_headings_in_a_row_merge_over_pages():
    got = packed(block("heading", "H1"), block("heading", "H2", 2), block("text", "A", 2))
    assert shape(got) == [("H1 — H2\n\nA", ["heading", "text"], "H1 — H2", 1)]


def test_tables_stand_alone():
    got = packed(block("text", "A"), block("table", "T"), block("text", "B"))
    assert [c["block_types"] for c in got] == [["text"], ["table"], ["text"]]
    got = packed(block("heading", "H"), block("table", "T" * 9000))
    assert shape(got) == [("H", ["heading"], "H", 1), ("T" * 9000, ["table"], "H", 1)]


def test_long_text_is_cut_and_keeps_its_box():
    body = "word " * 900
    got = packed(block("heading", "H"), block("text", body, bbox=BOX))
    assert got[0]["content"] == "H" and len(got) >= 4
    for n, c in enumerate(got[1:]):
        assert len(c["content"]) <= 2000 and c["section_title"] == "H" and c["piece"] == n
        assert c["bboxes"] == [{"page": 1, "bbox": [0.0, 1.0, 2.0, 3.0]}]


def test_limit_is_inclusive():
    assert len(packed(block("text", "x" * 1500), block("text", "y" * 499))) == 2
    assert len(packed(block("text", "x" * 1500), block("text", "y" * 498))) == 1


def test_blank_blocks_and_pages():
    assert packed(block("text", " "), block("heading", "\n")) == []
    got = packed(block("text", "A", 1, bbox=BOX), block("text", "B", 2, bbox=BOX))
    assert [e["page"] for e in got[0]["bboxes"]] == [1, 2] and got[0]["page_number"] == 1
    assert packed(block(None, "A", None))[0]["block_types"] == ["text"]


def test_sections_switch():
    got = packed(block("heading", "H"), block("text", "A"), block("heading", "K"), block("text", "B"))
    assert [c["section_title"] for c in got] == ["H", "K"]


def test_pack_in_spark_equals_pack_in_python(spark):
    docs = [[block("heading", "H", 1, 0), block("text", "A", 1, 1, BOX)], [], [block("table", "T", 2, 0)]]
    rows = spark.createDataFrame([(n, d) for n, d in enumerate(docs)], f"n int, b array<{schemas.BLOCK}>")
    got = [[c.asDict(True) for c in r[0]] for r in rows.orderBy("n").select(pack(F.col("b"))).collect()]
    assert got == [pack_document(d) for d in docs]


kinds = st.sampled_from(["text", "heading", "table", "footer"])
bodies = st.text(alphabet="ab .\n", max_size=60).map(lambda s: s * 40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(kinds, bodies), max_size=12))
def test_packer_keeps_order_and_limits(items):
    got = packed(*[block(k, b) for k, b in items])
    for c in got:
        assert c["content"].strip() == c["content"] != ""
        if c["block_types"][0] not in ("table", "heading"):
            assert len(c["content"]) <= 2000
    tables = [b.strip() for k, b in items if k == "table" and b.strip()]
    assert [c["content"] for c in got if c["block_types"] == ["table"]] == tables


def by_definition(text, separators, limit, overlap):
    """The published recursion, spelled out on lists of strings."""
    present = [n for n, s in enumerate(separators) if s == "" or s in text]
    at = present[0]
    mark, rest = separators[at], separators[at + 1 :]
    if mark == "":
        parts = list(text)
    else:
        head, *tail = text.split(mark)
        parts = [p for p in [head, *(mark + t for t in tail)] if p]
    out, run = [], []

    def close():
        group, size = [], 0
        for part in run:
            if size + len(part) > limit and group:
                out.append("".join(group))
                while size > overlap or (size + len(part) > limit and size > 0):
                    size -= len(group.pop(0))
            group.append(part)
            size += len(part)
        if group:
            out.append("".join(group))
        run.clear()

    for part in parts:
        if len(part) < limit:
            run.append(part)
        else:
            close()
            out.extend(by_definition(part, rest, limit, overlap) if rest else [part])
    close()
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n!?;؟ ", min_size=1, max_size=200), st.sampled_from([(20, 5), (7, 3), (50, 10)]))
def test_splitter_follows_the_definition(body, sizes):
    from lamplight.functions.splitting import SEPARATORS

    body = body.strip()
    expected = [p.strip() for p in by_definition(body, SEPARATORS, *sizes)] if body else []
    assert split_long_text(body, *sizes) == [p for p in expected if p]


def test_split_text_edges():
    assert split_text(None) == split_text("  ") == []
    assert split_text(" short ") == ["short"]
    hard = split_text("x" * 5000)
    assert [len(p) for p in hard] == [2000, 2000, 1400]


def test_long_pages_are_kept_whole(spark):
    from pyspark.sql import functions as F

    from lamplight.sources import extract

    item = lambda i: F.struct(
        F.lit("TextItem").alias("class_name"), F.concat(F.lit("item "), i.cast("string")).alias("text"), F.lit(1).alias("page_number")
    )
    docs = spark.range(1).select(F.col("id").alias("doc_id"))
    row = extract.with_blocks(docs, F.transform(F.sequence(F.lit(1), F.lit(500)), item)).first()
    assert [b["content"] for b in row["blocks"]] == [f"item {i}" for i in range(1, 501)]
