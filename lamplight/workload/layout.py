"""Layout, text and geometry operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import geometry, providers, text
from lamplight.functions.splitting import split
from lamplight.operators import layout as op
from lamplight.operators.rows import exploded
from lamplight.session import stored
from lamplight.settings import ExtractOptions
from lamplight.sources import extract, files, standins as view
from lamplight.sources.standins import (
    ITEM_VIEWS,
    sql_has_text,
    sql_language,
    sql_page_type,
    sql_squash,
    sql_strip,
    with_views,
)
from lamplight.workload.register import query

READERS = dict(reader=view.TaggedLines(), captioner=view.TaggedCaption(), formulas=view.TaggedFormula())


def _docs(spark, folder):
    return view.table(spark, folder, "documents").select("doc_id", "lang", "source", "text")


def _regions(spark, folder):
    return op.regions(view.layout_items(spark, folder))


def _blocks(spark, folder, options=ExtractOptions()):
    return op.blocks(_regions(spark, folder), options, **READERS)


# Files -----------------------------------------------------------------------------


@query(
    "src_03_validate_pdf",
    """
    WITH f AS (SELECT doc_id, encode(CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, doc_id % 40)
                                          WHEN doc_id % 3 = 0 THEN text ELSE '%PDF-1.7' || chr(10) || text END) AS content
               FROM documents)
    SELECT doc_id, CASE WHEN octet_length(content) < 32 THEN 'too small'
                        WHEN lower(hex(content))[1:10] <> '255044462d' THEN 'missing header' END AS fault,
           octet_length(content) AS size_bytes, lower(hex(content))[1:16] AS header_hex
    FROM f""",
)
def _(spark, folder):
    docs = _docs(spark, folder)
    content = (
        F.when(F.col("doc_id") % 5 == 0, F.substring("text", F.lit(1), (F.col("doc_id") % 40).cast("int")))
        .when(F.col("doc_id") % 3 == 0, F.col("text"))
        .otherwise(F.concat(F.lit("%PDF-1.7\n"), "text"))
    )
    rows = files.validate(docs.select("doc_id", content.cast("binary").alias("content")))
    return rows.select("doc_id", "fault", "size_bytes", "header_hex")


@query("fn_26_content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def _(spark, folder):
    return _docs(spark, folder).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))


# Text ------------------------------------------------------------------------------


@query(
    "fn_15_language",
    f"""
    WITH t AS (SELECT doc_id, CASE WHEN lang = 'de' THEN translate(text, 'aeiou', 'ابتثج')
                    WHEN lang = 'es' THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxy', 'ابتثجحخدذرزسشصضطظعغفقكلمن')
                    WHEN doc_id % 41 = 0 THEN '12 34' ELSE text END AS body FROM documents)
    SELECT doc_id, {sql_language("body")} AS language FROM t""",
)
def _(spark, folder):
    body = (
        F.when(F.col("lang") == "de", F.translate("text", "aeiou", "ابتثج"))
        .when(
            F.col("lang") == "es",
            F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxy", "ابتثجحخدذرزسشصضطظعغفقكلمن"),
        )
        .when(F.col("doc_id") % 41 == 0, "12 34")
        .otherwise(F.col("text"))
    )
    return _docs(spark, folder).select("doc_id", text.language(body).alias("language"))


@query("fn_11_nfkc")
def _(spark, folder):
    # Half of the letters get a compatibility form that normalisation must undo.
    folded = F.translate("text", "abcdefgh", "ａｂｃｄｅｆｇｈ")
    docs = _docs(spark, folder)
    return docs.select("doc_id", text.nfkc(folded).alias("body"), (text.nfkc(folded) == F.col("text")).alias("undone"))


@query(
    "fn_14_safe_filename",
    r"""
    SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(
               CASE WHEN page_id % 9 = 0 THEN '???' ELSE url || ' (final).pdf' END,
               '[^\p{L}\p{N}._-]', '_', 'g'), '\A_+|_+\z', '', 'g'), ''), 'document.pdf') AS safe_name FROM pages""",
)
def _(spark, folder):
    name = F.when(F.col("page_id") % 9 == 0, "???").otherwise(F.concat("url", F.lit(" (final).pdf")))
    return view.table(spark, folder, "pages").select("page_id", text.safe_filename(name).alias("safe_name"))


@query(
    "fn_12_table_markdown",
    r"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem),
    line AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                    '| ' || l_partkey || '\|' || l_suppkey || ' | '
                    || CASE WHEN l_linenumber = 1 THEN l_returnflag || ' x' ELSE '' END || ' |' AS row FROM r)
    SELECT l_orderkey, '| item\|supplier | flag |' || chr(10) || '| --- | --- |' || chr(10)
           || string_agg(row, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS markdown
    FROM line GROUP BY l_orderkey""",
)
def _(spark, folder):
    li = view.table(spark, folder, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"
        )
    first = F.concat_ws("|", "l_partkey", "l_suppkey")
    cells = F.when(
        F.col("l_linenumber") == 1, F.array(first, F.concat("l_returnflag", F.lit("\nx ")))
    ).otherwise(F.array(first))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", cells.alias("cells"))
    grids = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    head = F.array(F.array(F.lit(" item|supplier"), F.lit("flag")))
    grid = F.concat(head, F.transform("rows", lambda r: r["cells"]))
    return grids.select("l_orderkey", text.table_markdown(grid).alias("markdown"))


@query(
    "fn_12_table_truncated",
    """
    WITH m AS (SELECT doc_id, '| ' || text || ' |' || chr(10) || '| --- |' AS md FROM (
                   SELECT doc_id, replace(replace(lang || text || '|', chr(10), ' '), '|', chr(92) || '|') AS text FROM documents))
    SELECT doc_id, CASE WHEN length(md) > 3000 THEN substr(md, 1, 3000) || chr(10) || '| … truncated … |' ELSE md END AS markdown
    FROM m""",
)
def _(spark, folder):
    # A bar after the text, so that no cell ends in white space.
    md = text.table_markdown(F.array(F.array(F.concat("lang", "text", F.lit("|")))), limit=3000)
    return _docs(spark, folder).select("doc_id", md.alias("markdown"))


@query(
    "fn_17_figure_markers",
    """
    SELECT doc_id, (CASE WHEN lang = 'en' THEN '[Figure: ' || source || ']' ELSE '[Figure]' END)
           || (CASE WHEN doc_id % 2 = 0 THEN chr(10) || text ELSE '' END) AS marker FROM documents""",
)
def _(spark, folder):
    caption = F.when(F.col("lang") == "en", F.col("source"))
    legend = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")
    return _docs(spark, folder).select("doc_id", text.figure_marker(caption, legend).alias("marker"))


@query(
    "fn_18_formula_markers",
    f"""
    WITH b AS (SELECT doc_id, {sql_strip("CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[$]', '', 'g') ELSE 'x' || source END")} AS body
               FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE '$$ ' || substr(body, 1, 5000) || ' $$' END AS marker FROM b""",
)
def _(spark, folder):
    bare = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "[$]", "")).otherwise(F.concat(F.lit("x"), "source"))
    latex = F.when(F.col("doc_id") % 10 == 3, "  ").otherwise(F.concat(F.lit(" $"), bare, F.lit("$ ")))
    return _docs(spark, folder).select("doc_id", text.formula_marker(latex, limit=5000).alias("marker"))


@query("fn_19_section_titles", f"SELECT doc_id, substr({sql_strip('text')}, 1, 300) AS section_title FROM documents")
def _(spark, folder):
    return _docs(spark, folder).select("doc_id", text.section_title(F.col("text"), limit=300).alias("section_title"))


@query(
    "fn_21_blockquote",
    f"""
    SELECT doc_id, array_to_string(list_transform(string_split({sql_strip("text")}, chr(10)),
           lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) AS quoted FROM documents""",
)
def _(spark, folder):
    return _docs(spark, folder).select("doc_id", text.blockquote(F.col("text")).alias("quoted"))


@query(
    "fn_24_shorten",
    f"""
    WITH s AS (SELECT doc_id, {sql_squash("text")} AS line FROM documents)
    SELECT doc_id, CASE WHEN length(line) <= 220 THEN line
        ELSE coalesce(nullif(regexp_extract(line, '^(.{{0,217}}[^ ]) ', 1), '') || ' …', '…') END AS preview FROM s""",
)
def _(spark, folder):
    return _docs(spark, folder).select("doc_id", text.shorten(F.col("text"), 220).alias("preview"))


@query(
    "flt_05_blank_lines",
    f"""
    SELECT doc_id, len(string_split(text, chr(10))) AS lines,
           len(list_filter(string_split(text, chr(10)), lambda x: {sql_has_text("x")})) AS kept FROM documents""",
)
def _(spark, folder):
    lines = F.split("text", "\n", -1)
    return _docs(spark, folder).select(
        "doc_id", F.size(lines).alias("lines"), F.size(F.filter(lines, text.has_text)).alias("kept")
    )


@query(
    "flt_09_confident_lines",
    f"""
    WITH l AS (SELECT conv_id, turn, at, {sql_strip("line")} AS line, (length(line) % 11) / 10.0::DOUBLE AS score
               FROM (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
                     FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)) AS x(conv_id, turn, line, at))
    SELECT c.conv_id, c.turn, coalesce(string_agg(line, chr(10) ORDER BY at) FILTER (score >= 0.5 AND line <> ''), '') AS recognised
    FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn GROUP BY c.conv_id, c.turn""".replace(" at,", " nth,")
    .replace("turn, line, at)", "turn, line, nth)")
    .replace("ORDER BY at)", "ORDER BY nth)"),
)
def _(spark, folder):
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda t: F.struct(t.alias("text"), ((F.length(t) % 11) / 10.0).alias("score")),
    )
    turns = view.table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", providers.recognised_text(lines).alias("recognised"))


# Geometry --------------------------------------------------------------------------


_KEY = "doc_id, l_partkey, l_suppkey"


@query(
    "fn_08_pixel_boxes",
    with_views(
        ["item_boxes", "boxes"],
        "SELECT doc_id, l_partkey AS part, round(x_min, 4) AS x_min, round(y_min, 4) AS y_min,"
        " round(x_max, 4) AS x_max, round(y_max, 4) AS y_max FROM boxes",
    ),
)
def _(spark, folder):
    rows = view.item_boxes(spark, folder)
    box = geometry.box_to_pixels(
        F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), F.col("bottom_origin"), F.col("page_points")
    )
    return rows.select("doc_id", "part", box.alias("b")).select(
        "doc_id", "part", *[F.round(F.col(f"b.{c}"), 4).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    )


@query(
    "fn_09_crops",
    with_views(
        ["item_boxes", "boxes", "regions", "measured"],
        "SELECT doc_id, page_number, reading_order, round(area, 6) AS area, cx0, cy0, cx1, cy1, readable FROM measured",
    ),
)
def _(spark, folder):
    rows = _regions(spark, folder)
    box, width, height = F.col("bbox"), F.col("page_width"), F.col("page_height")
    area, crop = geometry.area_ratio(box, width, height), geometry.crop_box(box, width, height)
    return rows.select(
        "doc_id",
        "page_number",
        "reading_order",
        F.round(area, 6).alias("area"),
        crop["x_min"].alias("cx0"),
        crop["y_min"].alias("cy0"),
        crop["x_max"].alias("cx1"),
        crop["y_max"].alias("cy1"),
        geometry.worth_reading(area, crop, F.col("pixel_stddev")).alias("readable"),
    )


@query("flt_10_crop_spread")
def _(spark, folder):
    # The bytes of a text stand for a raw image 16 pixels wide.
    docs = _docs(spark, folder).withColumn("rgb", F.col("text").cast("binary"))
    height = F.floor(F.octet_length("rgb") / 48).cast("int")
    crop = F.struct(
        F.lit(0).alias("x_min"), F.lit(0).alias("y_min"), F.lit(16).alias("x_max"), height.alias("y_max")
    )
    return docs.select("doc_id", F.round(providers.crop_stddev(F.col("rgb"), F.lit(16), height, crop), 6).alias("spread"))


@query(
    "fn_10_box_arrays",
    """SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity + l_tax END AS x_sum FROM lineitem""",
)
def _(spark, folder):
    li = view.table(spark, folder, "lineitem")
    raw = F.when(
        F.col("l_linenumber") % 3 != 0, F.array("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    ).otherwise(F.array("l_quantity", "l_tax"))
    back = geometry.box_to_array(geometry.box_from_array(raw))
    return li.select("l_orderkey", "l_partkey", (F.get(back, F.lit(0)) + F.get(back, F.lit(2))).alias("x_sum"))


_CELLS = """
    cells AS (SELECT l_orderkey AS t, l_linenumber * 1000000 + l_partkey AS seq, l_linenumber - 1 AS r0,
                     l_linenumber - 1 + l_suppkey % 3 AS r1, l_partkey % 3 AS c0,
                     l_partkey % 3 + 1 + l_suppkey % 2 AS c1, 'p' || l_partkey AS text FROM lineitem)"""


@query(
    "fn_30_fill_grid",
    f"""
    WITH {_CELLS}, size AS (SELECT t, max(r1) AS n_rows, max(c1) AS n_cols FROM cells GROUP BY t HAVING max(r1) > 0),
    slots AS (SELECT t, n_rows, n_cols, unnest(range(n_rows)) AS r FROM size),
    grid AS (SELECT t, r, unnest(range(n_cols)) AS c FROM slots),
    filled AS (SELECT g.t, g.r, g.c, coalesce(max_by(x.text, x.seq), '') AS text FROM grid g
               LEFT JOIN cells x ON x.t = g.t AND g.r >= r0 AND g.r < r1 AND g.c >= c0 AND g.c < c1 GROUP BY g.t, g.r, g.c)
    SELECT t AS doc_id, string_agg(text, ',' ORDER BY r, c) AS flat, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols
    FROM filled GROUP BY t""",
)
def _(spark, folder):
    li = view.table(spark, folder, "lineitem")
    row, col = F.col("l_linenumber") - 1, (F.col("l_partkey") % 3).cast("int")
    cells = li.select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"),
        row.alias("row_start"),
        (row + F.col("l_suppkey") % 3).cast("int").alias("row_end"),
        col.alias("col_start"),
        (col + 1 + F.col("l_suppkey") % 2).cast("int").alias("col_end"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"),
    )
    grids = op.fill_grids(cells, ["doc_id"])
    return grids.select(
        "doc_id",
        F.array_join(F.flatten("table_data"), ",").alias("flat"),
        F.size("table_data").alias("n_rows"),
        F.size(F.get("table_data", F.lit(0))).alias("n_cols"),
    )


@query(
    "agg_13_grid_bounds",
    f"WITH {_CELLS} SELECT t AS doc_id, max(r1) AS n_rows, max(c1) AS n_cols FROM cells GROUP BY t",
)
def _(spark, folder):
    li = view.table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.max(F.col("l_linenumber") - 1 + F.col("l_suppkey") % 3).alias("n_rows"),
        F.max(F.col("l_partkey") % 3 + 1 + F.col("l_suppkey") % 2).alias("n_cols"),
    )


# Layout ----------------------------------------------------------------------------


def _with(n, body):
    return with_views(ITEM_VIEWS[:n], body)


@query("doc_01_regions", _with(3, "SELECT doc_id, page_number, reading_order, kind, text FROM regions"))
def _(spark, folder):
    return _regions(spark, folder).select("doc_id", "page_number", "reading_order", "kind", "text")


@query(
    "join_12_kind_counts",
    _with(3, "SELECT kind, count(*) AS regions FROM regions GROUP BY kind"),
)
def _(spark, folder):
    return _regions(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("regions"))


@query(
    "topk_07_region_cap",
    """
    WITH k AS (SELECT doc_id, page, n, row_number() OVER (PARTITION BY doc_id, page ORDER BY n) AS rn
               FROM (SELECT user_id AS doc_id, event_type AS page, event_id AS n FROM events))
    SELECT doc_id, page, n FROM k WHERE rn <= 5""",
)
def _(spark, folder):
    # Users stand for documents and event types for pages, which makes crowded pages.
    items = view.table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"),
        F.col("event_type").alias("page_number"),
        F.col("event_id").alias("seq"),
        F.lit("TextItem").alias("class_name"),
        F.col("event_id").cast("string").alias("text"),
    )
    rows = op.regions(items, cap=5)
    return rows.select("doc_id", F.col("page_number").alias("page"), F.col("text").cast("long").alias("n"))


@query(
    "flt_13_pages_to_render",
    _with(
        3,
        """SELECT doc_id, page_number FROM regions GROUP BY doc_id, page_number
        HAVING bool_or(kind IN ('figure', 'formula') OR (kind IN ('text', 'heading', 'footer') AND length(text) < 20))""",
    ),
)
def _(spark, folder):
    return op.pages_to_render(_regions(spark, folder))


@query(
    "flt_12_regions_to_read",
    _with(
        4,
        """SELECT kind, count(*) AS regions, count(*) FILTER (readable) AS read FROM measured
        WHERE kind IN ('text', 'heading', 'footer') AND length(text) < 20 GROUP BY kind""",
    ),
)
def _(spark, folder):
    rows = _regions(spark, folder)
    box, width, height = F.col("bbox"), F.col("page_width"), F.col("page_height")
    readable = geometry.worth_reading(
        geometry.area_ratio(box, width, height), geometry.crop_box(box, width, height), F.col("pixel_stddev")
    )
    short = op.needs_reading(F.col("kind"), F.col("text"), ExtractOptions())
    return rows.where(short).groupBy("kind").agg(
        F.count(F.lit(1)).alias("regions"), F.count_if(readable).alias("read")
    )


@query("doc_02_blocks", _with(5, "SELECT doc_id, page_number, reading_order, kind AS type, content FROM blocks"))
def _(spark, folder):
    return _blocks(spark, folder).select("doc_id", "page_number", "reading_order", "type", "content")


@query(
    "flt_15_options_off",
    _with(
        5,
        """SELECT kind AS type, count(*) AS regions,
               count(*) FILTER (kind IN ('text', 'heading', 'footer') AND text <> '') AS blocks
        FROM blocks GROUP BY kind""",
    ),
)
def _(spark, folder):
    off = ExtractOptions(False, False, False, False, False)
    rows = _blocks(spark, folder, off)
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("regions"), F.count("content").alias("blocks"))


_PAGE = (
    "doc_id, page_number, content, heading AS section_title,"
    f" {sql_page_type()} AS page_type, {sql_language('content')} AS language, n AS n_blocks"
)


@query("doc_03_pages", _with(6, f"SELECT {_PAGE} FROM pages_of"))
def _(spark, folder):
    rows = op.pages(_blocks(spark, folder))
    return rows.select("doc_id", "page_number", "content", "section_title", "page_type", "language", "n_blocks")


@query(
    "fn_16_page_types",
    _with(6, f"SELECT page_type, count(*) AS pages, sum(n)::BIGINT AS blocks FROM (SELECT {sql_page_type()} AS page_type, n FROM pages_of) GROUP BY page_type"),
)
def _(spark, folder):
    rows = op.pages(_blocks(spark, folder))
    return rows.groupBy("page_type").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_blocks").alias("blocks"))


@query(
    "agg_06_block_histogram",
    _with(6, "SELECT doc_id, page_number, headings AS n_headings, texts AS n_texts, tables AS n_tables, figures AS n_figures, formulas AS n_formulas FROM pages_of"),
)
def _(spark, folder):
    rows = op.pages(_blocks(spark, folder))
    return rows.select("doc_id", "page_number", "n_headings", "n_texts", "n_tables", "n_figures", "n_formulas")


@query(
    "agg_11_page_lists",
    _with(
        5,
        """SELECT doc_id, page_number, count(*) FILTER (kind = 'table' AND content IS NOT NULL) AS tables,
           coalesce(string_agg('s_' || l_suppkey, ',' ORDER BY reading_order) FILTER (kind = 'formula'), '') AS formulas,
           coalesce(string_agg(CASE WHEN area >= 0.02 THEN 'picture of line ' || l_partkey ELSE '' END, ',' ORDER BY reading_order)
                    FILTER (kind = 'figure'), '') AS captions,
           coalesce(string_agg(CAST(reading_order AS VARCHAR), ',' ORDER BY reading_order) FILTER (content IS NOT NULL), '') AS reading_order
        FROM blocks GROUP BY doc_id, page_number""",
    ),
)
def _(spark, folder):
    rows = op.pages(_blocks(spark, folder))
    return rows.select(
        "doc_id",
        "page_number",
        F.size("tables").alias("tables"),
        F.array_join("formulas", ",").alias("formulas"),
        F.array_join(F.transform("figures", lambda f: f["caption"]), ",").alias("captions"),
        F.array_join(F.transform("reading_order", lambda n: n.cast("string")), ",").alias("reading_order"),
    )


_DOCS = f"""
    SELECT doc_id, count(*) AS page_count, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages,
           list_sort(list_distinct(list(language)))[1] AS language,
           bool_or(tables > 0) AS has_tables, bool_or(figures > 0) AS has_figures, bool_or(formulas > 0) AS has_formulas
    FROM (SELECT *, {sql_language("content")} AS language FROM pages_of) """


@query("doc_04_documents", _with(6, f"{_DOCS} GROUP BY doc_id"))
def _(spark, folder):
    rows = op.documents(op.pages(_blocks(spark, folder)))
    return rows.select(
        "doc_id", "page_count", F.array_join("detected_languages", ",").alias("languages"), "language",
        "has_tables", "has_figures", "has_formulas",
    )


@query("flt_14_page_range", _with(6, f"{_DOCS} WHERE page_number BETWEEN 1 AND 1 GROUP BY doc_id"))
def _(spark, folder):
    pages = op.pages(op.blocks(op.page_range(_regions(spark, folder), 1, 1), **READERS))
    rows = op.documents(pages)
    return rows.select(
        "doc_id", "page_count", F.array_join("detected_languages", ",").alias("languages"), "language",
        "has_tables", "has_figures", "has_formulas",
    )


@query(
    "doc_05_flat_blocks",
    _with(
        5,
        f"""SELECT doc_id, page_number, kind AS type, content,
               row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order) - 1 AS reading_order
        FROM blocks WHERE content IS NOT NULL AND {sql_has_text("content")} AND page_number <> 0""",
    ),
)
def _(spark, folder):
    rows = op.flat_blocks(stored(op.pages(_blocks(spark, folder)), "pages"))
    return rows.select("doc_id", "page_number", "type", "content", "reading_order")


# Web pages -------------------------------------------------------------------------

_TAGS = "h1|h2|h3|h4|h5|h6|p|li|pre|footer"
_UNESCAPE = "words"
for _entity, _char in extract.ENTITIES.items():
    _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"

HTML_ITEMS = f"""
    marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '{extract.NOISE}', ' ', 'g'),
                   '{extract.OPENERS}', chr(30) || '\\1' || chr(31), 'g'), '{extract.CLOSERS}', chr(30), 'g') AS body FROM pages),
    parts AS (SELECT page_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS seq
              FROM (SELECT page_id, list_filter(string_split(body, chr(30)), lambda p: contains(p, chr(31))) AS ps FROM marked)),
    elements AS (SELECT page_id, seq, lower(string_split(part, chr(31))[1]) AS tag,
                     regexp_replace(string_split(part, chr(31))[-1], '<[^>]*>', '', 'g') AS words FROM parts),
    items AS (SELECT page_id AS doc_id, seq, seq // {extract.HTML_PAGE_ITEMS} + 1 AS page_number,
                     CASE WHEN tag = 'h1' THEN 'TitleItem' WHEN tag IN ('h2', 'h3', 'h4', 'h5', 'h6') THEN 'SectionHeaderItem'
                          WHEN tag = 'p' THEN 'TextItem' WHEN tag = 'li' THEN 'ListItem' WHEN tag = 'pre' THEN 'CodeItem'
                          WHEN tag = 'footer' THEN 'FootnoteItem' END AS class_name,
                     {sql_strip(_UNESCAPE)} AS text FROM elements)"""


@query("src_04_html_items", f"WITH {HTML_ITEMS} SELECT doc_id, seq, page_number, class_name, text FROM items")
def _(spark, folder):
    return view.html_item_rows(spark, folder).select("doc_id", "seq", "page_number", "class_name", "text")


_HTML_PAGES = f"""
    {HTML_ITEMS},
    web AS (SELECT doc_id, page_number, count(*) FILTER (text <> '') AS n,
                   count(*) FILTER (text <> '' AND class_name = 'TitleItem') AS headings,
                   count(*) FILTER (text <> '' AND class_name = 'TextItem') AS texts, 0 AS tables, 0 AS figures,
                   coalesce(bool_or(class_name = 'TitleItem' AND contains(lower(text), 'table of contents')), false) AS toc,
                   coalesce(string_agg(nfc_normalize(text), chr(10) || chr(10) ORDER BY seq) FILTER (text <> ''), '') AS content,
                   coalesce(min_by(nfc_normalize(text), seq) FILTER (class_name = 'TitleItem' AND text <> ''), '') AS heading
            FROM items GROUP BY doc_id, page_number)"""


def _html_pages(spark, folder):
    return op.pages(op.blocks(op.regions(view.html_item_rows(spark, folder))))


@query(
    "doc_06_web_pages",
    f"""WITH {_HTML_PAGES} SELECT doc_id, page_number, content, heading AS section_title,
        {sql_page_type()} AS page_type, {sql_language("content")} AS language FROM web""",
)
def _(spark, folder):
    rows = _html_pages(spark, folder)
    return rows.select("doc_id", "page_number", "content", "section_title", "page_type", "language")


@query(
    "doc_09_markdown",
    f"""WITH {_HTML_PAGES} SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY page_number) AS markdown
        FROM web GROUP BY doc_id""",
)
def _(spark, folder):
    rows = extract.with_blocks(view.html_documents(spark, folder), extract.html_items(F.col("html")))
    return rows.select("doc_id", F.array_join(F.transform("blocks", lambda b: b["content"]), "\n\n").alias("markdown"))


@query(
    "doc_10_document_language",
    f"""WITH {_HTML_PAGES} SELECT doc_id, min(language) AS language, array_to_string(list_sort(list_distinct(list(language))), ',') AS detected
        FROM (SELECT doc_id, {sql_language("content")} AS language FROM web) GROUP BY doc_id""",
)
def _(spark, folder):
    docs = extract.with_blocks(view.html_documents(spark, folder), extract.html_items(F.col("html")))
    rows = docs.select("doc_id", extract.languages_of_blocks(F.col("blocks")).alias("found"))
    return rows.select(
        "doc_id", op.document_language(F.col("found")).alias("language"), F.array_join("found", ",").alias("detected")
    )


# Splitting -------------------------------------------------------------------------


@query("chk_01_split_text")
def _(spark, folder):
    rows = exploded(_docs(spark, folder).select("doc_id", "text"), split(F.col("text")), "piece", "content")
    return rows.drop("text")


@query(
    "chk_02_short_texts",
    f"""SELECT doc_id, CASE WHEN {sql_strip("text")} = '' THEN 0 ELSE 1 END AS pieces, {sql_strip("text")} AS content
    FROM documents WHERE length({sql_strip("text")}) < 2000""",
)
def _(spark, folder):
    # Below the limit a text is one piece, itself without outer white space.
    pieces = split(F.col("text"))
    rows = _docs(spark, folder).where(F.length(text.strip(F.col("text"))) < 2000)
    return rows.select("doc_id", F.size(pieces).alias("pieces"), F.get(pieces, F.lit(0)).alias("content"))
