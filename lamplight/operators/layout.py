"""Layout items to regions, regions to blocks, blocks to pages and documents."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamplight.functions import geometry, text
from lamplight.functions.providers import (
    Captioner,
    FormulaReader,
    LineReader,
    NoCaption,
    NoFormula,
    NoLines,
    recognised_text,
)
from lamplight.operators.positions import running_offsets
from lamplight.operators.rows import exploded
from lamplight.settings import DEFAULTS, ExtractOptions

# Item classes of the layout model and the kind each one becomes.
KINDS = {
    "TextItem": "text",
    "SectionHeaderItem": "heading",
    "TitleItem": "heading",
    "TableItem": "table",
    "PictureItem": "figure",
    "FormulaItem": "formula",
    "ListItem": "text",
    "CodeItem": "text",
    "FootnoteItem": "footer",
}

# Kinds whose own text is kept.
WORDED = ("text", "heading", "footer")

# Page labels.
TOC_PHRASE = "table of contents"
DOMINANT_SHARE = 0.5
COVER_BLOCKS = 3

ROW_MARK, CELL_MARK = "\x1e", "\x1f"


def item_kind(class_name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*KINDS.items())]), class_name)


def fill_grids(cells: DataFrame, key: list[str]) -> DataFrame:
    """Merged table cells spread over every slot they span, as a grid per table.

    ``cells`` has row_start, row_end, col_start, col_end (ends exclusive), text and
    ``seq``; where spans overlap the later cell wins. Slots without a cell are ''.
    Slots are aggregated one by one and a row is collected only up to its width.
    """
    size = cells.groupBy(*key).agg(F.max("row_end").alias("n_rows"), F.max("col_end").alias("n_cols"))
    covered = (
        cells.where((F.col("row_end") > F.col("row_start")) & (F.col("col_end") > F.col("col_start")))
        .withColumn("row", F.explode(F.sequence("row_start", F.col("row_end") - 1)))
        .withColumn("col", F.explode(F.sequence("col_start", F.col("col_end") - 1)))
        .where((F.col("row") >= 0) & (F.col("col") >= 0))
        .groupBy(*key, "row", "col")
        .agg(F.max_by(text.strip(F.coalesce("text", F.lit(""))), "seq").alias("text"))
    )
    rows = covered.groupBy(*key, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("slots")
    )
    tables = rows.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("row", "slots"))).alias("lines")
    )
    blank = F.lit("")

    def grid(lines: Column, n_rows: Column, n_cols: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n_rows - 1),
            lambda r: F.transform(
                F.sequence(F.lit(0), n_cols - 1),
                lambda c: F.coalesce(F.try_element_at(F.try_element_at(lines, r), c), blank),
            ),
        )

    full = tables.join(size, key, "right").where((F.col("n_rows") > 0) & (F.col("n_cols") > 0))
    return full.select(
        *key, grid(F.col("lines"), F.col("n_rows"), F.col("n_cols")).alias("table_data")
    )


def regions(items: DataFrame, cap: int | None = None) -> DataFrame:
    """Known items as regions, numbered from 0 inside their page; with a ``cap`` only so many per page.

    ``items`` has doc_id, page_number, seq, class_name, text and optionally bbox,
    table_data and image columns. Items of unknown class or without a page go.
    """
    known = items.withColumn("kind", item_kind(F.col("class_name"))).where(
        F.col("kind").isNotNull() & F.col("page_number").isNotNull()
    )
    own_text = F.when(F.col("kind") == "table", "").otherwise(text.strip(F.coalesce("text", F.lit(""))))
    page_order = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    numbered = known.withColumn("text", own_text).withColumn("_n", F.row_number().over(page_order))
    if cap is not None:
        numbered = numbered.where(F.col("_n") <= cap)
    return numbered.withColumn("reading_order", F.col("_n") - 1).drop("_n", "class_name", "seq")


def needs_reading(kind: Column, words: Column, options: ExtractOptions) -> Column:
    """Worded region whose own text is too short to trust."""
    return (
        F.lit(options.ocr_fallback)
        & kind.isin(*WORDED)
        & (F.length(words) < DEFAULTS.ocr_fallback_min_chars)
    )


def needs_image(kind: Column, words: Column, options: ExtractOptions) -> Column:
    return kind.isin("figure", "formula") | needs_reading(kind, words, options)


def pages_to_render(found: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """Pages with at least one region that needs pixels; the others are never drawn."""
    return (
        found.groupBy("doc_id", "page_number")
        .agg(F.bool_or(needs_image(F.col("kind"), F.col("text"), options)).alias("render"))
        .where("render")
        .drop("render")
    )


def blocks(
    found: DataFrame,
    options: ExtractOptions = ExtractOptions(),
    reader: LineReader = NoLines(),
    captioner: Captioner = NoCaption(),
    formulas: FormulaReader = NoFormula(),
) -> DataFrame:
    """One row per region with its block content, null when the region is dropped.

    Looks for ``bbox``, ``page_width``, ``page_height``, ``pixel_stddev``, ``image``
    and ``table_data``; without them nothing is read from pixels.
    """

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in found.columns else F.lit(None).cast(kind)

    kind, words = F.col("kind"), F.col("text")
    box = column("bbox", "struct<x_min: double, y_min: double, x_max: double, y_max: double>")
    width, height = column("page_width", "double"), column("page_height", "double")
    ratio = F.coalesce(geometry.area_ratio(box, width, height), F.lit(0.0))
    readable = geometry.worth_reading(
        ratio, geometry.crop_box(box, width, height), column("pixel_stddev", "double")
    )
    image = column("image", "binary")
    seen = F.col("_seen")
    grid = column("table_data", "array<array<string>>")
    packed = F.array_join(F.transform(grid, lambda r: F.array_join(r, CELL_MARK, "")), ROW_MARK)
    own = F.when(
        needs_reading(kind, words, options) & (F.coalesce(seen, F.lit("")) != ""), seen
    ).otherwise(words)
    raw = (
        F.when(kind.isin(*WORDED), own)
        .when((kind == "table") & F.lit(options.extract_tables), packed)
        .when((kind == "figure") & F.lit(options.extract_figures), F.coalesce(seen, F.lit("")))
    )
    # A model sees only the images that its gate lets through; the others reach it as nulls.
    figure = (kind == "figure") & F.lit(options.extract_figures)
    formula = (kind == "formula") & F.lit(options.extract_formulas)
    captioned = figure & F.lit(options.figure_captioning) & (ratio >= DEFAULTS.figure_caption_min_area_ratio)
    read = readable & (figure | needs_reading(kind, words, options))
    staged = found.withColumn("_seen", F.when(read, recognised_text(reader.lines(F.when(read, image)))))
    staged = staged.withColumn("_raw", raw).withColumn("_clean", text.nfkc(F.col("_raw"))).withColumns(
        {
            "table_data": F.when(
                kind == "table",
                F.transform(F.split("_clean", ROW_MARK, -1), lambda r: F.split(r, CELL_MARK, -1)),
            ),
            "caption": F.when(
                figure, F.when(captioned, captioner.caption(F.when(captioned, image))).otherwise("")
            ),
            "latex": F.when(
                formula, text.formula_source(formulas.latex(F.when(formula, image)))
            ),
        }
    )
    content = (
        F.when(kind.isin(*WORDED), F.col("_clean"))
        .when(kind == "table", F.when(F.col("_clean").isNotNull(), text.table_markdown(F.col("table_data"))))
        .when(kind == "figure", F.when(F.col("caption").isNotNull(), text.figure_marker(F.col("caption"), F.col("_clean"))))
        .when(kind == "formula", text.formula_marker(F.col("latex")))
    )
    return (
        staged.withColumn("content", F.nullif(content, F.lit("")))
        .withColumn("legend", F.when(kind == "figure", F.col("_clean")))
        .withColumnRenamed("kind", "type")
        .drop("_clean", "_raw", "_seen")
    )


def page_type(n: Column, headings: Column, texts: Column, tables: Column, figures: Column, toc: Column) -> Column:
    return (
        F.when(n == 0, "empty")
        .when(toc, "toc")
        .when(tables / n > DOMINANT_SHARE, "table")
        .when(figures / n > DOMINANT_SHARE, "chart")
        .when((n <= COVER_BLOCKS) & (headings >= 1) & (texts <= 1), "cover")
        .when(texts == n, "text")
        .otherwise("mixed")
    )


def pages(block_rows: DataFrame) -> DataFrame:
    """Content and metadata of each page. A page holds at most the capped number of blocks."""
    kept = F.col("content").isNotNull()
    kind = F.col("type")

    def count(name: str) -> Column:
        return F.count_if(kept & (kind == name))

    optional = [c for c in ("table_data", "caption", "legend", "latex") if c in block_rows.columns]
    one = F.struct("reading_order", "type", "content", *optional)
    grouped = block_rows.groupBy("doc_id", "page_number").agg(
        F.array_sort(F.collect_list(F.when(kept, one))).alias("blocks"),
        F.count_if(kept).alias("n_blocks"),
        count("heading").alias("n_headings"),
        count("text").alias("n_texts"),
        count("table").alias("n_tables"),
        count("figure").alias("n_figures"),
        count("formula").alias("n_formulas"),
        F.coalesce(
            F.bool_or(kept & (kind == "heading") & F.lower("content").contains(TOC_PHRASE)), F.lit(False)
        ).alias("_toc"),
        F.min_by("content", F.when(kept & (kind == "heading"), F.col("reading_order"))).alias("_heading"),
        F.min(F.when(kept & (kind == "heading"), 0)).alias("_any"),
    )
    content = text.strip(F.array_join(F.transform("blocks", lambda b: b["content"]), "\n\n"))

    def of(name: str, pick) -> Column:
        return F.transform(F.filter("blocks", lambda b: b["type"] == name), pick)

    out = grouped.withColumn("content", content).select(
        "doc_id",
        "page_number",
        "content",
        F.when(F.col("_any").isNotNull(), text.section_title(F.col("_heading"))).otherwise("").alias("section_title"),
        page_type(
            F.col("n_blocks"), F.col("n_headings"), F.col("n_texts"), F.col("n_tables"), F.col("n_figures"), F.col("_toc")
        ).alias("page_type"),
        text.language(F.col("content")).alias("language"),
        F.transform("blocks", lambda b: b["reading_order"]).alias("reading_order"),
        "blocks",
        "n_blocks",
        "n_headings",
        "n_texts",
        "n_tables",
        "n_figures",
        "n_formulas",
        *([of("table", lambda b: b["table_data"]).alias("tables")] if "table_data" in optional else []),
        *(
            [of("figure", lambda b: F.struct(b["caption"], b["legend"].alias("extracted_text"))).alias("figures")]
            if {"caption", "legend"} <= set(optional)
            else []
        ),
        *([of("formula", lambda b: b["latex"]).alias("formulas")] if "latex" in optional else []),
    )
    return out


def page_range(rows: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    if first is None and last is None:
        return rows
    low = F.lit(True) if first is None else F.col("page_number") >= first
    high = F.lit(True) if last is None else F.col("page_number") <= last
    return rows.where(low & high)


def documents(page_rows: DataFrame) -> DataFrame:
    return (
        page_rows.groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("page_count"),
            F.sort_array(F.collect_set("language")).alias("detected_languages"),
            F.bool_or(F.col("n_tables") > 0).alias("has_tables"),
            F.bool_or(F.col("n_figures") > 0).alias("has_figures"),
            F.bool_or(F.col("n_formulas") > 0).alias("has_formulas"),
        )
        .withColumn("language", document_language(F.col("detected_languages")))
    )


def document_language(detected: Column) -> Column:
    return F.coalesce(F.get(detected, F.lit(0)), F.lit("mixed"))


def flat_blocks(page_rows: DataFrame) -> DataFrame:
    """Blocks of all pages with one reading order per document.

    Unnumbered pages and blank blocks are skipped; a page with text but no blocks
    counts as one text block. Pages are counted and offset, then exploded. Both uses
    read ``page_rows``, so hand in a stored table when it was costly to make.
    """
    numbered = page_rows.where(F.coalesce("page_number", F.lit(0)) != 0)
    shaped = F.transform("blocks", lambda b: F.struct(b["type"], b["content"]))
    whole = F.array(F.struct(F.lit("text").alias("type"), "content"))
    worded = F.filter(
        F.when(F.size("blocks") > 0, shaped).otherwise(whole), lambda b: text.has_text(b["content"])
    )
    pages_now = numbered.select("doc_id", "page_number", worded.alias("_blocks"))
    sizes = pages_now.select("doc_id", "page_number", F.size("_blocks").cast("long").alias("n"))
    offsets = running_offsets(sizes, ["doc_id"], ["page_number"])
    rows = exploded(pages_now.join(offsets, ["doc_id", "page_number"]), F.col("_blocks"), "at", "b")
    return rows.select(
        "doc_id", "page_number", "b.type", "b.content", (F.col("offset") + F.col("at")).alias("reading_order")
    )
