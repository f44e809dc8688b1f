"""Documents to layout items and blocks, inside the row that holds the document.

HTML pages and plain texts are read here, PDF files in ``pdf``; any other extractor
plugs in as a provider that yields the same array of items.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from lamplight import schemas
from lamplight.functions import text
from lamplight.operators.layout import item_kind
from lamplight.operators.rows import exploded
from lamplight.settings import ExtractOptions

# Page length of sources that have no pages of their own.
HTML_PAGE_ITEMS = 8
TEXT_PAGE_LINES = 40

# How a line of plain text is told to be a heading.
HEADING_MAX_CHARS = 60

# Parts of a web page that are not content, element classes, entities.
NOISE = (
    r"(?is)<!--.*?-->|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>"
    r"|<nav\b.*?</nav>|<div class=.ad.>.*?</div>"
)
OPENERS = r"(?i)<(h1|h2|h3|h4|h5|h6|p|li|pre|footer)(?:\s[^>]*)?>"
CLOSERS = r"(?i)</?(?:h1|h2|h3|h4|h5|h6|p|li|pre|footer|article|section|div|body|html|ul|ol)(?:\s[^>]*)?>"
ELEMENT_CLASSES = {
    "h1": "TitleItem",
    "h2": "SectionHeaderItem",
    "h3": "SectionHeaderItem",
    "h4": "SectionHeaderItem",
    "h5": "SectionHeaderItem",
    "h6": "SectionHeaderItem",
    "p": "TextItem",
    "li": "ListItem",
    "pre": "CodeItem",
    "footer": "FootnoteItem",
}
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}

RECORD, UNIT = "\x1e", "\x1f"


class Extractor(Protocol):
    """Binary document to array<struct<class_name, text, page_number>> plus its tag."""

    tag: str

    def items(self, content: Column) -> Column: ...


def html_items(html: Column) -> Column:
    """Content elements of a page in order: array<struct<class_name, text, page_number>>.

    An element runs to the next element's start or end tag, so unclosed paragraphs
    end where the next one begins.
    """
    body = F.regexp_replace(html, NOISE, " ")
    body = F.regexp_replace(body, OPENERS, f"{RECORD}$1{UNIT}")
    body = F.regexp_replace(body, CLOSERS, RECORD)
    names = F.create_map(*[F.lit(x) for pair in ELEMENT_CLASSES.items() for x in pair])

    def item(part: Column) -> Column:
        words = F.regexp_replace(F.substring_index(part, UNIT, -1), r"<[^>]*>", "")
        for entity, char in ENTITIES.items():
            words = F.replace(words, F.lit(entity), F.lit(char))
        tag = F.lower(F.substring_index(part, UNIT, 1))
        return F.struct(F.element_at(names, tag).alias("class_name"), text.strip(words).alias("text"))

    parts = F.filter(F.split(body, RECORD, -1), lambda p: p.contains(UNIT))
    return F.transform(
        F.transform(parts, item),
        lambda x, n: F.struct(
            x["class_name"],
            x["text"],
            (F.floor(n / HTML_PAGE_ITEMS) + 1).cast("int").alias("page_number"),
        ),
    )


def text_items(body: Column) -> Column:
    """Non-blank lines of a plain text as items; a short line without a full stop is a heading."""
    lines = F.transform(F.filter(F.split(body, "\n", -1), text.has_text), text.strip)
    heading = lambda x: (F.length(x) < HEADING_MAX_CHARS) & ~x.endswith(".")
    return F.transform(
        lines,
        lambda x, n: F.struct(
            F.when(heading(x), "SectionHeaderItem").otherwise("TextItem").alias("class_name"),
            x.alias("text"),
            (F.floor(n / TEXT_PAGE_LINES) + 1).cast("int").alias("page_number"),
        ),
    )


def item_rows(docs: DataFrame, items: Column) -> DataFrame:
    """One row per item with its sequence number in the document."""
    return exploded(docs, items, "seq", "_item").select(
        *docs.columns, "seq", "_item.class_name", "_item.text", "_item.page_number"
    )


def wanted_items(items: Column, options: ExtractOptions) -> Column:
    """Items without the kinds that the options turn off."""
    switches = {
        "table": options.extract_tables, "figure": options.extract_figures, "formula": options.extract_formulas
    }
    off = [kind for kind, on in switches.items() if not on]
    return F.filter(items, lambda x: ~F.coalesce(item_kind(x["class_name"]).isin(off), F.lit(False))) if off else items


def with_blocks(docs: DataFrame, items: Column, boxed: bool = False) -> DataFrame:
    """``docs`` plus ``blocks``: worded, normalised items as the array the packer takes, with the items' boxes if ``boxed``.

    Everything an element needs is zipped to it: an expression captured by a lambda
    would be computed again for every element.
    """
    known = F.filter(
        items, lambda x: item_kind(x["class_name"]).isNotNull() & x["page_number"].isNotNull()
    )
    staged = docs.withColumn("_known", known)
    texts = text.nfkc_all(F.transform("_known", lambda x: x["text"]))
    zipped = F.arrays_zip(F.col("_known").alias("item"), texts.alias("words"))

    def block(z: Column, n: Column) -> Column:
        page = z["item"]["page_number"]
        kept = page.isNotNull() & text.has_text(z["words"])
        return F.when(
            kept,
            F.struct(
                item_kind(z["item"]["class_name"]).alias("type"),
                z["words"].alias("content"),
                n.alias("reading_order"),
                page.alias("page_number"),
                (z["item"]["bbox"] if boxed else F.lit(None)).cast(schemas.BOX).alias("bbox"),
            ),
        )

    blocks = F.filter(F.transform(zipped, block), lambda b: b.isNotNull())
    return staged.withColumn("blocks", blocks).drop("_known")


def languages_of_blocks(blocks: Column) -> Column:
    """Sorted distinct page languages of a block array, folded page by page."""
    label = text.language_from_counts
    start = F.struct(
        F.lit(None).cast("int").alias("page"),
        F.lit(0).alias("arabic"),
        F.lit(0).alias("latin"),
        F.array().cast("array<string>").alias("seen"),
    )

    def step(state: Column, b: Column) -> Column:
        turn = b["page_number"] != state["page"]
        arabic, latin = text.arabic_letters(b["content"]), text.latin_letters(b["content"])
        closed = F.array_union(state["seen"], F.array(label(state["arabic"], state["latin"])))
        return F.struct(
            b["page_number"].alias("page"),
            F.when(turn, arabic).otherwise(state["arabic"] + arabic).alias("arabic"),
            F.when(turn, latin).otherwise(state["latin"] + latin).alias("latin"),
            F.when(turn, closed).otherwise(state["seen"]).alias("seen"),
        )

    def finish(state: Column) -> Column:
        last = F.array(label(state["arabic"], state["latin"]))
        return F.sort_array(
            F.when(state["page"].isNull(), F.array().cast("array<string>")).otherwise(
                F.array_union(state["seen"], last)
            )
        )

    return F.aggregate(blocks, start, step, finish)
