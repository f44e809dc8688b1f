"""String functions on columns."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from lamplight.functions.memory import in_pieces

# The characters Unicode counts as white space when a string is stripped.
WHITESPACE = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The same characters one by one, for trimming.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)

# Language labels and the ratios that choose between them.
ARABIC_SHARE = 0.7
LATIN_SHARE = 0.1

TRUNCATED_TABLE = "\n| … truncated … |"
HEADING_JOIN = " — "
SHORTEN_MARK = " …"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def has_text(text: Column) -> Column:
    return F.coalesce(F.ltrim(text, F.lit(BLANKS)) != "", F.lit(False))


def squash(text: Column) -> Column:
    """One line: every run of white space becomes one space."""
    return F.regexp_replace(strip(text), rf"[{WHITESPACE}]+", " ")


def _nfkc(words: pa.Array) -> pa.Array:
    return pa.array((None if w is None else normalize("NFKC", w) for w in words.to_pylist()), type=pa.string())


def _nfkc_lists(lists: pa.Array) -> pa.Array:
    filled = lists.fill_null([])
    offsets = pc.subtract(filled.offsets, filled.offsets[0])
    return pa.ListArray.from_arrays(offsets, _nfkc(filled.flatten()), mask=lists.is_null())


def nfkc(text: Column) -> Column:
    """Compatibility normalisation. ASCII rows never leave the JVM as text."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.arrow_udf(_nfkc, "string")(F.when(foreign, text)), text)


def nfkc_all(texts: Column) -> Column:
    """Normalises every string of an array in one call."""
    foreign = F.exists(texts, lambda t: F.coalesce(t.rlike(r"[^\x00-\x7F]"), F.lit(False)))

    def rows(lists: pa.Array) -> pa.Array:
        return in_pieces(_nfkc_lists, lists)

    rows.__name__ = _nfkc_lists.__name__  # as plans show it
    return F.coalesce(F.arrow_udf(rows, "array<string>")(F.when(foreign, texts)), texts)


def language_from_counts(arabic: Column, latin: Column) -> Column:
    letters = arabic + latin
    share = arabic / letters
    return (
        F.when(F.coalesce(letters, F.lit(0)) == 0, "mixed")
        .when(share > ARABIC_SHARE, "ar")
        .when(share < LATIN_SHARE, "en")
        .otherwise("mixed")
    )


def _count(text: Column, letters: str) -> Column:
    """How many characters of a class: what goes missing when its runs are removed."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{letters}+", ""))


def arabic_letters(text: Column) -> Column:
    return _count(text, r"[\x{0600}-\x{06FF}]")


def latin_letters(text: Column) -> Column:
    return _count(text, "[A-Za-z]")


def language(text: Column) -> Column:
    return language_from_counts(arabic_letters(text), latin_letters(text))


def safe_filename(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore survive; the rest becomes ``_``."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")
    trimmed = F.regexp_replace(kept, r"\A_+|_+\z", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("document.pdf"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(.)\.[^.]*\z", "$1")


def object_key(prefix: str, *parts: Column) -> Column:
    pieces = F.array(F.lit(prefix), *parts)
    return F.replace(
        F.array_join(F.filter(pieces, lambda p: p != ""), "/"), F.lit("\\"), F.lit("/")
    )


def section_title(text: Column, limit: int | None = None) -> Column:
    title = strip(text)
    return title if limit is None else F.substring(title, 1, limit)


def table_cell(cell: Column) -> Column:
    flat = F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" "))
    return strip(F.replace(flat, F.lit("|"), F.lit("\\|")))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table_markdown(grid: Column, limit: int | None = None) -> Column:
    """A grid of strings as a Markdown table; the first row is the header.

    Only a caller that gives a ``limit`` gets longer tables cut, with a mark at their end.
    """

    def line(cells: Column, width: Column) -> Column:
        padded = F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells)))
        return F.concat(F.lit("| "), F.array_join(F.transform(padded, table_cell), " | "), F.lit(" |"))

    def body(width: Column) -> Column:
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        return F.array_join(
            F.transform(
                grid,
                lambda row, n: F.when(n == 0, F.concat(line(row, width), F.lit("\n"), rule)).otherwise(line(row, width)),
            ),
            "\n",
        )

    def cut(whole: Column) -> Column:
        if limit is None:
            return whole
        short = F.concat(F.substring(whole, 1, limit), F.lit(TRUNCATED_TABLE))
        return F.when(F.length(whole) > limit, short).otherwise(whole)

    width = F.array_max(F.transform(grid, lambda row: F.size(row)))
    empty = F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0)) <= 0
    return F.when(empty, "").otherwise(let(let(width, body), cut))


def figure_marker(caption: Column, legend: Column) -> Column:
    caption, legend = F.coalesce(caption, F.lit("")), F.coalesce(legend, F.lit(""))
    head = F.when(caption != "", F.concat(F.lit("[Figure: "), caption, F.lit("]"))).otherwise("[Figure]")
    return F.when(legend != "", F.concat(head, F.lit("\n"), legend)).otherwise(head)


def formula_source(latex: Column) -> Column:
    """Model output without its own dollar fences; empty output means no formula."""
    body = strip(latex)
    fenced = body.startswith("$") & body.endswith("$")
    return F.when(fenced, strip(F.regexp_replace(body, r"\A\$+|\$+\z", ""))).otherwise(body)


def formula_marker(latex: Column, limit: int | None = None) -> Column:
    body = formula_source(latex)
    return F.when(
        F.coalesce(body, F.lit("")) != "",
        F.concat(F.lit("$$ "), body if limit is None else F.substring(body, 1, limit), F.lit(" $$")),
    )


def blockquote(text: Column) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    lines = F.transform(
        F.split(body, "\n", -1),
        lambda line: F.when(line != "", F.concat(F.lit("> "), line)).otherwise(">"),
    )
    return F.when(body == "", "").otherwise(F.array_join(lines, "\n"))


def shorten(text: Column, width: int) -> Column:
    """Cut a squashed text to ``width`` at a word boundary, marking the cut.

    A break may also follow a hyphen between two letters, as in line wrapping.
    """
    line = squash(text)
    room = width - len(SHORTEN_MARK)
    head = F.regexp_extract(
        line, rf"(?s)\A(.{{0,{room - 1}}}(?:[^ ](?= )|(?<=[\p{{L}}_])-(?=[\p{{L}}_]{{2}})))", 1
    )
    cut = F.when(head == "", F.lit(SHORTEN_MARK.strip())).otherwise(F.concat(head, F.lit(SHORTEN_MARK)))
    return F.when(F.length(line) <= width, line).otherwise(cut)


def key_values(items: Column) -> Column:
    """``key=value`` strings as a map; the first ``=`` splits, later keys win.

    Yields null when an item has no ``=`` or an empty key, which callers reject.
    """
    bad = F.exists(items, lambda x: ~x.contains("=") | ~has_text(F.substring_index(x, "=", 1)))
    keys = F.transform(items, lambda x: strip(F.substring_index(x, "=", 1)))
    values = F.transform(items, lambda x: F.regexp_replace(x, r"(?s)\A[^=]*=", ""))
    last = F.filter(
        F.arrays_zip(keys.alias("key"), values.alias("value"), F.sequence(F.lit(1), F.size(items)).alias("at")),
        lambda e: F.array_position(F.reverse(keys), e["key"]) == F.size(keys) - e["at"] + 1,
    )
    return F.when(
        ~bad,
        F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))),
    )


# Connection-string keys and the names they become.
CONNECTION_KEYS = {
    "host": "host",
    "server": "host",
    "port": "port",
    "database": "dbname",
    "username": "user",
    "user id": "user",
    "password": "password",
    "ssl mode": "sslmode",
    "sslmode": "sslmode",
}


def connection_keywords(url: Column) -> Column:
    """Turn ``Key=Value;`` connection strings into ``key=value`` keyword form."""
    url = strip(url)
    names = F.create_map(*[F.lit(x) for pair in CONNECTION_KEYS.items() for x in pair])

    def entry(part: Column) -> Column:
        name = F.element_at(names, F.lower(strip(F.substring_index(part, "=", 1))))
        value = strip(F.regexp_replace(part, r"(?s)\A[^=]*=", ""))
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        quoted = F.when(value.rlike(r"[ '\\]"), F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(value)
        return F.when(part.contains("="), F.concat(name, F.lit("="), quoted))

    parts = F.filter(F.transform(F.split(url, ";"), entry), lambda p: p.isNotNull())
    semicolons = url.contains("=") & url.contains(";") & ~url.rlike(r"\A(postgres|postgresql)://")
    return F.when(semicolons, F.array_join(parts, " ")).otherwise(url)
