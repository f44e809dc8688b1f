"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression. Offsets are code points, the end exclusive. A pattern's matches are leftmost and do
not overlap within a kind; a match that fails its check is dropped and not tried again. Spans of different kinds may
overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamplight.llm.tables import text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

#: Run-first starts and possessive loops match the same strings as the plain forms, in time linear in the text: a match
#: that fails at the start of a run of its first class fails everywhere in that run. ``\G`` is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: A text without this has no match of the kind.
NEEDED = {"email": "@", "phone": "+"}

_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: Score before and after a word of the kind within CONTEXT characters before the span.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
LIFT = 0.2
CONTEXT = 40
CONTEXT_WORDS = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security",
}
#: Spans beside the base ones need this much.
LEAST_SCORE = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum: every second digit from the right counts double."""
    numbers = F.split(F.reverse(digits), "")
    weighed = F.transform(
        F.filter(numbers, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number leaves 1: first four characters moved to the end, letters as 10 to 35, modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


#: Length of the pieces that a text is cut into, so that a look at some place of it does not start at its first character.
PIECE = 256


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often its lambdas look at it."""
    return F.get(F.transform(F.array(value), use), 0)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, from the pieces that hold it."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((end - 1) / PIECE).cast("int") - first + 1
    held = F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end > start, held.substr(start - first * PIECE + 1, end - start)).otherwise("")


def _running(values: Column, add) -> Column:
    """Of each place the fold of all whole numbers before it (0 at first). Blocks of about the root of the number of values
    are folded, then the places within each, so that no long array is copied for every value."""
    chain = lambda first, more: F.aggregate(
        more, F.array(first), lambda s, v: F.concat(s, F.array(add(F.element_at(s, -1), v)))
    )

    def blocks_of(all_values):
        width = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        last = F.floor((F.size(all_values) - 1) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_values, i * width + 1, width))

    def placed(blocks):
        heads = chain(F.lit(0), F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add)))
        pairs = F.arrays_zip(F.slice(heads, 1, F.size(blocks)).alias("head"), blocks.alias("block"))
        return F.flatten(F.transform(pairs, lambda p: F.slice(chain(p["head"], p["block"]), 1, F.size(p["block"]))))

    return F.when(F.size(values) > 0, _let(_let(values, blocks_of), placed)).otherwise(F.array().cast("array<int>"))


def find(df: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """``df`` with ``to``: array of (start, rank, end, kind, score) by start and then kind as listed in ``KINDS``.

    Null and empty texts have no spans. Base kinds always stay; the others need ``LEAST_SCORE``. A column ``to`` in
    ``df`` is a ValueError; working columns carry the name of ``to`` before them.
    """
    hidden = [f"{to}__{kind}" for kind in KINDS]
    if taken := {to, *hidden} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    body, none = text_of(text), F.array().cast("array<string>")
    digit = body.rlike("[0-9]")
    seen = df.withColumns(
        {
            name: F.when(
                body.contains(NEEDED[kind]) if kind in NEEDED else digit,
                F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0)),
            ).otherwise(none)
            for kind, name in zip(KINDS, hidden)
        }
    )
    spans = F.concat(*[_placed(body, kind, F.col(name), none) for kind, name in zip(KINDS, hidden)])
    return seen.withColumn(to, F.array_sort(spans)).drop(*hidden)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _placed(body: Column, kind: str, matches: Column, none: Column) -> Column:
    """The spans of the matches that hold: the texts between the matches give the offsets."""
    between = F.when(F.size(matches) > 0, F.split(body, PATTERNS[kind], -1)).otherwise(none)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("hit"))
    empty = F.array().cast(f"array<{_SPAN}>")

    def span(pieces, start, gap, hit):
        start = start + F.length(gap)
        near = F.lower(_between(pieces, F.greatest(start - CONTEXT, F.lit(0)), start)).rlike(CONTEXT_WORDS[kind])
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(hit)).alias("end"),
            F.lit(kind).alias("kind"), (F.lit(SCORES[kind]) + F.when(near, LIFT).otherwise(0.0)).alias("score"),
        )

    def spans(found):
        lengths = F.transform(found, lambda p: F.length(p["gap"]) + F.length(p["hit"]))
        rows = F.arrays_zip(found["gap"].alias("gap"), found["hit"].alias("hit"), _running(lengths, lambda a, b: a + b).alias("before"))
        held = F.filter(rows, lambda p: _holds(kind, p["hit"]))
        out = _let(_pieces(body), lambda pieces: F.transform(held, lambda p: span(pieces, p["before"], p["gap"], p["hit"])))
        return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)

    return F.when(F.size(matches) > 0, _let(pairs, spans)).otherwise(empty)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(df: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """``df`` with every span of at least that score replaced by its kind in angle brackets.

    Of overlapping spans the first names the replacement, and all of their characters go. Null texts stay null.
    """
    hidden = f"{text}__spans"
    found = find(df, text, hidden)
    body = F.col(text)

    def step(pieces, span, at):
        kept = _between(pieces, at, span["start"])
        return F.when(span["start"] >= at, F.concat(kept, F.lit("<"), span["kind"], F.lit(">"))).otherwise("")

    def sweep(pieces, spans):
        ends = F.transform(spans, lambda s: s["end"])
        rows = F.arrays_zip(spans.alias("span"), _running(ends, lambda a, b: F.greatest(a, b)).alias("at"))
        swept = F.array_join(F.transform(rows, lambda r: step(pieces, r["span"], r["at"])), "")
        return F.concat(swept, _between(pieces, F.array_max(ends), F.length(body)))

    chosen = F.filter(F.col(hidden), lambda s: s["score"] >= least)
    whole = _let(_pieces(body), lambda pieces: _let(chosen, lambda spans: sweep(pieces, spans)))
    swept = F.when(F.size(chosen) > 0, whole).otherwise(body)
    return found.withColumn(text, swept).select(*df.columns)
