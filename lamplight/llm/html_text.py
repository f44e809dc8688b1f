"""Main text of a page as its maximum-scoring run of words and tags.

A page is read as a sequence of tags and words. Words score positive where articles have them and negative elsewhere,
tags never score positive; the weights are log-odds counted on labelled pages. A linear scan finds the contiguous run
of the highest sum, and its blocks, without menus, forms, adverts and the like, are the text.

A page labels itself where it marks its article with the ``article`` element: what lies inside is content, what lies
outside is not. Training looks at a sample of pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lamplight.llm.tables import sampled, text_of

SAMPLE = 1_000
#: What a tag costs at least; and at most inside an article, so that lists and links do not end it.
LIGHT, INSIDE = -0.02, -1.0

# Element names of HTML, and usual class and id words of what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
OUT = frozenset(
    "aside audio button canvas dialog footer form head header iframe math menu nav noscript object script select style svg"
    " template textarea title video".split()
)
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies"
    " consent disqus footer form header login masthead menu nav navbar navigation newsletter notice pagination popup promo"
    " promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " toolbar widget".split()
)
OUT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTAINERS = frozenset("article main".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z|[^<]+|<",
    re.S,
)
_NO_TEXT = re.compile("<[!?a-zA-Z]|</[a-zA-Z]")  # comments, declarations and tags that the page's end cuts off
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _is_out(name: str, marks: str) -> bool:
    if name in OUT:
        return True
    if not marks or name in ("html", "body", "article", "main"):
        return False
    for m in _MARK.finditer(marks):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in OUT_ROLES):
            return True
        if key in ("class", "id") and not OUT_WORDS.isdisjoint(_PART.findall(value)):
            return True
    return False


def pieces(page: str):
    """(kind, value, inside, out) for each tag and text: kind "tag" with its name, "text" with the raw text.

    ``inside``: the nearest open article or main element, or an empty string. ``out``: whether an open element
    is none of the article. Elements left open end with the element around them; stray end tags are passed over.
    """
    stack: list[tuple[str, bool]] = []
    outs = 0
    holders: list[str] = []
    at, size = 0, len(page)
    while at < size:
        m = _PIECE.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if not _NO_TEXT.match(piece):
                yield "text", piece, holders[-1] if holders else "", outs > 0
            continue
        name, closing, marks = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if any(open_name == name for open_name, _ in stack):
                while stack:
                    open_name, out = stack.pop()
                    outs -= out
                    if open_name in CONTAINERS:
                        holders.pop()
                    if open_name == name:
                        break
            yield "tag", name, holders[-1] if holders else "", outs > 0
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            yield "tag", name, holders[-1] if holders else "", outs > 0
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            outs -= stack.pop()[1]
        if name == "li" and stack and stack[-1][0] == "li":
            outs -= stack.pop()[1]
        if name == "body":  # a head left open ends here
            while stack and stack[-1][0] == "head":
                outs -= stack.pop()[1]
        if name not in VOID and not marks.endswith("/"):
            out = _is_out(name, marks)
            stack.append((name, out))
            outs += out
            if name in CONTAINERS:
                holders.append(name)
        yield "tag", name, holders[-1] if holders else "", outs > 0


@dataclass(frozen=True)
class Weights:
    """Scores: of a word by the element that holds it, of a tag by its name."""

    words: dict[str, float]
    tags: dict[str, float]
    other_tag: float = -0.5


#: Without labelled pages.
PLAIN = Weights({"article": 2.0, "main": 2.0, "": 1.0}, {"p": -0.02, "br": -0.02})


def count(page: str) -> Counter:
    """Of a labelled page: tags and words inside (True) and outside its article element."""
    seen: Counter = Counter()
    for kind, value, inside, out in pieces(page):
        content = inside == "article" and not out
        if kind == "tag":
            seen["tag", value, content] += 1
        else:
            seen["word", inside, content] += len(value.split())
    return seen


def weigh(seen: Counter) -> Weights:
    odds = lambda kind, name: math.log((seen[kind, name, True] + 0.5) / (seen[kind, name, False] + 0.5))
    tags = {name for kind, name, _ in seen if kind == "tag"}
    article = max(0.5, odds("word", "article"))
    return Weights(
        {"article": article, "main": article, "": min(-0.5, odds("word", ""))},
        {name: max(-3.0, min(LIGHT, odds("tag", name))) for name in tags},
    )


def extract(page: str | None, weights: Weights = PLAIN) -> str:
    """The main text: blocks in page order, joined by line breaks; empty if there is none.

    In a page without article or main element every word outside the out elements scores the same, one.
    """
    if not page:
        return ""
    parts = list(pieces(page))
    marked = any(inside for _, _, inside, _ in parts)
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, value, inside, out) in enumerate(parts):
        if kind == "tag":
            cost = weights.tags.get(value, weights.other_tag)
            total += cost if not inside else LIGHT if out else max(cost, INSIDE)
        elif not out:
            words = len(value.split())
            total += words * (weights.words[inside] if marked else 1.0)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_from, best_to = total, start, i + 1
    blocks, block = [], []

    def end():
        text = " ".join(html.unescape("".join(block)).split())
        if text:
            blocks.append(text)
        block.clear()

    for kind, value, inside, out in parts[best_from:best_to]:
        if kind == "text":
            if not out and (inside or not marked):
                block.append(value)
        elif value in BLOCKS:
            end()
        elif value == "br":
            block.append(" ")
    end()
    return "\n".join(blocks)


def train(pages: DataFrame, page: str = "html", id: str = "page_id", sample: int = SAMPLE) -> Weights:
    """Weights from those of about ``sample`` pages (by a hash of the id) that have an article element; ``PLAIN`` if
    there are none."""

    @pandas_udf("array<struct<kind:string,name:string,content:boolean,n:long>>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "name": v, "content": c, "n": n} for (k, v, c), n in count(t).items()] for t in texts])

    body = F.col(page)
    chosen = sampled(pages, sample, id).filter(body.contains("<article"))
    rows = chosen.select(F.explode(counted(body)).alias("c")).groupBy("c.kind", "c.name", "c.content").agg(F.sum("c.n").alias("n"))
    seen = Counter({(r.kind, r.name, r.content): r.n for r in rows.collect()})
    return weigh(seen) if seen else PLAIN


def main_text(weights: Weights, page: str | Column = "html") -> Column:
    """The main text of each page; empty for null and empty pages and where no run scores above zero."""
    fixed = weights

    @pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, fixed) for p in pages])

    return text(text_of(page))
