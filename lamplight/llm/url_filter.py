"""URL filters: a blocked Bloom filter lets possible hits through to an exact hash join.

A list holds rules (a host with all its subdomains, and what the path starts with) and canonical URLs. Their keys set
bits in a blocked Bloom filter: a key touches eight bits of one block of 256, so a probe reads one row of the filter.
Each URL probes its own canonical form and those cuts of its host and path whose lengths some rule has; what the filter
lets through meets the list in an exact hash join, which takes false hits out. Of the rules that fit the longest wins,
and a rule outweighs a listed URL.

Only DataFrame functions are used. Keys are never gathered: the filter is a table of blocks, sent to all tasks while it
is small by count and met by an equi-join on the block's number beyond that; so is the list, measured in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamplight.llm.bloom import bits, blocks_for, filter_of

#: A filter of more blocks (2 MB of bits), or a list of more bytes of keys, is not broadcast.
MOST_BLOCKS, MOST_BYTES = 1 << 16, 4 << 20
#: Query parameters that only track where a visit came from.
TRACKING = "utm_[^=]*|ref|fbclid|gclid"
#: First host labels under which a site shows the same pages.
ALIASES = "www|m"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(url: str | Column, number: int) -> Column:
    column = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(column.cast("string"), _PARTS, number), F.lit(""))


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty without ``://``."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def canonical(url: str | Column) -> Column:
    """Host without alias label and default port, path without a slash at its end, and the sorted query without tracking
    parameters; scheme and fragment are dropped. Null for a URL without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)?$", ""), rf"^({ALIASES})\.", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    told = F.filter(F.split(_part(url, 3), "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)"))
    query = F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(told), "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def possible(probes: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows of ``probes`` whose ``key`` may be one of the ``count`` ``keys``; every one that is, is among them."""
    blocks = blocks_for(count)
    held = filter_of(keys, blocks)
    held = F.broadcast(held) if blocks <= MOST_BLOCKS else held
    block, *words = bits("key", blocks)
    met = probes.withColumns({"block": block, **{f"w{i}": w for i, w in enumerate(words)}}).join(held, "block")
    hit = F.expr(" AND ".join(f"(held{w} & w{w}) = w{w}" for w in range(4)))
    return met.filter(hit).select(*probes.columns)


def _listing(rules: DataFrame, listed: DataFrame | None, verdict: str) -> DataFrame:
    """(key, best): one row for each rule and listed URL; ``best`` orders what fits one URL, the greatest wins."""
    host, path = F.translate(F.col("host"), _UPPER, _LOWER), F.coalesce(F.col("path"), F.lit(""))
    rule = F.concat(host, path)

    def best(by_rule, size, width, name, said):
        blocks = (said == "block").cast("int")
        return F.struct(
            F.lit(by_rule).alias("by_rule"), size.alias("size"), width.alias("width"), blocks.alias("blocks"),
            name.cast("string").alias("rule"), said.alias("verdict"),
        )

    own = rules.filter("host is not null AND host <> '' AND verdict IN ('allow', 'block')")
    keys = own.select(
        F.concat(F.lit("r "), rule).alias("key"), best(1, F.length(rule), F.length(host), rule, F.col("verdict")).alias("best")
    )
    if listed is not None:
        zero = F.lit(0)
        urls = listed.select(canonical(F.col("url")).alias("url")).filter("url is not null")
        keys = keys.unionByName(
            urls.select(F.concat(F.lit("u "), "url").alias("key"), best(0, zero, zero, F.lit(None), F.lit(verdict)).alias("best"))
        )
    return keys.groupBy("key").agg(F.max("best").alias("best"))


def _probes(df: DataFrame, url: str, shapes: list[tuple[int, int]]) -> DataFrame:
    """(url, key): a URL's canonical form, and each cut of host and path whose lengths some rule has."""
    host, path = F.col("host"), F.col("path")
    cuts = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in shapes] or [F.struct(F.lit(-1).alias("h"), F.lit(-1).alias("p"))])
    at_label = lambda s: (s["h"] == F.length(host)) | (F.substring(host, F.length(host) - s["h"], F.lit(1)) == ".")
    fits = F.filter(
        cuts, lambda s: (s["h"] > 0) & (s["h"] <= F.length(host)) & (s["p"] <= F.length(path)) & at_label(s)
    )
    keys = F.transform(
        fits, lambda s: F.concat(F.lit("r "), F.substring(host, F.length(host) - s["h"] + 1, s["h"]), F.substring(path, F.lit(1), s["p"]))
    )
    whole = F.array_compact(F.array(F.concat(F.lit("u "), canonical(F.col("url")))))
    parts = df.select(F.col(url).cast("string").alias("url")).withColumns({"host": host_of("url"), "path": path_of("url")})
    return parts.select("url", F.explode(F.concat(keys, whole)).alias("key"))


def judge(
    df: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url", verdict: str = "block", to: str = "judged"
) -> DataFrame:
    """``df`` with a struct ``to`` of ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` of each URL.

    ``rules`` are (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's; the
    longest wins, of equally long ones that of the longer host. Rules with a null or empty host or another verdict
    than allow or block are passed over, a null path is empty, and of the same rule with both verdicts block wins.
    ``listed`` is (url): these get ``verdict`` where no rule fits, compared in canonical form; all others are allowed. A
    null URL, or one without ``://``, has an empty host and path and is allowed. Rows are kept as they are, repeated
    ones too; a column named as ``to`` is replaced, other columns do not matter. Empty lists and tables are allowed.

    The URL is the key of one join: hand in what you need besides it, not whole pages.
    """
    if verdict not in ("allow", "block"):
        raise ValueError("verdict is allow or block")
    keys = _listing(rules, listed, verdict)
    count, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    # Lengths, not rules: at most the longest host times the longest path of them.
    shape = F.struct(F.col("best.width").alias("h"), (F.col("best.size") - F.col("best.width")).alias("p"))
    shapes = [tuple(s) for s in keys.filter("best.by_rule = 1").select(shape.alias("s")).distinct().select("s.*").collect()]
    held = F.broadcast(keys) if size + 64 * count <= MOST_BYTES else keys.hint("shuffle_hash")
    hits = possible(_probes(df, url, sorted(shapes)), keys, count).join(held, "key")
    best = hits.groupBy("url").agg(F.max("best").alias("best")).select(F.col("url").alias("url__key"), F.col("best").alias("url__best"))
    met = df.join(best, df[url].cast("string") == best["url__key"], "left")
    told = F.struct(
        host_of(df[url]).alias("host"), path_of(df[url]).alias("path"), best["url__best"]["rule"].alias("rule"),
        F.coalesce(best["url__best"]["verdict"], F.lit("allow")).alias("verdict"),
    )
    return met.select(*[df[c] for c in df.columns if c != to], told.alias(to))
