"""Near copies by exact Jaccard similarity of five-word shingles; no pair at or above the bound is missed.

Words are those of ``simhash``. Texts of equal shingle sets are one class. Two sets with a similarity of 0.8 share, under
any one order of all shingles, an element among the first ``n - ceil(0.8 n) + 1`` of each (prefix filter), so only these
are met. The order puts shingles that many texts of a sample have last, to keep common lines out of the prefixes;
it decides how much is compared, never what is found.

SimHash gives the first candidates: classes whose ``simhash`` fingerprints differ in three bits at most are verified and, where
they reach the bound, contracted. The prefix filter then meets only what still lies in different components, so that
pairs at the bound whose fingerprints lie further apart are found too.

Of a text only its fingerprint, the number of its shingles, its prefix and a sketch are stored. Prefix shingles of one class alone are
dropped before anything is joined: a Bloom filter passes those that classes share, a semi-join makes it exact.

A sketch has a bit for each shingle, three bits a shingle on average. What is set in one sketch and not in another is of shingles that
the other does not have, so two sketches bound from above what their sets share; pairs that cannot reach the bound, nearly
all, go by that. Shingle sets are made again for one text of each class of the pairs left, and for no others: a Bloom filter of
ids tells these texts where they lie. Where many pairs are left they are taken in turns, so that what is moved at a time stays a
share of the input.

A shingle many classes share gives no pairs of all with all: each class is held against the least and the greatest of
them, found links are contracted, and this is repeated with other ends for what still lies in different components. When
that links nothing more, or little is left, the pairs left across components that size and position of the shared
shingle allow are verified, in blocks of bounded size.

Tables of a step are written to the shared folder and deleted when the steps that read them are done.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lamplight.llm import simhash
from lamplight.llm.bloom import marked
from lamplight.llm.components import components
from lamplight.llm.simhash import _GAP, _LOWER
from lamplight.llm.tables import Scratch, release, sampled, text_of, turn_to, unsent

WIDTH = 5
#: The bound of the similarity as a fraction, so that all tests are on whole numbers.
OVER, UNDER = 4, 5
#: Texts whose shingles are counted to order shingles, and how many of the most common of these are put last.
SAMPLE, MOST_COMMON = 8_192, 1 << 16
#: Pairs across components, for each class in them, that are verified without another round of ends.
FEW = 8
#: Classes of one shingle that meet in one task.
BLOCK = 512

#: Pairs that are held against each other by their sets at a time: one for so many classes, or so many where these are few.
CLASSES_A_PAIR, LEAST_PAIRS = 8, 16_384

#: Shingles of a pair that 32 bits may make equal by chance.
CHANCE = 3

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEED = 42


def shingles_of(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending. Fewer words are one shingle, no words are none."""
    words = [w for w in _GAP.split((text or "").translate(_LOWER)) if w]
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, _SEED) for w in words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    grams = np.full(len(words) - width + 1, width, np.uint64)
    for at in range(width):
        grams = grams * _FACTOR + hashes[at : at + len(grams)]
    return np.unique(grams)


def class_of(grams: np.ndarray) -> int:
    """A hash of the set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), _SEED)).view(np.int64))


def _common(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three texts or more of about ``sample`` have, ascending, and in how many: the most common of these."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to()
        for part in parts:
            held = [shingles_of(t) for t in part["text"]]
            key, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), [])
            yield pd.DataFrame({"key": key.view(np.int64), "n": n})
        release()

    some = sampled(docs, sample, "id", "text").select("text").mapInPandas(counted, "key long, n long")
    often = some.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()
    key = often["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], often["n"].to_numpy(np.int64)[order]


def _prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    n = len(grams)
    keys, counts = common
    crowd = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        crowd = np.where(keys[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, crowd))[: n + (-OVER * n // UNDER) + 1]]


def _sketch(grams: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its lower bits: of two to four times as many bits as shingles, a power of two, 64 at least."""
    longs = 1 << max(0, (2 * len(grams) - 1).bit_length() - 6)
    held = np.zeros(64 * longs, np.uint8)
    held[grams & np.uint64(64 * longs - 1)] = 1
    return np.packbits(held, bitorder="little").view(np.int64)


def _read(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, node, n, fp, keys, bits) of each row of (id, text): its class, the number of its shingles, its SimHash fingerprint, its
    prefix in order, its sketch.

    A class that comes again in a partition has fingerprint, prefix and sketch left out, as a text without words has.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to()
        seen = set()
        for part in parts:
            nodes, sizes, prints, keys, bits = [], [], [], [], []
            for text in part["text"]:
                grams = shingles_of(text)
                nodes.append(class_of(grams))
                sizes.append(len(grams))
                fresh = len(grams) and nodes[-1] not in seen
                prints.append(int(np.uint64(simhash.fingerprint_of(text)).view(np.int64)) if fresh else None)
                keys.append(_prefix(grams, common).view(np.int64) if fresh else [])
                bits.append(_sketch(grams) if fresh else None)
                seen.add(nodes[-1])
            read = {"id": part["id"], "node": nodes, "n": sizes, "fp": pd.array(prints, "Int64"), "keys": keys}
            yield pd.DataFrame(read | {"bits": pd.Series(bits, index=part.index, dtype=object)})
        release()

    id = docs.schema["id"].dataType.simpleString()
    return docs.mapInPandas(cut, f"id {id}, node long, n long, fp long, keys array<long>, bits array<long>")


def _alike(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct pairs (a, b) of classes that SimHash finds: each class of a fingerprint with the least one of it, and the
    least ones of linked fingerprints."""
    prints = scratch.keep(rows.filter("fp IS NOT NULL").select("node", "fp").distinct())
    heads = scratch.keep(prints.groupBy("fp").agg(F.min("node").alias("head")))
    near = scratch.keep(simhash.links(heads.select("fp")))
    same = prints.join(unsent(heads), "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    left, right = (unsent(heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}__head"))) for c in "ab")
    other = near.join(left, "a").join(right, "b").select(F.col("a__head").alias("a"), F.col("b__head").alias("b"))
    both = same.unionByName(other).filter("a <> b")
    found = scratch.keep(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop(prints, heads, near)
    return found


def _groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n, rest): the prefix shingles that several classes share, with how many come after in each."""
    keys = rows.select("node", "n", F.posexplode("keys").alias("at", "key"))
    keys = keys.select("key", "node", "n", (F.col("n") - 1 - F.col("at")).alias("rest"))
    ends = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = scratch.keep(ends.filter("low < high").select("key"))
    some = marked(keys, shared, shared.count(), "maybe").filter("maybe").drop("maybe")
    groups = scratch.keep(some.join(unsent(shared), "key", "left_semi").distinct())
    scratch.drop(shared)
    return groups


def _homes(rows: DataFrame) -> DataFrame:
    """(node, home, n, bits): of each class the hash of the id of one of its texts, the number of its shingles, its sketch."""
    same = (F.max("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    return rows.groupBy("node").agg(F.min(F.xxhash64("id")).alias("home"), *same)


def _asked(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """The texts whose ids may be the homes of ``nodes``, told where they lie; all others are not made into sets."""
    return marked(docs.withColumn("home", F.xxhash64("id")), nodes, count, "maybe", "home").filter("maybe").select("text")


def _sets(docs: DataFrame, nodes: DataFrame, whole: bool) -> DataFrame:
    """(node, n, grams): the shingles of each class in ``nodes`` (node, home), made from one of its texts, and their number.

    ``whole`` gives all 64 bits of each, else the distinct upper 32 bits.
    """

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to()
        seen = set()
        for part in parts:
            rows = []
            for text in part["text"]:
                grams = shingles_of(text)
                node = class_of(grams)
                if node not in seen:
                    seen.add(node)
                    short = np.unique(grams >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    rows.append((node, len(grams), grams.view(np.int64) if whole else short))
            yield pd.DataFrame(rows, columns=["node", "n", "grams"])
        release()

    count = nodes.count()
    sets = _asked(docs, nodes, count).mapInPandas(made, f"node long, n int, grams array<{'long' if whole else 'int'}>")
    some = marked(sets, nodes, count, "maybe", "node").filter("maybe").drop("maybe")
    return some.join(unsent(nodes), "node", "left_semi").dropDuplicates(["node"])


def _reach(shared: Column) -> Column:
    """Sets of ``sizes`` elements, added up, that share so many are at the bound."""
    return UNDER * shared >= OVER * (F.col("sizes") - shared)


def _likely(pairs: DataFrame, homes: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches do not rule out."""
    nodes = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    known = marked(homes.select("node", "n", "bits"), nodes, nodes.count(), "maybe", "node").filter("maybe")
    left = known.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = known.select(F.col("node").alias("b"), F.col("n"), F.col("bits").alias("y"))
    met = pairs.join(unsent(left), "a").join(unsent(right), "b").withColumn("sizes", F.col("m") + F.col("n"))
    met = met.filter(_reach(F.least("m", "n")))

    # Of sizes so near, one sketch has twice the bits of the other at most: its halves are laid over each other.
    def folded(own: str, other: str) -> Column:
        halves = f"transform(sequence(0, size({other}) - 1), i -> {own}[i] | {own}[i + size({other})])"
        return F.expr(f"if(size({own}) = 2 * size({other}), {halves}, {own})")

    def lost(own: str, other: str) -> Column:
        return F.expr(f"aggregate(zip_with({own}, {other}, (s, t) -> bit_count(s & ~t)), 0, (k, s) -> k + s)")

    met = met.select("a", "b", "m", "n", "sizes", folded("x", "y").alias("x"), folded("y", "x").alias("y"))
    most = F.least(F.col("m") - lost("x", "y"), F.col("n") - lost("y", "x"))
    likely = scratch.keep(met.filter(_reach(most)).select("a", "b"))
    scratch.drop(nodes)
    return likely


def _met(pairs: DataFrame, docs: DataFrame, homes: DataFrame, scratch: Scratch, whole: bool) -> DataFrame:
    """(a, b, sizes, shared, more): of each pair the sizes of its sets added up, how many shingles are equal, and how many
    equal ones shortening can have hidden. Sets are made for classes of a pair only."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = scratch.keep(unsent(asked).join(homes.select("node", "home"), "node"))
    sets = scratch.keep(_sets(docs, nodes, whole))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n"), F.col("grams").alias("y"))
    size = F.size("x") + F.size("y")
    found = pairs.join(unsent(left), "a").join(unsent(right), "b").select(
        "a", "b", (F.col("m") + F.col("n")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("shared"),
        (F.col("m") + F.col("n") - size).alias("more"),
    )
    found = scratch.keep(found)
    scratch.drop(nodes, sets)
    return found


def _settled(pairs: DataFrame, docs: DataFrame, homes: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) that reach the bound, by their sets.

    Half of each shingle's bits settles nearly all: chance makes more than ``CHANCE`` shingles of a pair equal less often
    than 64 bits do. Pairs that so many could tip either way are told by all bits.
    """
    rough = _met(pairs, docs, homes, scratch, False)
    sure = _reach(F.col("shared") - CHANCE)
    unsure = scratch.keep(rough.filter(~sure & _reach(F.col("shared") + F.col("more"))).select("a", "b"))
    if unsure.isEmpty():
        found = scratch.keep(rough.filter(sure).select("a", "b"))
        scratch.drop(rough, unsure)
        return found
    exact = _met(unsure, docs, homes, scratch, True)
    found = scratch.keep(rough.filter(sure).select("a", "b").unionByName(exact.filter(_reach(F.col("shared"))).select("a", "b")))
    scratch.drop(rough, unsure, exact)
    return found


def _verified(pairs: DataFrame, docs: DataFrame, homes: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that reach the bound: by sketches, then by sets in turns."""
    likely = _likely(pairs, homes, scratch)
    count = likely.count()
    if not count:
        return likely
    turns = -(-count // max(LEAST_PAIRS, homes.count() // CLASSES_A_PAIR))
    parts = []
    for turn in range(turns):
        part = likely.filter(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn) if turns > 1 else likely
        parts.append(_settled(part, docs, homes, scratch))
    scratch.drop(likely)
    if turns == 1:
        return parts[0]
    found = scratch.keep(reduce(DataFrame.unionByName, parts))
    scratch.drop(*parts)
    return found


#: What follows the first shingle two sets have in common bounds what they can have in common at all.
_NEAR = f"p.node <> q.node AND {OVER + UNDER} * (1 + least(p.rest, q.rest)) >= {OVER} * (p.n + q.n)"


def _ends(groups: DataFrame, order: Column) -> DataFrame:
    """The distinct pairs of each member of a key's group with the group's ends by ``order``, where they can be similar."""
    end = F.struct(order.alias("at"), "node", "n", "rest")
    ends = groups.groupBy("key").agg(F.min(end).alias("low"), F.max(end).alias("high")).filter("low.node <> high.node")
    met = groups.alias("p").join(unsent(ends), "key").select("p.*", F.explode(F.array("low", "high")).alias("q"))
    pairs = met.select(F.struct("node", "n", "rest").alias("p"), "q").filter(_NEAR)
    return pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _across(labelled: DataFrame) -> DataFrame:
    """The pairs of a key's members in different components that can be similar: blocks of ``BLOCK`` members meet."""
    parts = labelled.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = labelled.join(unsent(parts), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = lambda a, b: F.explode(F.sequence(F.lit(a) if a == 0 else F.col(a), b))
    left = dealt.withColumns({"i": F.col("part"), "j": others("part", F.col("parts") - 1)}).alias("p")
    right = dealt.withColumns({"j": F.col("part"), "i": others(0, F.col("part"))}).alias("q")
    place = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("key", "i", "j")]
    met = left.join(unsent(right), [*place, F.expr(f"(p.i < p.j OR p.node < q.node) AND p.c <> q.c AND {_NEAR}")])
    return met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def links(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join exactly the classes which chains of pairs at the bound join; ``rows`` as read from ``docs``."""
    homes = scratch.keep(_homes(rows))
    tested = _alike(rows, scratch)
    found = _verified(tested, docs, homes, scratch)
    groups = _groups(rows, scratch)
    turn, before = 0, None
    while True:
        labels = components(found)
        labelled = groups.join(unsent(labels), "node", "left").select("key", "node", "n", "rest", F.coalesce("component", "node").alias("c"))
        several = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
        left = scratch.keep(labelled.join(unsent(several.select("key")), "key", "left_semi"))
        scratch.drop(groups)
        groups = left.drop("c")
        groups._scratch_path = left._scratch_path
        own = left.groupBy("key", "c").agg(F.count("*").alias("m"))
        sizes = own.groupBy("key").agg(F.sum("m").cast("double").alias("all"), F.sum(F.expr("double(m) * m")).alias("own"))
        apart, members = sizes.agg(F.sum(F.expr("(all * all - own) / 2")), F.sum("all")).first()
        if apart is None:
            scratch.drop(groups, tested, homes)
            return found
        # What SimHash has left is held against ends once at least.
        last = turn > 0 and (apart <= FEW * members or (before is not None and apart > before / 2))
        fresh = _across(left) if last else _ends(groups, F.xxhash64("node", F.lit(turn)))
        turn, before = turn + 1, apart if turn else None
        pairs = scratch.keep(fresh.join(unsent(tested), ["a", "b"], "left_anti"))
        more = _verified(pairs, docs, homes, scratch)
        both = scratch.keep(found.unionByName(more))
        scratch.drop(found, more)
        found = both
        if last:
            scratch.drop(groups, tested, pairs, homes)
            return found
        both = scratch.keep(tested.unionByName(pairs))
        scratch.drop(tested, pairs)
        tested = both


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group left that pairs of similarity 0.8 or more link: the one of the smallest id.

    A null id stays only where all are null; of rows that repeat the smallest id one stays, any of them. Texts without
    words are one group. Rows that no other is like, nearly all, are passed on where they lie: a Bloom filter of the ids
    that something is known of tells them, and only the rest is joined with what was decided.
    """
    made = {"near__key", "near__maybe", "near__node"}
    if taken := made & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    scratch = Scratch(docs.sparkSession, "near-copies")
    texts = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    rows = scratch.keep(_read(texts, _common(texts)))
    edges = links(texts, rows, scratch)
    own = scratch.keep(rows.groupBy("id", "node").agg(F.count("*").alias("rows")))
    classes = own.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"))
    grouped = classes.join(unsent(components(edges)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct("least.none", "least.id", "node")).alias("first")
    kept = scratch.keep(grouped.groupBy("component").agg(first).select(F.col("first.id").alias("kept__id"), F.col("first.node").alias("kept__node")))
    scratch.drop(rows, edges)
    same = F.col("id").eqNullSafe(F.col("kept__id")) & (F.col("node") == F.col("kept__node"))
    # Ids of which a row goes, or which come more than once.
    told = own.join(unsent(kept), same, "left").filter("kept__node IS NULL OR rows > 1").select(F.xxhash64("id").alias("near__key")).distinct()
    told = scratch.keep(told)
    count = told.count()
    asked = marked(docs.withColumn("near__key", F.xxhash64(F.col(id))), told, count, "near__maybe", "near__key")

    @pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        return pd.Series([class_of(shingles_of(t)) for t in texts], dtype="int64")

    # Known not to be null, or the join's test for nulls has it made twice, by a second worker for each task.
    rest = asked.filter("near__maybe").withColumn("near__node", F.coalesce(node(text_of(text)), F.lit(0).cast("long")))
    match = rest[id].eqNullSafe(kept["kept__id"]) & (rest["near__node"] == kept["kept__node"])
    rest = rest.join(unsent(kept), match, "left_semi").dropDuplicates([id, "near__node"])
    return asked.filter("NOT near__maybe").select(*docs.columns).unionByName(rest.select(*docs.columns))
