"""Repeated passages, found with suffix arrays and longest-previous-factor arrays.

A window of ``LENGTH`` bytes is repeated if the same bytes also start anywhere else. Every window has an anchor: the
string of ``ANCHOR`` bytes in it whose hash is smallest, the first of equals. It depends on the window's content alone, so equal
windows have equal anchors at equal places, and a document falls into segments, the runs of windows with one anchor.

1. Anchors are counted by hash. Segments whose anchor occurs once are done with: their windows occur once.
2. Of the rest, segments equal in content and place around the anchor are counted by hash. All windows of a segment
   that occurs twice are repeated.
3. Where one anchor has different segments, one of each content is compared: their texts are put in a row, a suffix
   array orders all suffixes, and the common prefixes of neighbours show which windows recur. Previous and next smaller
   positions in suffix order give each window's longest previous factor, the match with an earlier place, so that
   the first copy can be told from later ones.

An anchor with more than ``GROUP`` different segments is not gathered. Its segments are sorted over all tasks, once by what
follows the anchor and once by what precedes it, read backwards. In either order the neighbours of a segment share most
with it: what they share is marked at once, and windows that reach beyond are known to occur once. The windows
that are left are counted one by one, by hash and with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lamplight.llm.hashing import Hashes, mixed
from lamplight.llm.tables import Scratch, text_of

LENGTH, ANCHOR = 200, 40
GROUP = 256
CHUNK = 1 << 20
#: Texts are compared in suffix arrays of about so many bytes.
COMPARED = 1 << 19

_MASK = np.uint64((1 << 24) - 1)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, 1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, anchor: int):
    """Segments of the texts that lie at [begins, ends) in ``data``: text, first and last window, anchor's place, hash
    of the anchor, hash of the segment with its place around the anchor."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return (empty,) * 4 + (empty.astype(np.uint64),) * 2
    hashes = Hashes(data)
    own = hashes.all_of(anchor)
    keyed = (own & ~_MASK) | np.arange(len(own), dtype=np.uint64)
    at = (_least(keyed, length - anchor + 1) & _MASK).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    long = ends - begins >= length
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    valid = np.cumsum(inside)[: len(at)] > 0
    fresh = np.r_[True, (at[1:] != at[:-1]) | ~valid[:-1]]
    fresh[begins[begins < len(at)]] = True
    first = np.flatnonzero(fresh & valid)
    stop = np.flatnonzero(np.r_[fresh[1:] | ~valid[1:], True] & valid)
    place = at[first]
    text = np.searchsorted(begins, first, "right") - 1
    around = ((place - first).astype(np.uint64) << np.uint64(32)) + (stop - first).astype(np.uint64)
    return text, first, stop, place, own[place], mixed(hashes.of(first, stop + length) ^ mixed(around))


def _chunks(texts: list[bytes], length: int):
    """Texts put in a row, about ``CHUNK`` bytes at a time: (data, begins, ends, number, offset). A longer text is cut so
    that every window lies in one piece."""
    parts, size = [], 0

    def flush():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        return data, ends - sizes, ends, np.array([n for n, _, _ in parts]), np.array([o for _, o, _ in parts])

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if len(piece) < length:
                continue
            parts.append((number, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield flush()
                parts, size = [], 0
    if parts:
        yield flush()


OCCURRENCES = "uid long, id long, first int, last int, place int, anchor long, content long"


def _occurrences(length: int, anchor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            uid, ids = batch["uid"].to_numpy(), batch["id"].to_numpy()
            for data, begins, ends, number, offset in _chunks(batch["bytes"].tolist(), length):
                text, first, last, place, own, content = segments(data, begins, ends, length, anchor)
                shift = (offset - begins)[text]
                yield pd.DataFrame(
                    {
                        "uid": uid[number[text]], "id": ids[number[text]], "first": (first + shift).astype(np.int32),
                        "last": (last + shift).astype(np.int32), "place": (place + shift).astype(np.int32),
                        "anchor": own.view(np.int64), "content": content.view(np.int64),
                    }
                )

    return run


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first ``depth`` symbols or more, and the ranks after each doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while width < depth:
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - width] = rank[width:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        width *= 2
        if rank.max(initial=0) == len(rank) - 1:
            break
    return np.argsort(rank, kind="stable"), ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, up to ``depth`` or a little more."""
    a, b = order[1:].copy(), order[:-1].copy()
    out = np.zeros(len(a), np.int64)
    n = len(order)
    for level in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        step = same * (1 << level)
        out += step
        a += step
        b += step
    return np.r_[0, np.minimum(out, depth)]


def longest_previous_factor(order: np.ndarray, prefix: np.ndarray, when: np.ndarray) -> np.ndarray:
    """For each suffix the longest prefix that it shares with a suffix that comes earlier by ``when``.

    The previous and the next suffix in order with a smaller ``when`` are the only ones that can give it; a stack finds
    both, keeping the least common prefix on the way.
    """
    lpf = np.zeros(len(order), np.int64)
    for sequence, shared in ((range(len(order)), prefix), (range(len(order) - 1, -1, -1), np.r_[prefix[1:], 0])):
        stack: list[list[int]] = []  # (when, least common prefix with the one below)
        for i in sequence:
            now, least = int(when[order[i]]), int(shared[i])
            while stack and stack[-1][0] >= now:
                least = min(least, stack.pop()[1])
            if not stack:
                least = 0
            lpf[order[i]] = max(lpf[order[i]], least)
            stack.append([now, least])
    return lpf


def _recurring(texts: list[bytes], counts: list[int], turn: np.ndarray, length: int, keep_first: bool) -> list[np.ndarray]:
    """Per segment which of its windows recur in the others (or in one of an earlier turn, to keep the first)."""
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    row = np.zeros(int(sizes.sum()), np.int64)
    for number, (begin, text) in enumerate(zip(begins, texts)):
        row[begin : begin + len(text)] = np.frombuffer(text, np.uint8)
        row[begin + len(text)] = 256 + number  # ends are all different, so that no match runs over them
    order, ranks = suffix_array(row, length)
    prefix = common_prefixes(order, ranks, length)
    if keep_first:
        inner = np.arange(len(row)) - np.repeat(begins, sizes)
        reach = longest_previous_factor(order, prefix, np.repeat(turn, sizes) * len(row) + inner)
    else:
        reach = np.empty(len(row), np.int64)
        reach[order] = np.maximum(prefix, np.r_[prefix[1:], 0])
    found = [reach[b : b + n] >= length for b, n in zip(begins, counts)]
    return found


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


MARKS = "uid long, start int, stop int"


def _compared(length: int, keep_first: bool):
    """Marks for the segments of a partition sorted by anchor; whole anchors go into one suffix array."""

    def marks(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.drop_duplicates(["anchor", "uid", "first"])  # rows of equal id and text are cut alike
        anchor = part["anchor"].to_numpy()
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(part) else []
        size = np.cumsum(part["text"].map(len).to_numpy())
        at = 0
        while at < len(starts):
            upto = at + 1
            base = size[starts[at] - 1] if starts[at] else 0
            while upto < len(starts) and size[starts[upto] - 1] - base < COMPARED:
                upto += 1
            rows = part.iloc[starts[at] : starts[upto] if upto < len(starts) else len(part)]
            turn = np.lexsort((rows["first"], rows["uid"], rows["id"]))
            found = _recurring(
                rows["text"].tolist(), (rows["last"] - rows["first"] + 1).tolist(), np.argsort(turn), length, keep_first
            )
            for uid, first, mask in zip(rows["uid"], rows["first"], found):
                out += [(uid, first + a, first + b - 1 + length) for a, b in _spans(mask)]
            at = upto
        return pd.DataFrame(out, columns=["uid", "start", "stop"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            anchor = part["anchor"].to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1])) if len(part) else 0
            rest = part.iloc[last:]
            yield marks(part.iloc[:last].reset_index(drop=True))
        if rest is not None:
            yield marks(rest.reset_index(drop=True))

    return run


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


ORDERED = "anchor long, uid long, id long, first int, last int, place int, back binary, ahead binary, most_back int, most_ahead int, low array<int>, high array<int>"


def _beside(length: int, column: str):
    """Each row with what it shares with its neighbours of one anchor, in a partition sorted by ``column``.

    ``low`` and ``high`` gain the windows, counted from the anchor, that row and neighbour share; ``most_<column>`` is the
    longest common prefix with any row of the anchor. Nothing is known beyond a partition's ends, so there it is the whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = f"most_{column}"
        before = None
        for part in batches:
            done = []
            for row in part.to_dict("records"):
                row["low"], row["high"] = list(row["low"]), list(row["high"])
                row[most] = len(row[column]) if before is None else 0
                if before is not None:
                    if before["anchor"] == row["anchor"]:
                        back, ahead = _common(before["back"], row["back"]), _common(before["ahead"], row["ahead"])
                        for own in (before, row):
                            own[most] = max(own[most], back if column == "back" else ahead)
                            if ahead + back >= length:
                                own["low"].append(-back)
                                own["high"].append(ahead - length)
                    done.append(before)
                before = row
            yield pd.DataFrame(done, columns=part.columns)
        if before is not None:
            before[most] = len(before[column])
            yield pd.DataFrame([before])

    return run


def _shared(length: int):
    """Marks for the windows that neighbours share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                spans = sorted(zip(row.low, row.high))
                out += [(row.uid, row.place + a, row.place + b + length) for a, b in joined_spans([(x, y + 1) for x, y in spans])]
            marks = pd.DataFrame(out, columns=["uid", "start", "stop"])
            yield marks.assign(stop=marks["stop"] - 1)

    return run


def _windows(length: int, counted: bool):
    """Windows that may recur, as (uid, id, start, key); ``counted`` gives a batch's different keys and their number instead.

    Windows that a neighbour is known to share are left out unless counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            texts = [b[::-1] + a for b, a in zip(part["back"], part["ahead"])]
            size = np.array([len(t) for t in texts])
            begin = np.cumsum(size) - size
            place = part["place"].to_numpy().astype(np.int64)
            low = np.maximum(part["first"].to_numpy() - place, -part["most_back"].to_numpy())
            high = np.minimum(part["last"].to_numpy() - place, part["most_ahead"].to_numpy() - length)
            n = np.maximum(0, high - low + 1)
            row = np.repeat(np.arange(len(part)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
            if not counted:
                known = [set() for _ in texts]
                for own, lows, highs in zip(known, part["low"], part["high"]):
                    for a, b in zip(lows, highs):
                        own.update(range(a, b + 1))
                fresh = np.fromiter((o not in known[r] for r, o in zip(row.tolist(), offset.tolist())), bool, len(row))
                row, offset = row[fresh], offset[fresh]
            hashes = Hashes(np.frombuffer(b"".join(texts), np.uint8))
            start = begin[row] + place[row] - part["first"].to_numpy()[row] + offset
            anchor = part["anchor"].to_numpy().view(np.uint64)[row]
            key = (hashes.of(start, start + length) ^ mixed(offset.view(np.uint64) ^ anchor)).view(np.int64)
            if counted:
                key, number = np.unique(key, return_counts=True)
                yield pd.DataFrame({"key": key, "n": number})
            else:
                own = part.iloc[row]
                yield pd.DataFrame({"uid": own["uid"], "id": own["id"], "start": place[row] + offset, "key": key})

    return run


ASKED = "anchor long, uid long, id long, first int, last int, place int, n long"


def _texts(length: int, apart: bool):
    """The bytes of the segments asked for, cut from their documents; ``apart``: those before the anchor, read backwards, and
    the others."""
    names = [c.split()[0] for c in ASKED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                for w in row.wanted:
                    text = row.bytes[w["first"] : w["last"] + length]
                    at = w["place"] - w["first"]
                    bytes_ = (text[:at][::-1], text[at:]) if apart else (text,)
                    out.append((w["anchor"], row.uid, row.id, w["first"], w["last"], w["place"], w["n"], *bytes_))
            yield pd.DataFrame(out, columns=[*names, *(("back", "ahead") if apart else ("text",))])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_first: bool = False) -> DataFrame:
    """(uid, spans): of the documents (uid, id, bytes) that hold repeated windows, the sorted spans they cover.

    ``keep_first`` leaves out windows that occur nowhere earlier, documents ordered by id and then uid.
    """
    # Each table's own shuffles can go once it is written.
    stored = Scratch(docs.sparkSession, "repeats").keep
    found = docs.select("uid", "id", "bytes").mapInPandas(_occurrences(length, anchor), OCCURRENCES)
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    # Written first: only a join of two plain shuffles can have a hot anchor's side split.
    often = stored(often)
    repeated = stored(found.join(often, "anchor"))

    who = F.struct("id", "uid", "first", "last", "place")
    contents = repeated.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(who).alias("rep"))
    contents = stored(contents)
    twice = contents.filter("n > 1")
    # All windows of a segment that occurs twice; to keep the first, of all but the first such segment.
    whole = repeated.join(twice.select("anchor", "content", "rep"), ["anchor", "content"])
    if keep_first:
        whole = whole.filter(who != F.col("rep"))
    whole = whole.select("uid", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))

    groups = contents.groupBy("anchor").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1")
    groups = groups if keep_first else groups.filter("least = 1")
    asked = contents.join(groups, "anchor").select("rep.*", "anchor", "n", "size")
    wanted = asked.groupBy("uid").agg(
        F.collect_list(F.struct("anchor", "first", "last", "place", "n", "size")).alias("wanted")
    )
    parts = docs.select("uid", "id", "bytes").join(wanted, "uid")
    split = lambda test: parts.withColumn("wanted", F.filter("wanted", test)).filter(F.size("wanted") > 0)

    small = split(lambda w: w["size"] <= GROUP).mapInPandas(_texts(length, False), f"{ASKED}, text binary")
    order = small.repartition("anchor").sortWithinPartitions("anchor", "id", "uid", "first")
    compared = order.mapInPandas(_compared(length, keep_first), MARKS)

    large = split(lambda w: w["size"] > GROUP).mapInPandas(_texts(length, True), f"{ASKED}, back binary, ahead binary")
    nothing, none = F.lit(0), F.array().cast("array<int>")
    laid = large.dropDuplicates(["anchor", "uid", "first"]).select(
        "anchor", "uid", "id", "first", "last", "place", "back", "ahead", nothing.alias("most_back"),
        nothing.alias("most_ahead"), none.alias("low"), none.alias("high"),
    )
    for column in ("back", "ahead"):
        laid = laid.repartitionByRange("anchor", column).sortWithinPartitions("anchor", column)
        laid = laid.mapInPandas(_beside(length, column), ORDERED)
    laid = stored(laid)
    if keep_first:  # what a neighbour shares may be the first copy itself
        laid = laid.withColumns({"low": none, "high": none})
    shared = laid.mapInPandas(_shared(length), MARKS)
    often = laid.mapInPandas(_windows(length, True), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rest = laid.mapInPandas(_windows(length, False), "uid long, id long, start int, key long")
    hot = rest.join(often.filter("n > 1"), "key")
    if keep_first:
        place = F.struct("id", "uid", "start")
        hot = hot.join(rest.groupBy("key").agg(F.min(place).alias("rep")), "key").filter(place != F.col("rep"))
    hot = shared.unionByName(hot.select("uid", "start", (F.col("start") + length).alias("stop")))

    marks = whole.unionByName(compared).unionByName(hot)
    return marks.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def joined_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for span in spans if spans is not None else ():
        start, stop = (span["start"], span["stop"]) if isinstance(span, dict) else span
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


RESULT = "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:binary>"


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = True,
    with_kept: bool = True,
) -> DataFrame:
    """``docs`` with ``repeats``: (n_bytes, n_removed, n_spans, kept_sha256, kept) of each text's UTF-8 bytes.

    Removed is every byte that a repeated window covers; ``keep_first`` spares the first occurrence, by id and then by a
    hash of the row. Matches never cross documents, but may lie in one document and may overlap. Null texts count as
    empty; rows of equal id and text are occurrences each, and are cut alike. Kept bytes may begin or end inside a
    character. An empty table gives an empty one; a column ``repeats`` in ``docs`` is a ValueError.
    """
    if taken := {"repeats", "repeats__uid", "repeats__spans"} & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    body = text_of(text)
    keyed = docs.withColumn("repeats__uid", F.xxhash64(F.col(id), body))
    source = keyed.select(
        F.col("repeats__uid").alias("uid"), F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("id"),
        body.cast("binary").alias("bytes"),
    )
    spans = repeated_spans(source, length, min(ANCHOR, length), keep_first).select(
        F.col("uid").alias("repeats__uid"), F.col("spans").alias("repeats__spans")
    )

    @pandas_udf(RESULT)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for data, own in zip(texts, spans):
            runs = joined_spans(own)
            kept, at = [], 0
            for start, stop in runs:
                kept.append(data[at:start])
                at = stop
            kept = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = keyed.join(spans, "repeats__uid", "left")
    done = joined.withColumn("repeats", cut(body.cast("binary"), F.col("repeats__spans")))
    return done.select(*docs.columns, "repeats")
