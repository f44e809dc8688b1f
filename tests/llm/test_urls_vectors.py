"""URL filters, centroid clustering and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from lamplight.llm import centroids, hard_negatives, url_filter, vector_search

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.b", None, "block"), ("a.b", "", "allow"), ("b", "/aa", "allow"), (None, "/x", "block"), ("", "/y", "block"), ("c", "/", "refuse"),
]
LISTED = ["http://www.Spam.org:80/fr/x/?b=2&utm_source=q&a=1#top", "ftp://m.spam.com/", None, "no url", "http://spam.net/en/"]
URLS = [
    None, "", "no scheme/net/", "http://", "http://net/", "http://net", "https://x.NET/a?b#c", "http://xnet/", "http://a.example.net/en/1",
    "http://a.example.net/en", "http://a.example.net/EN/1", "http://example.com/de/", "http://sub.EXAMPLE.com/de/x", "http://notexample.com/de/",
    "https://spam.org/fr/x?a=1&b=2", "https://spam.org/fr/x?a=1&b=3", "https://m.spam.org/fr/x/?b=2&a=1", "https://spam.com", "gopher://spam.com?utm_x=1",
    "http://spam.net/en", "http://spam.net/en/", "a://b://c.net/", "http://a.b/", "http://z.a.b/aaa", "http://b/aaa", "http://ab/aaa", "http://x\ny.net/a\nb",
    "http://" + "a." * 3000 + "net/" + "p" * 20_000, "http://c/", "http://É.net/ä", "http://x.org/fr/y", "http://x.org/fr",
]


def split(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    query = rest[len(host) + len(path) :].split("#")[0].removeprefix("?")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, query


def canonical(url):
    host, path, query = split(url)
    host = re.sub(r"^(www|m)\.", "", re.sub(r":(80|443)?$", "", host))
    told = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", p))
    return host and host + path.removesuffix("/") + ("?" + "&".join(told) if told else "")


def judged(url):
    host, path, _ = split(url)
    fits = []
    for h, p, verdict in RULES:
        h, p = h and h.lower(), p or ""
        if h and verdict in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), verdict == "block", h + p, verdict))
    if fits:
        return (host, path, *max(fits)[3:])
    return host, path, None, "block" if canonical(url) and canonical(url) in {canonical(u) for u in LISTED} else "allow"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([(u,) for u in LISTED], "url string")


@pytest.mark.parametrize("small", [False, True])
def test_urls(spark, rules, listed, monkeypatch, small):
    if small:  # neither filter nor list are broadcast
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", 0)
        monkeypatch.setattr(url_filter, "MOST_BYTES", 0)
    rows = [(i, u, "host", 7, "x") for i, u in enumerate(URLS + URLS[:9])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, key int, verdict string")
    got = {r.page_id: tuple(r.judged) for r in url_filter.judge(df, rules, listed).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        assert got[i] == judged(u), u


def test_urls_without_lists(spark, rules, listed):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    told = lambda *a: [tuple(r.judged) for r in url_filter.judge(*a).collect()]
    assert told(df, rules.limit(0)) == [("a.net", "/", None, "allow")]
    assert told(df, rules.limit(0), listed.limit(0)) == [("a.net", "/", None, "allow")]
    assert told(df.limit(0), rules, listed) == []
    again = url_filter.judge(url_filter.judge(df, rules), rules)  # a column of the same name is replaced
    assert again.columns == ["page_id", "url", "judged"] and again.first().judged.verdict == "block"


def test_bloom_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(4000).select(F.concat(F.lit("key "), "id").alias("key"))
    others = spark.range(40_000).select(F.concat(F.lit("other "), "id").alias("key"))
    assert url_filter.possible(keys, keys, 4000).count() == 4000
    assert url_filter.possible(others, keys, 4000).count() < 400


def test_urls_are_native(spark, rules, listed):
    df = spark.range(9).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.net/"), "id").alias("url"))
    plan = url_filter.judge(df, rules, listed)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
        T.StructField("cluster", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("cell", T.StringType()),
    ]
)


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(*r, None, None, None, None)[:2] + (r[2] if len(r) > 2 else None, "x", 1, None) for r in rows], VECTORS)

    return make


def clustered(rows, k, rounds, width):
    """By lists and Python's integers; rows are (id, vector)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in kept[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            group = [v for (_, v), at in zip(kept, own) if at == j]
            if group:
                centres[j] = [sum(xs) // len(group) for xs in zip(*group)]
    own = assign()
    d = [far(v, centres[j]) for (_, v), j in zip(kept, own)]
    cut = lambda x: min(x, (1 << 63) - 1)
    of = [sum(x for x, j in zip(d, own) if j == c) for c in range(len(centres))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, j, cut(x), cut(of[j]), cut(sum(d)), hashes[j]) for (i, _), j, x in zip(kept, own, d)], key=repr)


@pytest.mark.parametrize("size", [0.001, 1.0, 3e4, 1e9, 1e17])
def test_centroids(vectors, size):
    rng = random.Random(int(size * 1000))
    rows = [(i, [rng.gauss(rng.choice((-2, 0, 2)), 0.6) * size for _ in range(3)]) for i in range(60)]
    rows += [(60 + i, [0.5 * size] * 3) for i in range(30)] + [(5, rows[5][1]), (None, rows[0][1]), (None, None), (91, None), (92, [1.0, None, 2.0])]
    rows += [(93, [1.0]), (94, [float("nan"), 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0]), (96, [])]
    got = centroids.cluster(vectors(rows), k=4, rounds=5, width=3)
    if size < 1e16:  # beyond, components are cut to longs
        assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows, 4, 5, 3)
    else:
        assert got.count() == 92


def test_centroids_of_few_rows(vectors):
    assert centroids.cluster(vectors([]), width=2).count() == 0
    assert centroids.cluster(vectors([(1, None), (2, [1.0])]), width=2).collect() == []
    rows = [(7, [0.25, -0.25]), (7, [0.25, -0.25]), (8, [0.5, 0.5])]
    assert sorted(map(tuple, centroids.cluster(vectors(rows), width=2).collect())) == clustered(rows, 8, 10, 2)
    same = [(i, [0.1, 0.2]) for i in range(20)]  # all but the first centroid stay empty
    assert sorted(map(tuple, centroids.cluster(vectors(same), k=3, rounds=2, width=2).collect())) == sorted(clustered(same, 3, 2, 2))


def mined(rows, chosen, positives, negatives):
    kept = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, lab in {(i, tuple(v), lab) for i, v, lab in kept if chosen(i)}:
        by_score = sorted((-dot(v, w), j, other) for j, w, other in kept if not (other == lab and j == i))
        for p, j, _ in [r for r in by_score if r[2] == lab][:positives]:
            fits = [(-s, n) for s, n, other in by_score if other != lab and -30 * p <= -100 * s <= -90 * p][:negatives]
            out += [(i, j, at + 1, n, -p, s) for at, (s, n) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block,cell,first", [(2048, 512, 32), (7, 3, 1), (1, 1, 1)])
@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_hard_negatives(spark, monkeypatch, block, cell, first, spread):
    for name, value in (("BLOCK", block), ("CELL", cell), ("FIRST", first), ("GROUP", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(block)
    centres = [[rng.gauss(0, 40) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(160):
        centre = rng.choice(centres)
        rows.append((i, [int(c + rng.gauss(0, 40 * spread)) for c in centre], rng.randrange(4)))
    rows += [(200 + i, [30, 30, 0, 0, 0, 1], 1) for i in range(40)] + [rows[0], rows[9], (10, [1, 2, 3], 1), (20, [], 2), (30, [0] * 6, 9)]
    rows += [(None, [1] * 6, 1), (40, None, 1), (50, [1] * 6, None), (60, [1, None, 1, 1, 1, 1], 1), (70, [-3] * 6, 2), (70, [5] * 6, 3)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "id long, v array<long>, label int, score string, rank int")
    got = hard_negatives.mine(df, df.filter("id % 10 = 0"), 3, 4)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0, 3, 4)


def test_hard_negatives_of_large_numbers_and_no_rows(spark):
    big = 3_000_000_000
    rows = [(1, [big, 1], 0), (2, [big, 2], 0), (3, [big // 2, 5], 1), (4, [big // 3, 5], 1), (5, [-big, 1], 1), (6, [0, 0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<long>, label int")
    got = hard_negatives.mine(df, df.filter("id < 3"), 3, 4)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i < 3, 3, 4)
    for empty in (hard_negatives.mine(df.limit(0), df), hard_negatives.mine(df, df.limit(0))):
        assert empty.collect() == [] and empty.columns[0] == "anchor_id"
    lone = spark.createDataFrame([(1, [1, 1], 0)], "id long, v array<long>, label int")
    assert hard_negatives.mine(lone, lone).collect() == []


def test_the_heap_gives_cells_by_falling_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    index = hard_negatives.Index(4, (rng.normal(size=(5, 2)), rng.normal(size=(7, 2))))
    halves = [rng.normal(size=5), rng.normal(size=7)]
    seen = list(index.visits(halves))
    assert len({c[:2] for c in seen}) == 35 and all(a[2] >= b[2] for a, b in zip(seen, seen[1:]))
    assert all(bound == halves[0][i] + halves[1][j] for i, j, bound in seen)


def test_unusable_vectors_take_no_part(spark, vectors):
    rows = [(100, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.4, 0.2], 2), (3, [float("nan"), 0.2], 2), (4, [0.4, None], 2), (5, None, 2)]
    df = vectors(rows).select("vec_id", "label", vector_search.digits("embedding", 256).alias("v"))
    got = hard_negatives.mine(df, df.filter("vec_id = 100"), id="vec_id").collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in got] == [(100, 1, 2)]
