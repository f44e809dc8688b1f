"""Toxicity, secrets, page text, fingerprints."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamplight.llm import html_text, secret_scan, simhash, toxicity
from lamplight.llm.components import components


def prose(rng, n):
    syllables = "ta ro mi ken sul po ra ni ve lo ba du".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(240):
        words = prose(rng, rng.randint(30, 200)).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["wretched", "dolt", "vermin"]))
        texts.append(" ".join(words))
        marks.append(int(i % 4 == 0))
    return texts, marks


def training(spark, texts, marks):
    return spark.createDataFrame([(i, m, t) for i, (t, m) in enumerate(zip(texts, marks))], "doc_id long, toxic int, text string")


def test_toxicity_held_out(spark, docs, labelled):
    texts, marks = labelled
    model = toxicity.train_on(training(spark, texts[:160], marks))
    assert b"wretched" in model.toxic[: -len(model.ordinary)] and b"wretched" not in model.ordinary
    df = docs(list(enumerate(texts[160:])) + [(90, None), (91, ""), (92, "ro " * 40000), (93, "DOLT vermin")])
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score(model).alias("s")).collect()}
    right = sum((got[i] >= 0.5) == bool(m) for i, m in enumerate(marks[160:]))
    assert right >= 0.95 * 80
    assert got[90] == got[91] < 0.5 and got[92] < 0.5 <= got[93]


def slow_telling(texts, marks):
    """The words' test one text after the other."""
    spread, known, size = ({0: Counter(), 1: Counter()}, {0: set(), 1: set()}, Counter(marks))
    for text, mark in zip(texts, marks):
        words = ["", *re.findall(r"[^\W\d_]+", text.lower()), ""]
        fresh = {t for t in zip(words, words[1:], words[2:])} - known[mark]
        known[mark] |= fresh
        spread[mark].update({t[1] for t in fresh})
    n, m = size[1], size[0]
    tested = [w for w, k in spread[1].items() if k > 1 and k * m > spread[0][w] * n]
    found = []
    for w in tested:
        a, b = spread[1][w], spread[0][w]
        rate = (a + b) / (n + m)
        cells = ((a, n * rate), (n - a, n * (1 - rate)), (b, m * rate), (m - b, m * (1 - rate)))
        g = 2 * sum(x * math.log(x / e) for x, e in cells if x)
        if rate < 1 and g >= 2 * math.log(len(tested) + 1) + 4 and a * m >= 4 * b * n:
            found.append(w)
    return set(found)


def test_telling_words_by_brute_force(spark, labelled):
    texts, marks = labelled
    texts, marks = texts + texts[:40] + ["", "dolt"], marks + marks[:40] + [0, 1]
    got = toxicity.telling(training(spark, texts, marks))
    assert set(got) == slow_telling(texts, marks) >= {"wretched", "dolt", "vermin"} and len(got) == len(set(got))
    assert toxicity.telling(training(spark, texts[:1], marks[:1])) == []


def test_toxicity_trains_from_tables(spark, docs, labelled):
    texts, marks = labelled
    df = docs(list(enumerate(texts)) + [(None, "x"), (3, None), (4, texts[4])])
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(0, 1, marks[0]), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    scores = model.score(texts)
    assert ((scores >= 0.5) == np.array(marks, bool)).mean() > 0.95
    assert toxicity.train(df.repartition(5), labels) == model
    empty = toxicity.train(df, labels.limit(0))
    assert (empty.score(texts[:5]) < 0.5).all()
    assert df.limit(0).select(toxicity.score(model)).count() == 0


def test_long_texts_are_read_whole(spark, labelled):
    texts, marks = labelled
    rng = random.Random(5)
    long = prose(rng, 15000)
    # Long texts of either class are in training, whole.
    longer = [f"{prose(rng, 2000)} {t}" if i % 40 in (0, 1) else t for i, t in enumerate(texts)]
    rows = training(spark, longer, marks)
    assert {r.text for r in toxicity.training_rows(rows, rows).collect()} == set(longer)
    model = toxicity.train_on(training(spark, texts, marks))
    assert model.score([long + " wretched dolt vermin"])[0] > model.score([long])[0]


SECRETS = [
    None, "", "nothing", 'password = "hunter2hunter2"', "token:short", "api_key=abcd1234== secret==xyz12345", "AKIA" + "A1" * 8, "AKIA123",
    "é " + "0123456789abcdef" * 2, "f" * 31, "0" * 100000, "APIKEY : 'aaaaaaaa' PassWD=bbbbbbbbb", "ſecret=aaaaaaaaaaaa",
    "x" * 50000,
]


def brute_secrets(text):
    plain = {
        "assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
    }
    enough = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(plain.items()) for m in re.finditer(p, text) if enough[k](m)]
    return sorted(spans)


def slow_pairs(words):
    counts = np.zeros((secret_scan.SIZE, secret_scan.SIZE), np.int64)
    for word in words:
        for a, b in zip(word, word[1:]):
            counts[secret_scan.ALPHABET.index(a), secret_scan.ALPHABET.index(b)] += 1
    return counts.ravel()


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_pairs_and_means_by_brute_force(monkeypatch, stretch):
    monkeypatch.setattr(secret_scan, "STRETCH", stretch)
    rng = random.Random(stretch)
    ratio = np.random.default_rng(0).normal(size=(secret_scan.SIZE, secret_scan.SIZE))
    for text in ["", "a", "é", "a.b", "abcdefgh", "ab" * 300] + ["".join(rng.choices("abcXYZ019+/_=-. é\n\U0001f600", k=400)) for _ in range(20)]:
        words = re.findall(r"[A-Za-z0-9+/_=-]+", text)
        assert (secret_scan.pairs(text) == slow_pairs(words)).all()
        found = [np.mean([ratio[secret_scan.CODE[a], secret_scan.CODE[b]] for a, b in zip(w, w[1:])]) for w in words if len(w) >= 8]
        bins = np.zeros(secret_scan.BINS, np.int64)
        for mean in found:
            bins[int((mean - secret_scan.LOW) / (secret_scan.HIGH - secret_scan.LOW) * secret_scan.BINS)] += 1
        assert np.abs(np.cumsum(secret_scan.means(text, ratio)) - np.cumsum(bins)).max() <= 1  # a mean at the edge of a bin


def test_training_adds_up_all_texts(spark, docs, monkeypatch):
    """Words at the end of a long text and in every row count, caught strings with the other model."""
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 1) for _ in range(3000)) + " zzzzqq secret=Ab12Cd34Ef " + "0" * 40, "zzzzqq", "", None, "zzzzqq"]
    seen = {}
    monkeypatch.setattr(secret_scan, "ratios", lambda caught, ordinary: seen.update(c=caught, o=ordinary) or np.zeros((secret_scan.SIZE,) * 2))
    secret_scan.train(docs(list(enumerate(texts))))
    assert (seen["c"] == slow_pairs(["Ab12Cd34Ef", "0" * 40])).all()
    assert (seen["o"] == slow_pairs([*texts[0].replace("secret=Ab12Cd34Ef", "").replace("0" * 40, "").split(), "zzzzqq", "zzzzqq"])).all()


def test_secrets(spark, docs):
    rng = random.Random(1)
    words = " ".join(prose(rng, 1) + prose(rng, 1) for _ in range(500))
    ratio = secret_scan.ratios(np.zeros(secret_scan.SIZE**2), secret_scan.pairs(words))
    model = secret_scan.calibrated(ratio, secret_scan.means(words, ratio))
    df = docs(list(enumerate(SECRETS)) + [(3, SECRETS[3])])
    for row in df.select("text", secret_scan.find(model).alias("s")).collect():
        got = [(s.start, s.rank, s.end, s.kind) for s in row.s if s.kind in secret_scan.BASE]
        assert got == brute_secrets(row.text or ""), row.text
    key = "".join(rng.choices(secret_scan.ALPHABET[:62], k=40))
    found = model.spans(f"use {key} now {'tarokensulponive' * 2}1")
    assert [(s, e) for s, _, e, k in found if k == "random"] == [(4, 44)]
    drawn = lambda letters, n: sum(bool(model.spans("".join(rng.choices(letters, k=n)))) for _ in range(200))
    assert drawn(secret_scan.ALPHABET[:62], 40) > 190
    assert drawn(secret_scan.ALPHABET[:52], 16) > 190  # short ones, and ones without a digit, are judged too
    assert not [s for s in model.spans(" ".join(prose(rng, 1) for _ in range(2000))) if s[3] == "random"]
    trained = secret_scan.train(df)
    assert df.limit(0).select(secret_scan.find(trained)).count() == 0 and secret_scan.train(df.limit(0)).bar > 0


PAGES = {
    "<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three<p>x &lt;b&gt;"
    "</article><footer>f</footer></body></html>": "A & B\nOne two three\nx <b>",
    "<body><article><p>First words here.</p><div class='ad'>Buy now</div><aside>side</aside><p>Last.</p><section id=comments><p>c"
    "</section></article><form>f</form></body>": "First words here.\nLast.",
    "<article><script>var t='</p>';</script><style>p{}</style><!-- no --><p>a < b &nbsp; c</article>": "a < b c",
    "<article><ul><li>x<li>y</ul><p>é&#233;</p></article>": "x\ny\néé",
    "<div><p>Plain page without an article element at all.</p></div>": "Plain page without an article element at all.",
    "<article></article>": "", "": "", "<<<>>>": "", "<article": "", "<p": "",
}


def test_page_text(spark):
    weights = html_text.weigh(sum(map(html_text.count, [p for p in PAGES if "<article>" in p]), html_text.Counter()))
    rows = [(i, p, "u") for i, p in enumerate(PAGES)] + [(98, None, None), (99, "<p>" + "w " * 200000, "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    for w in (weights, html_text.PLAIN):
        got = {r.page_id: r.t for r in df.select("page_id", html_text.main_text(w).alias("t")).collect()}
        for i, (page, text) in enumerate(PAGES.items()):
            if text or page != "<<<>>>":
                assert got[i] == text, page
        assert got[98] == "" and len(got[99]) == 399999
    assert html_text.train(df.limit(0)) == html_text.PLAIN
    assert html_text.train(df).words["article"] > 0


def slow_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, docs):
    texts = [None, "", " \t\n", "One", "ÄB two", "a b c", "A B C", "a b c d e", "w " * 30000, "x y z " * 50]
    df = docs(list(enumerate(texts)))
    got = {r.doc_id: r.f for r in df.select("doc_id", simhash.fingerprint().alias("f")).collect()}
    assert all(got[i] % (1 << 64) == slow_print(t) for i, t in enumerate(texts))


def union(values, linked):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("group", [2, 256])
def test_links_lose_nothing(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(group)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for centre in [rng.getrandbits(64) for _ in range(4)]:  # dense groups, and chains of links
        walk = centre
        for _ in range(120):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                walk ^= 1 << bit
            prints.add(walk)
            prints.add(centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    values = np.array(sorted(prints), np.uint64)
    signed = values.view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = components(simhash.links(df)).collect()
    linked = [
        (signed[i], signed[j]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1
    ]
    expected = union(signed, linked)
    found = {v: v for v in signed} | {r.node: r.component for r in got}
    assert found == expected


def ran(df):
    """The plan that ran: joins are chosen anew by the sizes met on the way."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_and_stars_are_not_broadcast(spark):
    """The 66 variants of a fingerprint seem as small as the fingerprint; they may not pass through the driver."""
    from lamplight.llm.components import _large_star, _small_star

    prints = spark.range(1000).selectExpr("xxhash64(id) AS fp")
    assert "SortMergeJoin [key" in ran(simhash.links(prints))
    edges = spark.range(1, 50).selectExpr("id AS a", "id - 1 AS b")
    assert "BroadcastHashJoin" not in ran(_large_star(edges)) + ran(_small_star(edges))


def test_variants_of_one_fingerprint_alone_are_not_moved(spark):
    """66 variants of each of 1,000 fingerprints, of which two are near: before, all were dealt out once more to be joined."""
    prints = spark.range(1000).selectExpr("xxhash64(id) AS fp").unionByName(spark.range(1).selectExpr("shiftleft(1L, 40) ^ xxhash64(7L) AS fp"))
    links = simhash.links(prints)
    (pair,) = links.collect()
    assert bin((pair.a ^ pair.b) & (1 << 64) - 1).count("1") == 1
    assert "bloom__block" in links._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_edge_cases(spark, docs):
    rows = [(5, "same text here now"), (3, "same text here now"), (3, "same text here now"), (None, "same text here now"), (7, None), (8, ""), (9, "other words")]
    df = docs(rows)
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect()))
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 9)]
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.one_of_each(df.limit(0)).count()
    alone = docs([(None, "a b c"), (None, "a b c")])
    assert simhash.one_of_each(alone).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 300), (500, 500), (None, 1), (300, 500), (900, 901)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 300, 300: 300, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert components(star).filter("component <> 0").count() == 0
