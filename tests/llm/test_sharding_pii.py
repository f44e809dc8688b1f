from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamplight.llm import pii, sharding


def brute_table(shards, slots):
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = [(h(f"{s}/offset") % slots, h(f"{s}/skip") % (slots - 1) + 1) for s in shards]
    held, tried = [-1] * slots, [0] * len(shards)
    for turn in range(slots):
        i = turn % len(shards)
        while held[(order[i][0] + tried[i] * order[i][1]) % slots] >= 0:
            tried[i] += 1
        held[(order[i][0] + tried[i] * order[i][1]) % slots] = i
    return held


def test_table_is_filled_in_turns(spark):
    shards = [f"s{i}" for i in range(5)]
    got = [r.shard for r in sharding.lookup_table(spark, shards, 101).orderBy("slot").collect()]
    assert got == brute_table(shards, 101)
    assert max(Counter(got).values()) - min(Counter(got).values()) <= 1


def test_a_lost_shard_moves_little(spark):
    shards = [f"s{i}" for i in range(10)]
    full = [shards[r.shard] for r in sharding.lookup_table(spark, shards, 1009).orderBy("slot").collect()]
    less = [shards[:9][r.shard] for r in sharding.lookup_table(spark, shards[:9], 1009).orderBy("slot").collect()]
    moved = sum(a != b for a, b in zip(full, less) if a != "s9")
    assert moved < 0.25 * 1009


def test_place_keeps_rows(spark, docs):
    df = docs([(1, "a"), (1, "a"), (None, None), (2, "")])
    got = sharding.place(df, ["doc_id"], ["a", "b"], 11).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.place(docs([]), ["doc_id"], ["a", "b"], 11).count() == 0
    with pytest.raises(ValueError):
        sharding.place(df, ["doc_id"], ["a"], 11, to="lang")


@pytest.mark.parametrize("shards, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(spark, shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, shards, slots)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


TEXTS = [
    None, "", "no data", "a@b.c_x@d.e", "x" * 5000, "1" * 20000, "9." * 3000, "mail me: é.ü@x.de, jo.e@mail-x.co.uk.",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.000255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "+49 (30) 1234-5678 +1 +123456789012345678", "😀 a@b.co 😀 10.0.0.1 +1 (323) 555-9830", "a@b", "@@a@b.c@d.e",
    "4111111111111111 4111111111111111", "+1.2.3.4.5.6.7.8.9 5500 0000 0000 0004",
]


def test_base_spans(spark, docs):
    df = docs(list(enumerate(TEXTS)) + [(13, TEXTS[13])])
    for row in pii.find(df).collect():
        got = [f"{s.kind}:{s.start}:{s.end}" for s in row.pii if s.kind in pii.BASE]
        assert got == brute(row.text or ""), row.text
    assert pii.find(docs([])).count() == 0
    with pytest.raises(ValueError):
        pii.find(df, to="lang")


def test_checksums_and_context(spark, docs):
    rows = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "no 123-45-6789"]
    found = pii.find(docs(list(enumerate(rows)))).orderBy("doc_id").collect()
    kinds = [[s.kind for s in r.pii if s.kind not in pii.BASE] for r in found]
    assert kinds == [["iban"], [], ["ssn"], []]
    near, far = "phone: +49 30 12345678", "x +49 30 12345678"
    scores = [r.pii[0].score for r in pii.find(docs([(0, near), (1, far)])).orderBy("doc_id").collect()]
    assert scores[0] > scores[1]


def test_redact(spark, docs):
    df = docs([(1, "to a@b.co and 10.0.0.1!"), (2, None), (3, ""), (4, "+4111111111111111 x")])
    got = pii.redact(df)
    assert got.columns == df.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["to <email> and <ip>!", None, "", "+<card> x"]


def test_many_spans_in_one_text(spark, docs):
    """Offsets, context and replacement over many pieces of text; the time bound would not hold for square work."""
    part = "é mail a.b@c.de, phone 😀 +49 30 1234-5678; 10.0.0.1 x" + "lorem " * 9
    text = part * 5400  # 16,200 base spans
    began = time.monotonic()
    row = pii.find(docs([(0, text)])).collect()[0]
    assert [f"{s.kind}:{s.start}:{s.end}" for s in row.pii if s.kind in pii.BASE] == brute(text)
    for s in row.pii:
        near = re.search(pii.CONTEXT_WORDS[s.kind], text[max(0, s.start - pii.CONTEXT) : s.start].lower())
        assert s.score == pii.SCORES[s.kind] + (pii.LIFT if near else 0.0)
    clean = pii.redact(docs([(0, text)])).collect()[0].text
    assert clean == ("é mail <email>, phone 😀 <phone>; <ip> x" + "lorem " * 9) * 5400
    assert time.monotonic() - began < 60


def test_spans_at_edges_of_pieces(spark, docs):
    sizes = [1, 2, 3, 10, 255, 256, 257, 700]
    texts = ["y" * (n - 1) + " a@b.co" + " " * n + "+49 30 12345678" + "z" * n for n in sizes]
    df = docs(list(enumerate(texts)))
    for row in pii.find(df).collect():
        got = [f"{s.kind}:{s.start}:{s.end}" for s in row.pii]
        assert got == brute(row.text) and len(got) == 2
    for row in pii.redact(df).collect():
        assert row.text == texts[row.doc_id].replace("a@b.co", "<email>").replace("+49 30 12345678", "<phone>")


def test_no_python_in_the_plan(spark, docs):
    df = docs([(1, "a@b.co")])
    for made in (pii.find(df), pii.redact(df), sharding.place(df, ["doc_id"], ["a", "b"], 11)):
        plan = made._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_luhn_and_mod97(spark):
    rows = spark.createDataFrame([("79927398713", "GB82WEST12345698765432"), ("79927398710", "GB82WEST12345698765433")], "a string, b string")
    assert [tuple(r) for r in rows.select(pii.luhn(F.col("a")), pii.mod97(F.col("b"))).collect()] == [(True, True), (False, False)]
