"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.llm import (
    centroids, decontamination, hard_negatives, html_text, packing, pii, repeats, secret_scan, sharding, simhash, toxicity, url_filter,
    vector_search,
)
from lamplight.llm.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


SHARDS = [f"shard-{i:02d}" for i in range(32)]
SLOTS = 4099

_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
SHARDING_SQL = f"""WITH RECURSIVE orders AS (
  SELECT list({_HASH.format("name || '/offset'")} % {SLOTS} ORDER BY name) AS o,
         list({_HASH.format("name || '/skip'")} % {SLOTS - 1} + 1 ORDER BY name) AS k
  FROM (SELECT 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i))),
claims AS (
  SELECT 0 AS turn, [-1 FOR x IN range({SLOTS})] AS held, [0 FOR x IN range({len(SHARDS)})] AS tried, 0 AS picked FROM orders
  UNION ALL
  SELECT turn + 1,
    list_transform(held, lambda h, s: CASE WHEN s = slot + 1 THEN who ELSE h END),
    list_transform(tried, lambda n, i: CASE WHEN i = who + 1 THEN j + 1 ELSE n END), slot
  FROM (SELECT *, (o[who + 1] + j * k[who + 1]) % {SLOTS} AS slot FROM (
    SELECT turn, held, tried, o, k, turn % {len(SHARDS)} AS who,
      list_filter(range(tried[turn % {len(SHARDS)} + 1], {SLOTS}),
        lambda j: held[(o[turn % {len(SHARDS)} + 1] + j * k[turn % {len(SHARDS)} + 1]) % {SLOTS} + 1] = -1)[1] AS j
    FROM claims, orders WHERE turn < {SLOTS}))),
lookup AS (SELECT picked AS slot, (turn - 1) % {len(SHARDS)} AS shard FROM claims WHERE turn > 0)
SELECT doc_id, slot::INTEGER AS slot, shard::INTEGER AS shard
FROM (SELECT doc_id, {_HASH.format("doc_id::VARCHAR")} % {SLOTS} AS slot FROM documents) JOIN lookup USING (slot)"""


@query("op2_sharding", SHARDING_SQL)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], SHARDS, SLOTS).withColumnRenamed("shard_slot", "slot")


_PII_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_PII_KINDS = " UNION ALL ".join(
    f"""SELECT doc_id, body, {rank} AS rank, '{kind}' AS kind, {pii.SCORES[kind]}::DOUBLE AS score, '{pii.CONTEXT_WORDS[kind]}' AS words,
    regexp_extract_all(body, '{pattern}', 0) AS hits, string_split_regex(body, '{pattern}') AS gaps FROM d"""
    for rank, (kind, pattern) in enumerate(_PII_PLAIN.items())
)
PII_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS (SELECT *, len(hit) AS width FROM (
  SELECT doc_id, body, rank, kind, score, words, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i
  FROM ({_PII_KINDS}))),
placed AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS plain,
  (sum(len(gap) + width) OVER (PARTITION BY doc_id, kind ORDER BY i) - width)::BIGINT AS first FROM found),
near AS (SELECT * REPLACE (score + CASE WHEN regexp_matches(lower(substr(body, greatest(first - {pii.CONTEXT}, 0)::BIGINT + 1,
    (first - greatest(first - {pii.CONTEXT}, 0))::BIGINT)), words) THEN {pii.LIFT} ELSE 0 END AS score) FROM placed),
kept AS (SELECT doc_id, rank, kind, first, score, kind || ':' || first || ':' || (first + width) AS span FROM near WHERE CASE kind
  WHEN 'ip' THEN regexp_matches(hit, '{pii.IP_PARTS}')
  WHEN 'card' THEN len(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(digits) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN substr(reverse(digits), i, 1)::INT
    ELSE substr(reverse(digits), i, 1)::INT * 2 - CASE WHEN substr(reverse(digits), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN len(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN list_reduce(list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''), lambda c:
    CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END),
    lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
  WHEN 'ssn' THEN score >= {pii.LEAST_SCORE} AND substr(body, first::BIGINT, 1) <> '-' AND substr(body, (first + width + 1)::BIGINT, 1) <> '-'
  ELSE true END)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
  sha256(coalesce(string_agg(span, ',' ORDER BY first, rank) FILTER (rank < {len(pii.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY first, rank), '') AS spans, coalesce(max(score), 0) AS highest_score
FROM d LEFT JOIN kept USING (doc_id) GROUP BY doc_id"""


@query("op9_pii", PII_SQL)
def _(spark, folder):
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("highest_score"),
    )


@query("op7_toxicity")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").filter(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    scored = docs.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op10_secrets")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secret_scan.find(secret_scan.train(docs)).alias("secrets"))
    base = F.filter("secrets", lambda s: s["rank"] < len(secret_scan.BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secret_scan.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("secrets")).alias("spans"), count("random"),
    )


@query("op4_html_text")
def _(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    weights = html_text.train(pages)
    texts = pages.select("page_id", "url", html_text.main_text(weights).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op6_simhash")
def _(spark, folder):
    rows = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query("op1_packing")
def _(spark, folder):
    return packing.sequences(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])


@query("op8_decontamination")
def _(spark, folder):
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SEARCH_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query("op5_vector_search", SEARCH_SQL)
def _(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vector_search.top_k(rows.filter(F.pmod("vec_id", F.lit(100)) == 0), rows, 10)


@query("op3_repeats")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = repeats.remove_repeats(docs, keep_first=False, with_kept=False)
    return done.select("doc_id", *[f"repeats.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


#: Rules of hosts with their subdomains and of what the path starts with.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A page with one of these words in its host puts its canonical URL on the list.
LISTED_HOSTS = r"(^|[.-])(casino|bets|pills)([.-]|$)"

_VALUES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
_PART = "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', {}), '')"
URLS_SQL = rf"""WITH p AS (SELECT page_id, translate({_PART.format(1)}, '{url_filter._UPPER}', '{url_filter._LOWER}') AS host,
  {_PART.format(2)} AS path, list_sort(list_filter(string_split({_PART.format(3)}, '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^({url_filter.TRACKING})(=|$)'))) AS told FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^({url_filter.ALIASES})\.', '') || regexp_replace(path, '/$', '')
  || CASE WHEN len(told) > 0 THEN '?' || array_to_string(told, '&') ELSE '' END AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE host <> '' AND regexp_matches(host, '{LISTED_HOSTS}')),
rules(rule_host, rule_path, verdict) AS (VALUES {_VALUES}),
fits AS (SELECT DISTINCT host, path, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule,
    arg_max(verdict, len(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM c) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, c.host, c.path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN listed.canonical IS NOT NULL AND c.host <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN fits ON c.host = fits.host AND c.path = fits.path LEFT JOIN listed ON c.canonical = listed.canonical"""


@query("op11_url_filter", URLS_SQL)
def _(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(host, path, verdict)")
    listed = pages.select("url").filter(url_filter.host_of("url").rlike(LISTED_HOSTS))
    return url_filter.judge(pages, rules, listed).select("page_id", "judged.*")


def _rounds(rounds: int, k: int) -> str:
    """SQL of all rounds, one after the other, for the SQL twin."""
    steps = []
    near = "SELECT v.n, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.n, j, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{} c) v GROUP BY v.n"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT j, unnest(v.v)::BIGINT AS x, generate_subscripts(v.v, 1) AS i FROM v JOIN a{r} USING (n)) GROUP BY j, i) GROUP BY j) m USING (j))"""
        )
    steps.append(f"a AS MATERIALIZED ({near.format(rounds)})")
    return ",\n".join(steps)


CENTROIDS_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8)),
{_rounds(10, 8)}
SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c10.c, ',')) AS centroid_sha256
FROM a JOIN v USING (n) JOIN c10 ON a.j = c10.j"""


@query("op12_centroids", CENTROIDS_SQL)
def _(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))


NEGATIVES_SQL = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def _(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), vector_search.digits("embedding", 256).alias("v"))
    return hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0"), id="vec_id")


@query("pipeline")
def _(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
