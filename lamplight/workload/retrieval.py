"""Retrieval operators over the documents that have a vector."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lamplight.functions import providers, ranking, vectors
from lamplight.operators import fusion, neighbours, scoring
from lamplight.operators.scoring import Question
from lamplight.plans import search
from lamplight.session import stored
from lamplight.sources import standins as view
from lamplight.sources.standins import sql_squash, sql_strip, sql_token, sql_words, with_views
from lamplight.workload.register import query

ASKED = "the thion erand onthe"
VECTOR_ID = 7
CHANNEL = "en"
K = ranking.CANDIDATES

_COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


def question(spark, folder) -> Question:
    """The standing question: the vector of one document and four words."""
    row = view.table(spark, folder, "embeddings").where(F.col("vec_id") == VECTOR_ID).select("embedding").first()
    sparse = {}
    for word in ASKED.split():
        token = providers.token_id(word)
        sparse[token] = sparse.get(token, 0.0) + 1.0
    return Question(0, ASKED, tuple(row["embedding"]), sparse)


def _scoped(spark, folder):
    return search.in_scope(view.corpus(spark, folder), CHANNEL)


def sql_dense(vector: str = f"(SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID})", where: str = f"channel_id = '{CHANNEL}'") -> str:
    """Dense arm as (id, dense_rank, score)."""
    return f"""SELECT id, score, row_number() OVER (ORDER BY score, id) AS dense_rank
        FROM (SELECT id, round(1 - {_COSINE.format("embedding", vector)}, 9) AS score FROM corpus WHERE {where})
        QUALIFY dense_rank <= {K}"""


ASKED_TOKENS = f"asked AS (SELECT {sql_token('word')} AS token, count(*) AS w FROM (SELECT unnest({sql_words(repr(ASKED))}) AS word) GROUP BY 1)"


def sql_sparse(zero: bool = True, where: str = f"channel_id = '{CHANNEL}'") -> str:
    scores = f"""SELECT p.id, round(-sum(tf * w), 9) AS score FROM postings p JOIN asked a ON p.token = a.token
        WHERE {where} GROUP BY p.id"""
    if zero:
        scores = f"""SELECT c.id, coalesce(s.score, 0) AS score FROM (SELECT * FROM corpus WHERE {where}) c LEFT JOIN ({scores}) s ON c.id = s.id"""
    return f"""SELECT id, score, row_number() OVER (ORDER BY score, id) AS sparse_rank FROM ({scores})
        QUALIFY sparse_rank <= {K}"""


def sql_fused(alpha: float = 0.5, rrf_k: int = 60) -> str:
    return f"""SELECT id, max(dense_rank) AS dense_rank, max(sparse_rank) AS sparse_rank,
            coalesce({alpha}::DOUBLE * (1::DOUBLE / ({rrf_k} + max(dense_rank))), 0)
            + coalesce({1.0 - alpha}::DOUBLE * (1::DOUBLE / ({rrf_k} + max(sparse_rank))), 0) AS rrf
        FROM (SELECT id, dense_rank, NULL AS sparse_rank FROM dense UNION ALL SELECT id, NULL, sparse_rank FROM sparse)
        GROUP BY id"""


def hybrid_sql(
    body: str, *more: str, alpha: float = 0.5, zero: bool = True, where: str = f"channel_id = '{CHANNEL}'",
    vector: str = f"(SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID})",
) -> str:
    steps = [
        ASKED_TOKENS,
        f"dense AS ({sql_dense(vector, where)})",
        f"sparse AS ({sql_sparse(zero, where)})",
        f"fused AS ({sql_fused(alpha)})",
        *more,
    ]
    return with_views(["corpus", "postings"], "").rstrip() + ", " + ", ".join(steps) + "\n" + body


# Vector functions ------------------------------------------------------------------


@query(
    "fn_01_cosine_distance",
    f"""SELECT a.vec_id, round(1 - {_COSINE.format("a.embedding", "b.embedding")}, 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, folder):
    e = view.table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance")
    )


@query(
    "fn_03_blend_unit",
    """WITH m AS (SELECT a.vec_id, list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
              lambda p: 0.7::DOUBLE * p[1] + 0.3::DOUBLE * p[2]) AS v
              FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(CAST(CAST(v[1] / sqrt(list_inner_product(v, v)) AS FLOAT) AS DOUBLE), 5) AS first,
           round(CAST(CAST(v[64] / sqrt(list_inner_product(v, v)) AS FLOAT) AS DOUBLE), 5) AS last FROM m""",
)
def _(spark, folder):
    e = view.table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    rows = e.join(nxt, "vec_id").withColumn("mixed", vectors.blend(F.col("embedding"), F.col("other"), 0.3))
    rows = rows.select("vec_id", vectors.unit(F.col("mixed")).alias("v"))
    return rows.select(
        "vec_id",
        F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"),
        F.round(F.get("v", F.lit(63)).cast("double"), 5).alias("last"),
    )


@query(
    "agg_05_centroids",
    """SELECT label, nth - 1 AS nth, round(avg(x), 6) AS mean
    FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS nth FROM embeddings)
    GROUP BY label, nth""",
)
def _(spark, folder):
    means = search.centroid(view.table(spark, folder, "embeddings"), key="label")
    return means.select("label", F.posexplode("centroid").alias("nth", "mean")).withColumn("mean", F.round("mean", 6))


@query(
    "fn_32_sparse_weights",
    with_views(["corpus", "postings"], "SELECT id, token::BIGINT AS token, tf AS weight FROM postings"),
)
def _(spark, folder):
    rows = view.corpus(spark, folder)
    texts = F.transform_keys("sparse_embedding", lambda k, _: k.cast("string"))
    return rows.select("id", F.explode(vectors.int_keys(texts)).alias("token", "weight")).select(
        "id", F.col("token").cast("long").alias("token"), F.col("weight").cast("double").alias("weight")
    )


@query(
    "fn_02_sparse_products",
    with_views(
        ["corpus", "postings"],
        """SELECT a.id, round(sum(a.tf * b.tf), 4) AS product FROM postings a JOIN postings b
        ON b.id = a.id + 1 AND a.token = b.token GROUP BY a.id""",
    ),
)
def _(spark, folder):
    rows = stored(view.corpus(spark, folder).select("id", "sparse_embedding"), "sparse")  # embedded once for both sides
    nxt = rows.select((F.col("id") - 1).alias("id"), F.col("sparse_embedding").alias("other"))
    product = vectors.sparse_dot(F.col("sparse_embedding"), F.col("other"))
    return rows.join(nxt, "id").select("id", F.round(product, 4).alias("product")).where("product > 0")


@query(
    "fn_05_reciprocal_rank",
    """SELECT o_orderkey, round(coalesce(0.7::DOUBLE / (60 + d), 0) + coalesce(0.3::DOUBLE / (60 + s), 0), 9) AS score
    FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 50 + 1 END AS d,
                 CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey % 50 + 1 END AS s FROM orders)""",
)
def _(spark, folder):
    dense = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 50 + 1)
    sparse = F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderkey") % 50 + 1)
    score = ranking.reciprocal_rank(dense, sparse, alpha=0.7)
    return view.table(spark, folder, "orders").select("o_orderkey", F.round(score, 9).alias("score"))


@query("fn_06_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value / 10 - 3))), 9) AS score FROM events")
def _(spark, folder):
    score = ranking.sigmoid(F.col("value") / 10 - 3)
    return view.table(spark, folder, "events").select("event_id", F.round(score, 9).alias("score"))


# Arms ------------------------------------------------------------------------------


@query(
    "topk_01_dense",
    with_views(["corpus"], "").rstrip() + f", dense AS ({sql_dense()}) SELECT id, dense_rank AS rank, round(score, 6) AS score FROM dense",
)
def _(spark, folder):
    found = scoring.candidates(_scoped(spark, folder), [question(spark, folder)], K, sparse=False)
    return scoring.ranked(found, K).select("id", "rank", F.round("score", 6).alias("score"))


@query(
    "topk_02_sparse",
    with_views(["corpus", "postings"], "").rstrip() + f", {ASKED_TOKENS}, sparse AS ({sql_sparse()}) SELECT id, sparse_rank AS rank, score FROM sparse",
)
def _(spark, folder):
    found = scoring.candidates(_scoped(spark, folder), [question(spark, folder)], K, dense=False)
    return scoring.ranked(found, K).select("id", "rank", (F.col("score") + 0.0).alias("score"))


@query(
    "topk_02_sparse_zero_overlap",
    with_views(["corpus", "postings"], "").rstrip()
    + f", {ASKED_TOKENS}, sparse AS ({sql_sparse(True, where='channel_id = $$fr$$')}) SELECT id, sparse_rank AS rank, score FROM sparse",
)
def _(spark, folder):
    french = search.in_scope(view.corpus(spark, folder), "fr")
    found = scoring.candidates(french, [question(spark, folder)], K, dense=False, zero_overlap=True)
    return scoring.ranked(found, K).select("id", "rank", (F.col("score") + 0.0).alias("score"))


@query(
    "src_14_postings_scan",
    with_views(["corpus", "postings"], "").rstrip()
    + f", {ASKED_TOKENS} SELECT p.id, sum(tf * w)::DOUBLE AS product FROM postings p JOIN asked a ON p.token = a.token GROUP BY p.id",
)
def _(spark, folder):
    # The inverted form of the sparse arm: postings joined with the question's tokens.
    asked = question(spark, folder).sparse
    tokens = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])
    rows = view.corpus(spark, folder).select("id", F.explode("sparse_embedding").alias("token", "tf"))
    weighed = rows.withColumn("w", F.try_element_at(tokens, F.col("token"))).where(F.col("w").isNotNull())
    return weighed.groupBy("id").agg(F.sum(F.col("tf") * F.col("w")).alias("product"))


# Fusion ----------------------------------------------------------------------------


@query("agg_01_fused_ranks", hybrid_sql("SELECT id, dense_rank, sparse_rank FROM fused"))
def _(spark, folder):
    fused = search.first_stage(_scoped(spark, folder), [question(spark, folder)])
    return fused.select("id", "dense_rank", "sparse_rank")


@query("set_01_union_padded", hybrid_sql("SELECT id, dense_rank, NULL AS sparse_rank FROM dense UNION ALL SELECT id, NULL, sparse_rank FROM sparse"))
def _(spark, folder):
    found = scoring.candidates(_scoped(spark, folder), [question(spark, folder)], K)
    ranks = scoring.ranked(found, K)
    dense = ranks.where("arm = 'dense'").select("id", F.col("rank").alias("dense_rank"))
    sparse = ranks.where("arm = 'sparse'").select("id", F.col("rank").alias("sparse_rank"))
    return dense.unionByName(sparse, allowMissingColumns=True)


_POOL = "pool AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, id) AS fused_rank FROM fused QUALIFY fused_rank <= {})"


@query(
    "topk_03_fused_pool",
    hybrid_sql("SELECT id, fused_rank, round(rrf, 9) AS rrf_score FROM pool", _POOL.format(90), alpha=0.7),
)
def _(spark, folder):
    fused = search.first_stage(_scoped(spark, folder), [question(spark, folder)], alpha=0.7)
    pool = fusion.fused_pool(fused, fusion.pool_size(30, K, rerank=True))
    return pool.select("id", "fused_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(
    "join_01_hydrate",
    hybrid_sql(
        "SELECT p.id, c.report_id, c.page_number, c.chunk_index, md5(c.content) AS content_md5 FROM pool p JOIN corpus c ON p.id = c.id",
        _POOL.format(50),
    ),
)
def _(spark, folder):
    corpus = _scoped(spark, folder)
    fused = search.first_stage(corpus, [question(spark, folder)])
    rows = fusion.hydrate(fusion.fused_pool(fused, 50), corpus, bounded=True)
    return rows.select("id", "report_id", "page_number", "chunk_index", F.md5("content").alias("content_md5"))


_LOGIT = f"""4.0::DOUBLE * (len(list_intersect(list_distinct({sql_words(repr(ASKED))}), {sql_words("c.content")})) / 4.0::DOUBLE - 0.5)"""

_RERANKED = f"""reranked AS (SELECT p.id, p.fused_rank, p.rrf, 1 / (1 + exp(-({_LOGIT}))) AS score FROM pool p JOIN corpus c ON p.id = c.id),
    hits AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, fused_rank) AS primary_rank FROM reranked QUALIFY primary_rank <= 10)"""


@query(
    "rrk_01_rerank",
    hybrid_sql("SELECT id, primary_rank, round(score, 9) AS rerank_score FROM hits", _POOL.format(50), _RERANKED),
)
def _(spark, folder):
    corpus = _scoped(spark, folder)
    fused = search.first_stage(corpus, [question(spark, folder)])
    rows = fusion.hydrate(fusion.fused_pool(fused, 50), corpus, bounded=True)
    hits = fusion.rerank(rows, providers.OverlapReranker(), 10, F.lit(ASKED))
    return hits.select("id", "primary_rank", F.round("rerank_score", 9).alias("rerank_score"))


@query(
    "rrk_02_no_reranker",
    hybrid_sql("SELECT id, fused_rank AS primary_rank, NULL AS rerank_score FROM pool", _POOL.format(10)),
)
def _(spark, folder):
    corpus = _scoped(spark, folder)
    fused = search.first_stage(corpus, [question(spark, folder)])
    rows = fusion.hydrate(fusion.fused_pool(fused, 50), corpus, bounded=True)
    hits = fusion.rerank(rows, None, 10)
    return hits.select("id", "primary_rank", "rerank_score")


# Neighbours ------------------------------------------------------------------------

_ORDERED = "ordered AS (SELECT id, report_id, row_number() OVER (PARTITION BY report_id ORDER BY page_number, chunk_index) AS pos FROM corpus)"


def sql_around(n: int) -> str:
    return f"""
    placed AS (SELECT h.id AS parent_id, h.primary_rank, o.report_id, o.pos FROM hits h JOIN ordered o ON h.id = o.id),
    near AS (SELECT p.parent_id, p.primary_rank, o.id, o.report_id, o.pos - p.pos AS off
             FROM placed p JOIN ordered o ON o.report_id = p.report_id AND o.pos BETWEEN p.pos - {n} AND p.pos + {n}
             WHERE o.id = p.parent_id OR o.id NOT IN (SELECT id FROM hits)),
    shown AS (SELECT id, off <> 0 AS is_neighbour, CASE WHEN off <> 0 THEN parent_id END AS neighbour_of, primary_rank, report_id,
                     row_number() OVER (ORDER BY first_rank, primary_rank, off) AS position
              FROM (SELECT *, min(primary_rank) OVER (PARTITION BY report_id) AS first_rank FROM near))"""


_HITS = "hits AS (SELECT id, fused_rank AS primary_rank, rrf FROM pool WHERE fused_rank <= 10)"


@query(
    "ret_01_hybrid_query",
    hybrid_sql(
        """SELECT s.id, s.report_id, s.is_neighbour, s.neighbour_of, s.primary_rank, s.position,
           CASE WHEN NOT s.is_neighbour THEN round(h.rrf, 9) END AS rrf_score,
           CASE WHEN NOT s.is_neighbour THEN round(h.score, 9) END AS rerank_score
        FROM shown s LEFT JOIN hits h ON s.id = h.id""",
        _POOL.format(50),
        _RERANKED,
        _ORDERED,
        sql_around(1),
    ),
)
def _(spark, folder):
    rows = search.hybrid_query(
        view.corpus(spark, folder), ASKED, CHANNEL,
        question=question(spark, folder), reranker=providers.OverlapReranker(),
    )
    return rows.select(
        "id", "report_id", "is_neighbour", "neighbour_of", "primary_rank", "position",
        F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 9).alias("rerank_score"),
    )


@query(
    "ret_02_report_scope",
    hybrid_sql(
        "SELECT id, fused_rank AS primary_rank, round(rrf, 9) AS rrf_score FROM pool WHERE fused_rank <= 10",
        _POOL.format(50),
        where="channel_id = 'en' AND id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1')",
    ),
)
def _(spark, folder):
    rows = search.hybrid_query(
        view.corpus(spark, folder), ASKED, CHANNEL,
        question=question(spark, folder), report_id="en/src1", neighbours=0, rerank=False,
    )
    return rows.select("id", "primary_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(
    "ret_03_feedback",
    hybrid_sql(
        "SELECT id, dense_rank FROM again",
        _POOL.format(5),
        """mean AS (SELECT nth, avg(x) AS x FROM (SELECT unnest(CAST(c.embedding AS DOUBLE[])) AS x, generate_subscripts(c.embedding, 1) AS nth
                    FROM pool p JOIN corpus c ON p.id = c.id) GROUP BY nth)""",
        f"""moved AS (SELECT list(0.7::DOUBLE * q.x + 0.3::DOUBLE * m.x ORDER BY m.nth) AS embedding FROM mean m
                 JOIN (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS nth
                       FROM embeddings WHERE vec_id = {VECTOR_ID}) q ON q.nth = m.nth)""",
        f"""again AS (SELECT id, row_number() OVER (ORDER BY score, id) AS dense_rank
                 FROM (SELECT c.id, round(1 - {_COSINE.format("c.embedding", "(SELECT embedding FROM moved)")}, 6) AS score
                       FROM corpus c WHERE channel_id = '{CHANNEL}') QUALIFY dense_rank <= 10)""",
    ),
)
def _(spark, folder):
    corpus = _scoped(spark, folder)
    first = question(spark, folder)
    moved = search.expanded_question(corpus, first, search.first_stage(corpus, [first]), 0.3, 5)
    found = scoring.candidates(corpus, [moved], 10, sparse=False)
    order = Window.orderBy(F.round("score", 6), "id")
    ranks = scoring.ranked(found, 10).withColumn("dense_rank", F.row_number().over(order))
    return ranks.select("id", "dense_rank")


@query("ret_03_feedback_query")
def _(spark, folder):
    rows = search.hybrid_query(
        view.corpus(spark, folder), ASKED, CHANNEL,
        question=question(spark, folder), prf_beta=0.3, neighbours=0, rerank=False,
    )
    return rows.select("id", "primary_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(
    "ret_04_neighbours",
    with_views(["chunks"], "").rstrip()
    + f""", hits AS (SELECT id, report_id, row_number() OVER (ORDER BY id) AS primary_rank FROM chunks WHERE contains(content, 'tion.') ),
    {_ORDERED.replace("FROM corpus", "FROM chunks")}, {sql_around(2)}
    SELECT id, neighbour_of, CAST(count(*) AS BIGINT) AS times FROM shown WHERE is_neighbour GROUP BY ALL""",
)
def _(spark, folder):
    chunks = view.line_chunks(spark, folder)
    hits = chunks.where(F.contains("content", F.lit("tion."))).withColumn("question_id", F.lit(0))
    found = neighbours.neighbour_ids(hits, chunks, 2, bounded=False)
    return found.groupBy("id", F.col("parent_id").alias("neighbour_of")).agg(F.count(F.lit(1)).alias("times"))


@query(
    "join_06_anchors_left_out",
    with_views(["chunks"], "").rstrip()
    + f""", hits AS (SELECT id FROM chunks WHERE contains(content, 'tion.')), {_ORDERED.replace("FROM corpus", "FROM chunks")}
    SELECT a.id AS parent_id, b.id FROM hits a JOIN ordered x ON a.id = x.id
    JOIN ordered y ON x.report_id = y.report_id AND y.pos = x.pos + 1 JOIN chunks b ON b.id = y.id
    WHERE b.id NOT IN (SELECT id FROM hits)""",
)
def _(spark, folder):
    chunks = view.line_chunks(spark, folder)
    hits = chunks.where(F.contains("content", F.lit("tion."))).withColumn("question_id", F.lit(0))
    found = neighbours.neighbour_ids(hits, chunks, 1, bounded=False)
    return found.where("offset = 1").select("parent_id", "id")


# Many questions --------------------------------------------------------------------


def benchmark_questions(spark, folder):
    """Benchmark items that have a vector, each asked in the channel of its document."""
    items = view.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    docs = view.table(spark, folder, "documents").select("doc_id", "lang")
    vecs = view.table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = items.join(docs, "doc_id").join(vecs, "doc_id")
    return rows.select(
        F.col("doc_id").alias("question_id"),
        "text",
        F.col("lang").alias("scope"),
        F.col("embedding").alias("dense"),
        providers.LexicalEmbedder().sparse(F.col("text")).alias("sparse"),
    )


_BATCH = f"""
    q AS (SELECT item_id AS question_id, b.text, lang AS scope, embedding FROM benchmark b
          JOIN documents d ON d.doc_id = item_id JOIN embeddings ON vec_id = item_id),
    asked AS (SELECT question_id, scope, {sql_token("word")} AS token, count(*) AS w
              FROM (SELECT question_id, scope, unnest({sql_words("text")}) AS word FROM q) GROUP BY ALL),
    dense AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score, id) AS dense_rank
              FROM (SELECT question_id, id, round(1 - {_COSINE.format("c.embedding", "q.embedding")}, 9) AS score
                    FROM q JOIN corpus c ON c.channel_id = q.scope) QUALIFY dense_rank <= {K}),
    sparse AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score, id) AS sparse_rank
               FROM (SELECT q.question_id, c.id, coalesce(s.score, 0) AS score FROM q JOIN corpus c ON c.channel_id = q.scope
                     LEFT JOIN (SELECT question_id, p.id, round(-sum(tf * w), 9) AS score FROM asked a JOIN postings p
                                ON p.channel_id = a.scope AND p.token = a.token GROUP BY question_id, p.id) s
                     ON s.question_id = q.question_id AND s.id = c.id) QUALIFY sparse_rank <= {K}),
    fused AS (SELECT question_id, id, coalesce(0.5::DOUBLE * (1::DOUBLE / (60 + max(dense_rank))), 0)
                     + coalesce(0.5::DOUBLE * (1::DOUBLE / (60 + max(sparse_rank))), 0) AS rrf
              FROM (SELECT question_id, id, dense_rank, NULL AS sparse_rank FROM dense
                    UNION ALL SELECT question_id, id, NULL, sparse_rank FROM sparse) GROUP BY question_id, id)"""


@query(
    "ret_01_many_questions",
    with_views(["corpus", "postings"], "").rstrip()
    + f""", {_BATCH} SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, id) AS primary_rank,
        round(rrf, 9) AS rrf_score FROM fused QUALIFY primary_rank <= 10""",
)
def _(spark, folder):
    rows = search.search_table(view.corpus(spark, folder), benchmark_questions(spark, folder))
    return rows.select("question_id", "id", "primary_rank", F.round("rrf_score", 9).alias("rrf_score"))


# Shapes ----------------------------------------------------------------------------


def _wire(spark, folder):
    rows = search.hybrid_query(
        view.corpus(spark, folder), ASKED, CHANNEL,
        question=question(spark, folder), neighbours=1, rerank=False,
    )
    return rows


_SHOWN = (_POOL.format(50), _HITS, _ORDERED, sql_around(1))


@query(
    "prj_02_wire_rows",
    hybrid_sql(
        """SELECT c.report_id, c.page_number, c.chunk_index, c.content, NULL AS rerank_score,
           CASE WHEN NOT is_neighbour THEN round(h.rrf, 9) END AS rrf_score, '' AS section_title, is_neighbour, neighbour_of, position
        FROM shown s JOIN corpus c ON s.id = c.id LEFT JOIN hits h ON h.id = s.id""",
        *_SHOWN,
    ),
)
def _(spark, folder):
    return search.wire_rows(_wire(spark, folder)).withColumn("rrf_score", F.round("rrf_score", 9))


@query(
    "agg_12_result_counts",
    hybrid_sql(
        "SELECT count(*) FILTER (NOT is_neighbour) AS result_count, count(*) FILTER (is_neighbour) AS neighbour_rows FROM shown", *_SHOWN
    ),
)
def _(spark, folder):
    return search.result_counts(_wire(spark, folder))


@query(
    "topk_09_top_hits",
    hybrid_sql(
        """SELECT c.page_number AS page, c.chunk_index, NULL AS rerank_score, round(h.rrf, 9) AS rrf_score
        FROM (SELECT * FROM shown WHERE NOT is_neighbour ORDER BY position LIMIT 5) s JOIN corpus c ON c.id = s.id JOIN hits h ON h.id = s.id""",
        *_SHOWN,
    ),
)
def _(spark, folder):
    return search.top_hits(_wire(spark, folder)).withColumn("rrf_score", F.round("rrf_score", 9))


_LINE = sql_squash("c.content")
_PREVIEW = (
    "CASE WHEN length({0}) <= {1} THEN {0} ELSE coalesce(nullif(regexp_extract({0}, '^(.{{0,{2}}}[^ ]) ', 1), '') || ' …', '…') END"
)


@query(
    "snk_13_preview",
    hybrid_sql(
        f"""SELECT position, CASE WHEN is_neighbour THEN '       ~ neighbour  page=' || c.page_number || '  chunk=' || c.chunk_index
               || chr(10) || '         ' || {_PREVIEW.format(_LINE, 200, 197)}
           ELSE '  [' || lpad(CAST(count(*) FILTER (NOT is_neighbour) OVER (ORDER BY position) AS VARCHAR), 2, ' ') || '] rrf='
               || printf('%.4f', h.rrf) || '  report=' || substr(c.report_id, 1, 8) || '…  page=' || c.page_number || '  chunk='
               || c.chunk_index || chr(10) || '       ' || {_PREVIEW.format(_LINE, 220, 217)} END AS preview
        FROM shown s JOIN corpus c ON c.id = s.id LEFT JOIN hits h ON h.id = s.id""",
        *_SHOWN,
    ),
)
def _(spark, folder):
    return search.as_preview(_wire(spark, folder))


_QUOTE = (
    f"array_to_string(list_transform(string_split({sql_strip('c.content')}, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10))"
)


@query(
    "fn_22_answer_markdown",
    hybrid_sql(
        f"""SELECT 'Found **' || count(*) FILTER (NOT is_neighbour) || '** relevant result(s):' || chr(10)
            || string_agg(piece, chr(10) ORDER BY position) AS message
        FROM (SELECT position, is_neighbour, CASE WHEN is_neighbour THEN
                  chr(10) || '   ↳ *Context — Page ' || c.page_number || ', chunk ' || c.chunk_index || '*' || chr(10) || {_QUOTE}
                ELSE chr(10) || '---' || chr(10) || '**' || count(*) FILTER (NOT is_neighbour) OVER (ORDER BY position) || '.** Page '
                  || c.page_number || ' | Score: ' || printf('%.3f', h.rrf) || chr(10) || chr(10) || {_QUOTE} END AS piece
              FROM shown s JOIN corpus c ON c.id = s.id LEFT JOIN hits h ON h.id = s.id)""",
        *_SHOWN,
    ),
)
def _(spark, folder):
    return search.as_markdown(search.wire_rows(_wire(spark, folder)))
