"""The given tables seen as the document model, in Spark and as the same SQL.

Documents are reports of the channel of their language; their lines are chunks. The
documents that have a vector form the vector corpus. Suppliers are tenants, customers
users, orders sessions, and line items the layout items of their order.
``SQL`` spells each view for a second engine, so results can be compared.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamplight.functions import ids, text
from lamplight.functions.providers import LexicalEmbedder
from lamplight.operators import catalog
from lamplight.operators.rows import exploded
from lamplight.sources import extract

EPOCH = 1_704_067_200
LINES_PER_PAGE = 8
CORPUS_PAGE = 100

WS = text.WHITESPACE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uuid_text(kind: str, *parts: object) -> str:
    h = hashlib.md5("|".join([kind, *map(str, parts)]).encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def sql_uuid(kind: str, *parts: str) -> str:
    joined = ", ".join([f"'{kind}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return (
        f"regexp_replace(md5(concat_ws('|', {joined})), "
        r"'(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5')"
    )


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def sql_squash(x: str) -> str:
    return rf"regexp_replace({sql_strip(x)}, '[{WS}]+', ' ', 'g')"


def sql_has_text(x: str) -> str:
    return f"regexp_matches({x}, '[^{WS}]')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '([\\p{{L}}\\p{{N}}]+)', 1)"


def sql_token(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::UBIGINT % 250002)"


def with_views(names: list[str], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


def lines_of(body: Column) -> Column:
    return F.transform(F.filter(F.split(body, "\n", -1), text.has_text), text.strip)


def channel_id(lang: Column | None = None) -> Column:
    return ids.stable_uuid("channel", F.col("lang") if lang is None else lang)


def created_at(seconds: Column) -> Column:
    """That many seconds into 2024, by the clock of the session's own time zone."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=seconds)


def channels(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.groupBy("lang").agg(F.min("doc_id").alias("first")).select(
        channel_id().alias("id"),
        F.col("lang").alias("name"),
        F.concat(F.lit("Documents in "), "lang").alias("description"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        created_at(F.col("first")).alias("created_at"),
    )


def _filename() -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    named = docs.withColumns({"channel_id": channel_id(), "filename": _filename()})
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(
        F.concat(F.lit("Report "), F.col("doc_id").cast("string"))
    )
    return named.select(
        catalog.report_id(F.col("channel_id"), F.col("filename")).alias("id"),
        "channel_id",
        "filename",
        catalog.default_title(title, text.file_stem(F.col("filename"))).alias("title"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        created_at(F.col("doc_id")).alias("created_at"),
        "doc_id",
    )


def line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-blank line of every document as a chunk of its report."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    named = docs.withColumns({"channel_id": channel_id(), "filename": _filename()})
    named = named.withColumn("report_id", catalog.report_id(F.col("channel_id"), F.col("filename")))
    rows = exploded(named, lines_of(F.col("text")), "chunk_index", "content")
    return rows.select(
        (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("id"),
        "channel_id",
        "report_id",
        (F.floor(F.col("chunk_index") / LINES_PER_PAGE) + 1).cast("int").alias("page_number"),
        "chunk_index",
        "content",
        "doc_id",
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as chunks of the report of their source; the given vectors are dealt to them in turn."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    given = table(spark, folder, "embeddings")
    turn = F.col("doc_id") % given.agg(F.max("vec_id") + 1).first()[0]
    rows = docs.withColumn("vec_id", turn).join(given.select("vec_id", "embedding"), "vec_id")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("channel_id"),
        F.concat_ws("/", "lang", "source").alias("report_id"),
        (F.floor(F.col("doc_id") / CORPUS_PAGE) + 1).cast("int").alias("page_number"),
        (F.col("doc_id") % CORPUS_PAGE).cast("int").alias("chunk_index"),
        F.col("text").alias("content"),
        "embedding",
        LexicalEmbedder().sparse(F.col("text")).alias("sparse_embedding"),
    )


def features(balance: Column, key: Column) -> Column:
    return F.filter(
        F.array(
            F.lit("chatbot"),
            F.lit("document_search"),
            F.when(balance > 0, "tables_search"),
            F.when(key % 2 == 0, "voice_agent"),
            F.when(balance > 9000, catalog.ADMIN_FEATURE),
        ),
        lambda f: f.isNotNull(),
    )


def tenants(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    return s.select(
        F.col("s_suppkey").alias("channelid"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 3 != 0, ids.stable_uuid("corpus", F.col("s_suppkey"))).alias("rag_channel_id"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("metadata"),
        features(F.col("s_acctbal"), F.col("s_suppkey")).alias("authorized_features"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("userid"),
        F.col("c_name").alias("name"),
        F.lower("c_name").alias("username"),
        F.sha2(F.concat_ws(":", F.lower("c_name"), "c_mktsegment"), 256).alias("credential_digest"),
        (F.col("c_custkey") % 10).alias("channelid"),
        features(F.col("c_acctbal"), F.col("c_custkey")).alias("authorized_features"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("authorized_data"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    hours = lambda h: F.make_dt_interval(F.lit(0), h)
    return o.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(
            F.lit("10.0."), (F.col("o_orderkey") % 256).cast("string"), F.lit("."), (F.col("o_custkey") % 256).cast("string")
        ).alias("ip_address"),
        at.alias("login_at"),
        (at + hours(F.lit(8))).alias("expires_at"),
        F.when(F.col("o_orderstatus") == "F", at + hours((F.col("o_orderkey") % 12).cast("int"))).alias("ended_at"),
    )


# Item classes in the order the stand-in deals them out; the last is unknown.
CLASSES = [
    "TextItem", "SectionHeaderItem", "TitleItem", "TableItem", "PictureItem",
    "FormulaItem", "ListItem", "CodeItem", "FootnoteItem", "GroupItem",
]
PAGE_POINTS = (595.0, 842.0)
PAGE_PIXELS = (1240.0, 1754.0)


def item_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as layout items with a box in points, some measured from the bottom."""
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    left = F.col("l_quantity") * 6.0
    top = F.col("l_partkey") % 700
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_suppkey") % 20 != 0, (F.col("l_suppkey") % 3).cast("int")).alias("page_number"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias("seq"),
        F.get(F.array(*[F.lit(c) for c in CLASSES]), (F.col("l_partkey") % 10).cast("int")).alias("class_name"),
        F.when(F.col("l_partkey") % 11 == 0, "  Table of Contents ")
        .when(F.col("l_partkey") % 7 == 0, "  ")
        .when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("no. "), F.col("l_partkey").cast("string")))
        .otherwise(F.concat_ws(" ", F.lit("Part"), "l_partkey", F.lit("shipped by supplier"), "l_suppkey"))
        .alias("text"),
        left.alias("left"),
        top.cast("double").alias("top"),
        (left + F.col("l_tax") * 3000).alias("right"),
        (top + F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0) * F.col("l_discount") * 1000).alias("bottom"),
        (F.col("l_linestatus") == "O").alias("bottom_origin"),
        F.when(F.col("l_suppkey") % 13 != 0, F.lit(PAGE_POINTS[1])).alias("page_points"),
        (F.col("l_discount") * 160).alias("pixel_stddev"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("qty"),
    )


def layout_items(spark: SparkSession, folder: str) -> DataFrame:
    """Layout items with pixel boxes, tables and stand-in images (bytes of tagged text)."""
    from lamplight.functions import geometry

    rows = item_boxes(spark, folder)
    box = geometry.box_to_pixels(
        F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), F.col("bottom_origin"), F.col("page_points")
    )
    cell = lambda c: c.cast("string")
    grid = F.array(
        F.array(F.lit("part|no"), F.lit("flag"), F.lit(" qty ")),
        F.array(cell(F.col("part")), F.concat(F.col("flag"), F.lit("\n"), cell(F.col("supp")))),
    )
    return rows.select(
        "doc_id",
        "page_number",
        "seq",
        "class_name",
        "text",
        box.alias("bbox"),
        F.when(F.col("class_name") == "TableItem", F.when(F.col("supp") % 9 != 0, grid)).alias("table_data"),
        F.lit(PAGE_PIXELS[0]).alias("page_width"),
        F.lit(PAGE_PIXELS[1]).alias("page_height"),
        "pixel_stddev",
        F.concat(
            F.lit("0.9\tline "), cell(F.col("part")), F.lit("\n0.4\tnoise\n0.7\t \n0.6\tsupplier "), cell(F.col("supp"))
        ).cast("binary").alias("image"),
    )


class TaggedLines:
    """Stand-in reader: the image is text, each line a score, a tab and the words."""

    def lines(self, image: Column) -> Column:
        rows = F.split(F.decode(image, "UTF-8"), "\n", -1)
        return F.transform(
            rows,
            lambda r: F.struct(
                F.substring_index(r, "\t", -1).alias("text"),
                F.substring_index(r, "\t", 1).cast("double").alias("score"),
            ),
        )


class TaggedCaption:
    """Stand-in captioner: names the first line of the image."""

    def caption(self, image: Column) -> Column:
        first = F.substring_index(F.substring_index(F.decode(image, "UTF-8"), "\n", 1), "\t", -1)
        return F.concat(F.lit("picture of "), first)


class TaggedFormula:
    """Stand-in formula reader: the last line of the image between dollar signs."""

    def latex(self, image: Column) -> Column:
        last = F.substring_index(F.substring_index(F.decode(image, "UTF-8"), "\n", -1), "\t", -1)
        return F.concat(F.lit("$"), F.replace(last, F.lit("supplier "), F.lit("s_")), F.lit("$"))


def html_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "html")


def html_item_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = html_documents(spark, folder)
    return extract.item_rows(docs, extract.html_items(F.col("html"))).drop("html")


def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Plain texts and web pages as documents to ingest, two extractors apart."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return docs.select(
        F.col("doc_id").alias("seq"),
        channel_id().alias("channel_id"),
        _filename().alias("filename"),
        F.lit("").alias("title"),
        F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        "text",
    )


_TITLE = "CASE WHEN doc_id % 3 = 0 THEN 'doc_' || doc_id ELSE 'Report ' || doc_id END"
_FILE = "'doc_' || doc_id || '.pdf'"
_FEATURES = (
    "list_filter(['chatbot', 'document_search', CASE WHEN {b} > 0 THEN 'tables_search' END,"
    " CASE WHEN {k} % 2 = 0 THEN 'voice_agent' END, CASE WHEN {b} > 9000 THEN 'admin_panel' END],"
    " lambda f: f IS NOT NULL)"
)

SQL = {
    "channels": f"""
        SELECT {sql_uuid("channel", "lang")} AS id, lang AS name, 'Documents in ' || lang AS description,
               make_timestamp(({EPOCH} + min(doc_id)) * 1000000) AS created_at
        FROM documents GROUP BY lang""",
    "reports": f"""
        SELECT {sql_uuid("report", sql_uuid("channel", "lang"), _FILE)} AS id,
               {sql_uuid("channel", "lang")} AS channel_id, {_FILE} AS filename, {_TITLE} AS title, source,
               make_timestamp(({EPOCH} + doc_id) * 1000000) AS created_at, doc_id
        FROM documents""",
    "chunks": f"""
        SELECT doc_id * 1000000 + line AS id, {sql_uuid("channel", "lang")} AS channel_id,
               {sql_uuid("report", sql_uuid("channel", "lang"), _FILE)} AS report_id,
               line // {LINES_PER_PAGE} + 1 AS page_number, line AS chunk_index, content, doc_id
        FROM (SELECT doc_id, lang, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS line
              FROM (SELECT doc_id, lang, list_transform(
                        list_filter(string_split(text, chr(10)), lambda x: {sql_has_text("x")}),
                        lambda x: {sql_strip("x")}) AS ls FROM documents))""",
    "corpus": f"""
        SELECT doc_id AS id, lang AS channel_id, lang || '/' || source AS report_id,
               doc_id // {CORPUS_PAGE} + 1 AS page_number, doc_id % {CORPUS_PAGE} AS chunk_index,
               text AS content, embedding
        FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT max(vec_id) + 1 FROM embeddings)""",
    "postings": f"""
        SELECT id, channel_id, {sql_token("word")} AS token, sum(n)::DOUBLE AS tf
        FROM (SELECT id, channel_id, word, count(*) AS n
              FROM (SELECT id, channel_id, unnest({sql_words("content")}) AS word FROM corpus)
              GROUP BY ALL) GROUP BY ALL""",
    "tenants": f"""
        SELECT s_suppkey AS channelid, s_name AS name,
               CASE WHEN s_suppkey % 3 <> 0 THEN {sql_uuid("corpus", "s_suppkey")} END AS rag_channel_id,
               {_FEATURES.format(b="s_acctbal", k="s_suppkey")} AS authorized_features
        FROM supplier""",
    "users": f"""
        SELECT c_custkey AS userid, c_name AS name, lower(c_name) AS username,
               sha256(lower(c_name) || ':' || c_mktsegment) AS credential_digest, c_custkey % 10 AS channelid,
               {_FEATURES.format(b="c_acctbal", k="c_custkey")} AS authorized_features
        FROM customer""",
    "sessions": """
        SELECT o_orderkey AS session_id, o_custkey AS user_id,
               '10.0.' || (o_orderkey % 256) || '.' || (o_custkey % 256) AS ip_address,
               o_orderdate AS login_at, o_orderdate + INTERVAL 8 HOUR AS expires_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 12) END AS ended_at
        FROM orders""",
    "item_boxes": f"""
        SELECT l_orderkey AS doc_id, CASE WHEN l_suppkey % 20 <> 0 THEN l_suppkey % 3 END AS page_number,
               l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate,
               {CLASSES!r}[l_partkey % 10 + 1] AS class_name,
               CASE WHEN l_partkey % 11 = 0 THEN '  Table of Contents ' WHEN l_partkey % 7 = 0 THEN '  '
                    WHEN l_partkey % 5 = 0 THEN 'no. ' || l_partkey
                    ELSE 'Part ' || l_partkey || ' shipped by supplier ' || l_suppkey END AS text,
               l_quantity * 6.0::DOUBLE AS "left", (l_partkey % 700)::DOUBLE AS top,
               l_quantity * 6.0::DOUBLE + l_tax * 3000 AS "right",
               (l_partkey % 700) + (CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)::DOUBLE * l_discount * 1000 AS bottom,
               l_linestatus = 'O' AS bottom_origin,
               CASE WHEN l_suppkey % 13 <> 0 THEN {PAGE_POINTS[1]}::DOUBLE END AS page_points,
               l_discount * 160 AS pixel_stddev, l_returnflag
        FROM lineitem""",
}

_SCALE = "(150.0::DOUBLE / 72)"
SQL["boxes"] = f"""
    SELECT *, least(x0, x1) AS x_min, least(y0, y1) AS y_min, greatest(x0, x1) AS x_max, greatest(y0, y1) AS y_max
    FROM (SELECT *, "left" * {_SCALE} AS x0, "right" * {_SCALE} AS x1,
                 (CASE WHEN bottom_origin AND page_points IS NOT NULL THEN page_points - top ELSE top END) * {_SCALE} AS y0,
                 (CASE WHEN bottom_origin AND page_points IS NOT NULL THEN page_points - bottom ELSE bottom END) * {_SCALE} AS y1
          FROM item_boxes)"""

_KIND = (
    "CASE WHEN class_name IN ('TextItem', 'ListItem', 'CodeItem') THEN 'text'"
    " WHEN class_name IN ('SectionHeaderItem', 'TitleItem') THEN 'heading' WHEN class_name = 'TableItem' THEN 'table'"
    " WHEN class_name = 'PictureItem' THEN 'figure' WHEN class_name = 'FormulaItem' THEN 'formula'"
    " WHEN class_name = 'FootnoteItem' THEN 'footer' END"
)
SQL["regions"] = f"""
    SELECT * EXCLUDE (n, text), n - 1 AS reading_order,
           CASE WHEN kind = 'table' THEN '' ELSE {sql_strip("text")} END AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS n
          FROM (SELECT *, {_KIND} AS kind FROM boxes)
          WHERE kind IS NOT NULL AND page_number IS NOT NULL)
    WHERE n <= 200"""

_W, _H = PAGE_PIXELS


def _side(x: str, edge: float) -> str:
    return f"greatest(least(CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT), {int(edge)}), 0)"


SQL["measured"] = f"""
    SELECT *, area >= 0.005 AND cx1 - cx0 >= 4 AND cy1 - cy0 >= 4 AND pixel_stddev >= 8 AS readable
    FROM (SELECT *, greatest(x_max - x_min, 0) * greatest(y_max - y_min, 0) / ({_W}::DOUBLE * {_H}::DOUBLE) AS area,
                 {_side("x_min", _W)} AS cx0, {_side("y_min", _H)} AS cy0,
                 {_side("x_max", _W)} AS cx1, {_side("y_max", _H)} AS cy1
          FROM regions)"""

SQL["blocks"] = """
    SELECT * EXCLUDE (raw), nullif(raw, '') AS content FROM (
      SELECT *, CASE
        WHEN kind IN ('text', 'heading', 'footer') THEN
          CASE WHEN length(text) < 20 AND readable THEN seen ELSE text END
        WHEN kind = 'table' AND l_suppkey % 9 <> 0 THEN
          '| part\\|no | flag | qty |' || chr(10) || '| --- | --- | --- |' || chr(10)
          || '| ' || l_partkey || ' | ' || l_returnflag || ' ' || l_suppkey || ' |  |'
        WHEN kind = 'figure' THEN
          (CASE WHEN area >= 0.02 THEN '[Figure: picture of line ' || l_partkey || ']' ELSE '[Figure]' END)
          || (CASE WHEN readable THEN chr(10) || seen ELSE '' END)
        WHEN kind = 'formula' THEN '$$ s_' || l_suppkey || ' $$' END AS raw
      FROM (SELECT *, 'line ' || l_partkey || chr(10) || 'supplier ' || l_suppkey AS seen FROM measured))"""

SQL["pages_of"] = """
    SELECT doc_id, page_number, count(*) FILTER (content IS NOT NULL) AS n,
           count(*) FILTER (content IS NOT NULL AND kind = 'heading') AS headings,
           count(*) FILTER (content IS NOT NULL AND kind = 'text') AS texts,
           count(*) FILTER (content IS NOT NULL AND kind = 'table') AS tables,
           count(*) FILTER (content IS NOT NULL AND kind = 'figure') AS figures,
           count(*) FILTER (content IS NOT NULL AND kind = 'formula') AS formulas,
           coalesce(bool_or(content IS NOT NULL AND kind = 'heading'
                            AND contains(lower(content), 'table of contents')), false) AS toc,
           coalesce(string_agg(content, chr(10) || chr(10) ORDER BY reading_order), '') AS content,
           coalesce(min_by(content, reading_order) FILTER (kind = 'heading' AND content IS NOT NULL), '') AS heading
    FROM blocks GROUP BY doc_id, page_number"""

ITEM_VIEWS = ["item_boxes", "boxes", "regions", "measured", "blocks", "pages_of"]


def sql_page_type() -> str:
    return (
        "CASE WHEN n = 0 THEN 'empty' WHEN toc THEN 'toc' WHEN tables / n::DOUBLE > 0.5 THEN 'table'"
        " WHEN figures / n::DOUBLE > 0.5 THEN 'chart' WHEN n <= 3 AND headings >= 1 AND texts <= 1 THEN 'cover'"
        " WHEN texts = n THEN 'text' ELSE 'mixed' END"
    )


def sql_language(x: str) -> str:
    arabic = rf"length(regexp_replace({x}, '[^\x{{0600}}-\x{{06FF}}]', '', 'g'))"
    latin = f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    return (
        f"CASE WHEN {arabic} + {latin} = 0 THEN 'mixed'"
        f" WHEN {arabic} / ({arabic} + {latin})::DOUBLE > 0.7 THEN 'ar'"
        f" WHEN {arabic} / ({arabic} + {latin})::DOUBLE < 0.1 THEN 'en' ELSE 'mixed' END"
    )
