"""Channels, reports, tenants, users and sessions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions import ids, text
from lamplight.operators import catalog as op, positions
from lamplight.plans import search
from lamplight.sources import standins as view
from lamplight.sources.standins import sql_strip, sql_uuid, uuid_text, with_views
from lamplight.workload.register import query

ISO = "yyyy-MM-dd'T'HH:mm:ss"
SQL_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
ENGLISH = uuid_text("channel", "en")
REPORT = uuid_text("report", ENGLISH, "doc_99.pdf")
NOW = "2024-07-01 00:00:00"
DAY = "1998-09-02 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# Scans and lookups -----------------------------------------------------------------


@query(
    "src_06_channel_scan",
    with_views(
        ["chunks"],
        f"SELECT id, report_id, page_number, chunk_index FROM chunks WHERE channel_id = '{ENGLISH}'",
    ),
)
def _(spark, folder):
    rows = search.in_scope(view.line_chunks(spark, folder), ENGLISH)
    return rows.select("id", "report_id", "page_number", "chunk_index")


@query(
    "flt_02_report_scan",
    with_views(
        ["chunks"],
        "SELECT id, page_number, chunk_index, content FROM chunks"
        f" WHERE channel_id = '{ENGLISH}' AND report_id = '{REPORT}'",
    ),
)
def _(spark, folder):
    rows = search.in_scope(view.line_chunks(spark, folder), ENGLISH, REPORT)
    return rows.select("id", "page_number", "chunk_index", "content")


_CHANNEL = f"SELECT id, name, description, {SQL_ISO.format('created_at')} AS created_at FROM channels"


def _channel_rows(rows):
    return rows.select("id", "name", "description", F.date_format("created_at", ISO).alias("created_at"))


@query(
    "src_07_channels_oldest_first",
    with_views(
        ["channels"],
        f"SELECT *, row_number() OVER (ORDER BY created_at, id) AS place FROM ({_CHANNEL}) ORDER BY place",
    ),
)
def _(spark, folder):
    from pyspark.sql import Window

    rows = _channel_rows(op.channels_oldest_first(view.channels(spark, folder)))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("created_at", "id")))


@query("src_08_channel_by_id", with_views(["channels"], f"{_CHANNEL} WHERE id = '{ENGLISH}' LIMIT 1"))
def _(spark, folder):
    return _channel_rows(op.channel_by_id(view.channels(spark, folder), ENGLISH))


@query("src_08_channel_by_name", with_views(["channels"], f"{_CHANNEL} WHERE name = 'de' LIMIT 1"))
def _(spark, folder):
    return _channel_rows(op.channel_by_name(view.channels(spark, folder), " de "))


_REPORT = f"SELECT id, channel_id, filename, title, {SQL_ISO.format('created_at')} AS created_at FROM reports"


def _report_rows(rows):
    return rows.select("id", "channel_id", "filename", "title", F.date_format("created_at", ISO).alias("created_at"))


@query("src_09_report_by_id", with_views(["reports"], f"{_REPORT} WHERE id = '{REPORT}' LIMIT 1"))
def _(spark, folder):
    return _report_rows(op.report_by_id(view.reports(spark, folder), REPORT))


@query("src_10_reports_of_channel", with_views(["reports"], f"{_REPORT} WHERE channel_id = '{ENGLISH}' ORDER BY created_at, id"))
def _(spark, folder):
    return _report_rows(op.reports_of_channel(view.reports(spark, folder), ENGLISH))


@query(
    "src_11_tenants_by_id",
    with_views(["tenants"], "SELECT channelid, name, rag_channel_id FROM tenants ORDER BY channelid"),
)
def _(spark, folder):
    return view.tenants(spark, folder).select("channelid", "name", "rag_channel_id").orderBy("channelid")


@query(
    "src_12_tenant_by_id",
    with_views(["tenants"], "SELECT channelid, name, rag_channel_id FROM tenants WHERE channelid = 4"),
)
def _(spark, folder):
    return view.tenants(spark, folder).where("channelid = 4").select("channelid", "name", "rag_channel_id")


@query(
    "src_18_connection_keywords",
    r"""
    SELECT c_custkey, 'host=' || lower(c_name) || ' port=' || c_custkey || ' dbname=rag user=u' || c_nationkey
           || ' password=' || CASE WHEN c_custkey % 2 = 0 THEN '''' || c_mktsegment || ' \''k''' ELSE c_mktsegment END
           AS url
    FROM customer""",
)
def _(spark, folder):
    c = view.table(spark, folder, "customer")
    secret = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" 'k"))).otherwise(F.col("c_mktsegment"))
    url = F.concat(
        F.lit("Server="), F.lower("c_name"), F.lit("; Port = "), F.col("c_custkey").cast("string"),
        F.lit(";Database=rag;Pooling=true;User Id=u"), F.col("c_nationkey").cast("string"),
        F.lit(";flag;Password="), secret,
    )
    return c.select("c_custkey", text.connection_keywords(url).alias("url"))


# Changes ---------------------------------------------------------------------------


_SHORTENED = """
    again AS (SELECT c.id, c.report_id, c.content,
                     row_number() OVER (PARTITION BY c.report_id ORDER BY c.chunk_index) - 1 AS chunk_index
              FROM chunks c JOIN labels l ON c.doc_id = l.doc_id),
    gone AS (SELECT r.id AS report_id FROM reports r JOIN labels l ON r.doc_id = l.doc_id),
    after AS (SELECT report_id, chunk_index, content FROM chunks WHERE report_id NOT IN (SELECT report_id FROM gone)
              UNION ALL SELECT report_id, chunk_index, content FROM again)"""


@query(
    "snk_01_replace_chunks",
    with_views(["chunks", "reports"], "").rstrip()
    + f""", {_SHORTENED}
    SELECT r.id AS report_id, count(a.content) AS chunks, coalesce(max(a.chunk_index) + 1, 0) AS next_index,
           coalesce(sum(length(a.content)), 0)::BIGINT AS chars
    FROM reports r LEFT JOIN after a ON r.id = a.report_id GROUP BY r.id""",
)
def _(spark, folder):
    chunks = view.line_chunks(spark, folder)
    reports = view.reports(spark, folder)
    labelled = view.table(spark, folder, "labels").select("doc_id")
    again = chunks.join(labelled, "doc_id")
    again = positions.tiled_positions(again, ["report_id"], "page_number", "chunk_index")
    again = again.withColumn("chunk_index", (F.col("pos") - 1).cast("int")).drop("pos")
    gone = reports.join(labelled, "doc_id").select(F.col("id").alias("report_id"))
    after = op.replace_chunks(chunks, again.select(*chunks.columns), gone)
    totals = after.groupBy("report_id").agg(
        F.count("content").alias("chunks"),
        (F.max("chunk_index") + 1).alias("next_index"),
        F.sum(F.length("content")).alias("chars"),
    )
    return (
        reports.select(F.col("id").alias("report_id"))
        .join(totals, "report_id", "left")
        .select("report_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "next_index", "chars")])
    )


_WANTED = f"""
    wanted AS (SELECT doc_id * 2 AS seq, ' ' || source || ' ' AS raw FROM documents
               UNION ALL SELECT doc_id * 2 + 1, CASE WHEN doc_id % 50 = 0 THEN '   ' ELSE lang END FROM documents),
    judged AS (SELECT seq, name, CASE WHEN name = '' THEN 'blank name'
                      WHEN name IN (SELECT name FROM channels) OR seq > min(seq) OVER (PARTITION BY name)
                      THEN 'name exists' END AS reason
               FROM (SELECT seq, {sql_strip("raw")} AS name FROM wanted))"""


def _wanted(spark, folder):
    docs = view.table(spark, folder, "documents")
    meta = F.create_map().cast("map<string,string>").alias("metadata")
    one = docs.select((F.col("doc_id") * 2).alias("seq"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("name"), meta)
    two = docs.select(
        (F.col("doc_id") * 2 + 1).alias("seq"),
        F.when(F.col("doc_id") % 50 == 0, "   ").otherwise(F.col("lang")).alias("name"),
        meta,
    )
    return one.unionAll(two).withColumn("description", F.lit(None).cast("string"))


@query(
    "snk_02_insert_channels",
    with_views(["channels"], "").rstrip()
    + f", {_WANTED} SELECT {sql_uuid('channel', 'name')} AS id, name, '' AS description FROM judged WHERE reason IS NULL",
)
def _(spark, folder):
    return op.new_channels(view.channels(spark, folder), _wanted(spark, folder), now()).select("id", "name", "description")


@query(
    "snk_02_refused_channels",
    with_views(["channels"], "").rstrip() + f", {_WANTED} SELECT reason, count(*) AS rows FROM judged WHERE reason IS NOT NULL GROUP BY reason",
)
def _(spark, folder):
    judged = op.judge_new_channels(view.channels(spark, folder), _wanted(spark, folder))
    return judged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "snk_03_upsert_reports",
    with_views(["reports"], "").rstrip()
    + f""", incoming AS (
        SELECT {sql_uuid("channel", "'en'")} AS channel_id, 'doc_' || doc_id || '.pdf' AS filename,
               'Reviewed ' || quality AS title FROM labels
        UNION ALL SELECT {sql_uuid("channel", "'en'")}, 'page_' || page_id || '.pdf', url FROM pages)
    SELECT coalesce(r.id, {sql_uuid("report", "i.channel_id", "i.filename")}) AS id,
           coalesce(r.channel_id, i.channel_id) AS channel_id, coalesce(r.filename, i.filename) AS filename,
           coalesce(i.title, r.title) AS title,
           {SQL_ISO.format(f"coalesce(r.created_at, TIMESTAMP '{NOW}')")} AS created_at
    FROM reports r FULL JOIN incoming i ON r.channel_id = i.channel_id AND r.filename = i.filename""",
)
def _(spark, folder):
    english = F.lit(ENGLISH)
    meta = F.create_map().cast("map<string,string>")
    reviewed = view.table(spark, folder, "labels").select(
        F.col("doc_id").alias("seq"),
        english.alias("channel_id"),
        F.concat(F.lit(" doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("Reviewed "), F.col("quality").cast("string")).alias("title"),
        meta.alias("metadata"),
    )
    crawled = view.table(spark, folder, "pages").select(
        F.col("page_id").alias("seq"),
        english.alias("channel_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("url").alias("title"),
        meta.alias("metadata"),
    )
    after = op.upsert_reports(view.reports(spark, folder).drop("doc_id"), reviewed.unionByName(crawled), now())
    return _report_rows(after)


_GONE = "gone AS (SELECT r.id AS report_id FROM reports r JOIN labels l ON r.doc_id = l.doc_id WHERE toxic = 1)"


def _toxic(spark, folder):
    bad = view.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return view.reports(spark, folder).join(bad, "doc_id").select(F.col("id").alias("report_id"))


@query(
    "snk_04_delete_reports",
    with_views(["reports", "chunks"], "").rstrip()
    + f""", {_GONE} SELECT g.report_id, count(c.id) AS deleted_chunks
    FROM gone g LEFT JOIN chunks c ON g.report_id = c.report_id GROUP BY g.report_id""",
)
def _(spark, folder):
    counted = op.chunks_per_report(view.line_chunks(spark, folder), _toxic(spark, folder))
    return counted.withColumnRenamed("chunks", "deleted_chunks")


@query(
    "snk_04_reports_left",
    with_views(["reports"], "").rstrip() + f", {_GONE} SELECT id, filename FROM reports WHERE id NOT IN (SELECT report_id FROM gone)",
)
def _(spark, folder):
    left = op.without_reports(view.reports(spark, folder), _toxic(spark, folder), "id")
    return left.select("id", "filename")


@query(
    "snk_05_insert_tenants",
    with_views(["tenants"], "").rstrip()
    + f""", wanted AS (SELECT c_custkey AS seq,
            CASE WHEN c_custkey % 4 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_name END AS name
        FROM customer)
    SELECT seq, name, CASE WHEN name IN (SELECT name FROM tenants) THEN 'name exists' END AS reason FROM wanted""",
)
def _(spark, folder):
    c = view.table(spark, folder, "customer")
    same = F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    wanted = c.select(
        F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 4 == 0, same).otherwise(F.col("c_name")).alias("name")
    )
    return op.judge_new_channels(view.tenants(spark, folder), wanted).select("seq", "name", "reason")


_LINKS = f"""
    links AS (SELECT c_custkey AS channelid,
                     CASE WHEN c_custkey % 5 = 0 THEN {sql_uuid("corpus", "c_custkey + 1")}
                          ELSE {sql_uuid("fresh", "c_custkey")} END AS rag_channel_id FROM customer),
    judged AS (SELECT k.channelid, k.rag_channel_id,
                      CASE WHEN t.channelid IS NULL THEN 'unknown channel'
                           WHEN t.rag_channel_id IS NOT NULL THEN 'already linked'
                           WHEN o.channelid IS NOT NULL THEN 'corpus in use' END AS reason
               FROM links k LEFT JOIN tenants t ON k.channelid = t.channelid
               LEFT JOIN tenants o ON k.rag_channel_id = o.rag_channel_id)"""


def _links(spark, folder):
    c = view.table(spark, folder, "customer")
    taken = ids.stable_uuid("corpus", F.col("c_custkey") + 1)
    fresh = ids.stable_uuid("fresh", F.col("c_custkey"))
    return c.select(
        F.col("c_custkey").alias("channelid"),
        F.when(F.col("c_custkey") % 5 == 0, taken).otherwise(fresh).alias("rag_channel_id"),
    )


@query("snk_06_judge_links", with_views(["tenants"], "").rstrip() + f", {_LINKS} SELECT * FROM judged")
def _(spark, folder):
    return op.judge_links(view.tenants(spark, folder), _links(spark, folder))


@query(
    "snk_06_link_tenants",
    with_views(["tenants"], "").rstrip()
    + f""", {_LINKS} SELECT t.channelid, coalesce(j.rag_channel_id, t.rag_channel_id) AS rag_channel_id
    FROM tenants t LEFT JOIN judged j ON t.channelid = j.channelid AND j.reason IS NULL""",
)
def _(spark, folder):
    return op.link_tenants(view.tenants(spark, folder), _links(spark, folder)).select("channelid", "rag_channel_id")


@query(
    "snk_07_open_sessions",
    f"""SELECT {sql_uuid("session", "o_custkey", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "'10.1.' || (o_orderkey % 256)")} AS session_id,
           o_custkey AS user_id, {SQL_ISO.format("o_orderdate + INTERVAL 8 HOUR")} AS expires_at FROM orders""",
)
def _(spark, folder):
    o = view.table(spark, folder, "orders")
    logins = o.select(
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("10.1."), (F.col("o_orderkey") % 256).cast("string")).alias("ip_address"),
        F.col("o_orderdate").cast("timestamp").alias("login_at"),
    )
    rows = op.open_sessions(logins)
    return rows.select("session_id", "user_id", F.date_format("expires_at", ISO).alias("expires_at"))


@query(
    "snk_08_end_sessions",
    with_views(
        ["sessions"],
        f"""SELECT session_id, {SQL_ISO.format("CASE WHEN session_id % 7 = 0 THEN login_at + INTERVAL 1 HOUR ELSE ended_at END")}
        AS ended_at FROM sessions""",
    ),
)
def _(spark, folder):
    rows = view.sessions(spark, folder)
    ended = rows.where("session_id % 7 = 0").select("session_id", (F.col("login_at") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return op.end_sessions(rows, ended).select("session_id", F.date_format("ended_at", ISO).alias("ended_at"))


@query(
    "str_02_session_state",
    with_views(
        ["sessions"],
        f"""SELECT user_id, CASE WHEN ended_at <= TIMESTAMP '{DAY}' THEN 'ended' WHEN expires_at <= TIMESTAMP '{DAY}' THEN 'expired'
               WHEN login_at <= TIMESTAMP '{DAY}' THEN 'open' ELSE 'future' END AS state, count(*) AS sessions
        FROM sessions GROUP BY ALL""",
    ),
)
def _(spark, folder):
    state = op.session_state(F.lit(DAY).cast("timestamp")).alias("state")
    return view.sessions(spark, folder).groupBy("user_id", state).agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "snk_10_object_keys",
    with_views(
        ["reports"],
        "SELECT id, 'channels/' || channel_id || '/raw/' || id || '/' || replace(filename, chr(92), '/') AS raw_key FROM reports",
    ),
)
def _(spark, folder):
    key = text.object_key("channels", F.col("channel_id"), F.lit("raw"), F.lit(""), F.col("id"), F.col("filename"))
    return view.reports(spark, folder).select("id", key.alias("raw_key"))


@query(
    "snk_12_json_rows",
    with_views(
        ["reports"],
        "SELECT id, to_json({'id': id, 'filename': filename, 'title': title, 'source': source, 'doc_id': doc_id}) AS json FROM reports",
    ),
)
def _(spark, folder):
    rows = view.reports(spark, folder)
    record = F.struct("id", "filename", "title", F.col("metadata")["source"].alias("source"), "doc_id")
    return rows.select("id", F.to_json(record).alias("json"))


_VERSIONS = """
    files AS (SELECT DISTINCT lpad(CAST(doc_id // 7 AS VARCHAR), 9, '0') || '_' || source || '.sql' AS version FROM documents),
    applied AS (SELECT lpad(CAST(d.doc_id // 7 AS VARCHAR), 9, '0') || '_' || source || '.sql' AS version,
                       max(quality) AS applied_at
                FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)"""


def _versions(spark, folder):
    docs = view.table(spark, folder, "documents").select("doc_id", "source")
    name = F.concat(F.lpad(F.floor(F.col("doc_id") / 7).cast("string"), 9, "0"), F.lit("_"), "source", F.lit(".sql"))
    labelled = view.table(spark, folder, "labels").select("doc_id", "quality")
    applied = docs.join(labelled, "doc_id").groupBy(name.alias("version")).agg(F.max("quality").alias("applied_at"))
    return docs.select(name.alias("version")).distinct(), applied


@query(
    "snk_15_pending_migrations",
    f"WITH {_VERSIONS} SELECT version FROM files EXCEPT SELECT version FROM applied ORDER BY version",
)
def _(spark, folder):
    return op.pending(*_versions(spark, folder))


@query(
    "src_16_migration_status",
    f"""WITH {_VERSIONS} SELECT f.version, a.applied_at, CASE WHEN a.version IS NULL THEN 'pending' ELSE 'applied' END AS state
    FROM files f FULL JOIN applied a ON f.version = a.version""",
)
def _(spark, folder):
    return op.migration_status(*_versions(spark, folder))


@query(
    "snk_14_record_applied",
    f"""WITH {_VERSIONS} SELECT version, applied_at FROM applied
    UNION ALL SELECT version, -1 FROM files WHERE version NOT IN (SELECT version FROM applied)""",
)
def _(spark, folder):
    files, applied = _versions(spark, folder)
    return op.record_applied(applied, files.unionAll(files), F.lit(-1))


@query(
    "snk_17_seed_users",
    with_views(
        ["tenants", "users"],
        """SELECT u.userid, u.username, t.channelid FROM users u JOIN tenants t
           ON t.name = 'Supplier#' || lpad(CAST(u.userid % 17 AS VARCHAR), 9, '0')""",
    ),
)
def _(spark, folder):
    owner = F.concat(F.lit("Supplier#"), F.lpad((F.col("userid") % 17).cast("string"), 9, "0"))
    seeds = view.users(spark, folder).select("userid", "username", owner.alias("name"))
    return seeds.join(view.tenants(spark, folder).select("name", "channelid"), "name").select("userid", "username", "channelid")


@query(
    "snk_18_cascade",
    with_views(
        ["reports", "chunks"],
        f"""SELECT r.channel_id, count(DISTINCT r.id) AS reports, count(c.id) AS chunks
        FROM reports r LEFT JOIN chunks c ON c.report_id = r.id
        WHERE r.channel_id <> '{ENGLISH}' GROUP BY r.channel_id""",
    ),
)
def _(spark, folder):
    reports, chunks = view.reports(spark, folder), view.line_chunks(spark, folder)
    gone_channels = view.channels(spark, folder).where("name = 'en'").select(F.col("id").alias("channel_id"))
    gone = op.reports_of_channels(reports, gone_channels)
    left = op.without_reports(reports, gone, "id").groupBy("channel_id").agg(F.count(F.lit(1)).alias("reports"))
    lines = op.without_reports(chunks, gone).groupBy("channel_id").agg(F.count(F.lit(1)).alias("chunks"))
    return left.join(lines, "channel_id", "left").select("channel_id", "reports", F.coalesce("chunks", F.lit(0)).alias("chunks"))


# Shapes ----------------------------------------------------------------------------


_COUNTS = """
    counts AS (SELECT report_id, count(DISTINCT page_number) AS page_count, count(*) AS chunk_count
               FROM chunks GROUP BY report_id)"""


def _summaries(spark, folder):
    return op.report_summaries(view.reports(spark, folder), view.line_chunks(spark, folder))


@query("agg_02_report_counts", with_views(["chunks"], "").rstrip() + f", {_COUNTS} SELECT * FROM counts")
def _(spark, folder):
    return op.page_and_chunk_counts(view.line_chunks(spark, folder))


@query(
    "join_04_report_summaries",
    with_views(["chunks", "reports"], "").rstrip()
    + f""", {_COUNTS} SELECT r.id AS report_id, r.filename, r.title, coalesce(page_count, 0) AS page_count,
        coalesce(chunk_count, 0) AS chunk_count, {SQL_ISO.format("r.created_at")} AS created_at
    FROM reports r LEFT JOIN counts c ON r.id = c.report_id""",
)
def _(spark, folder):
    return _summaries(spark, folder).withColumn("created_at", F.date_format("created_at", ISO))


@query(
    "prj_04_report_table",
    with_views(["chunks", "reports"], "").rstrip()
    + f""", {_COUNTS} SELECT r.id AS report_id, r.filename, r.title, coalesce(page_count, 0) AS page_count,
        coalesce(chunk_count, 0) AS chunk_count, strftime(r.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM reports r LEFT JOIN counts c ON r.id = c.report_id""",
)
def _(spark, folder):
    return op.report_table(_summaries(spark, folder))


@query(
    "prj_05_tenant_table",
    with_views(
        ["tenants"],
        """SELECT channelid, name, coalesce(rag_channel_id, '— not linked —') AS rag_channel_id,
           array_to_string(authorized_features, ', ') AS features FROM tenants""",
    ),
)
def _(spark, folder):
    return op.tenant_table(view.tenants(spark, folder))


@query(
    "prj_06_report_choices",
    with_views(["reports"], "SELECT filename || ' (' || substr(id, 1, 8) || '…)' AS label, id AS report_id FROM reports"),
)
def _(spark, folder):
    return op.report_choices(view.reports(spark, folder).withColumnRenamed("id", "report_id"))


@query(
    "flt_06_feature_gate",
    with_views(["users"], "SELECT userid, username FROM users WHERE list_contains(authorized_features, 'admin_panel')"),
)
def _(spark, folder):
    return view.users(spark, folder).where(op.has_feature(op.ADMIN_FEATURE)).select("userid", "username")


@query("flt_07_unlinked", with_views(["tenants"], "SELECT name, channelid FROM tenants WHERE rag_channel_id IS NULL"))
def _(spark, folder):
    return op.unlinked(view.tenants(spark, folder)).select("name", "channelid")


@query("flt_07_linked", with_views(["tenants"], "SELECT name, rag_channel_id FROM tenants WHERE rag_channel_id IS NOT NULL"))
def _(spark, folder):
    return op.linked(view.tenants(spark, folder)).select("name", "rag_channel_id")


_PROFILE = """SELECT u.userid, u.name, u.username, u.channelid, t.name AS channel_name, t.rag_channel_id,
    array_to_string(u.authorized_features, ',') AS features FROM users u JOIN tenants t ON u.channelid = t.channelid"""


def _profile_rows(rows):
    return rows.select(
        "userid", "name", "username", "channelid", "channel_name", "rag_channel_id",
        F.array_join("authorized_features", ",").alias("features"),
    )


@query("join_02_profiles", with_views(["tenants", "users"], _PROFILE))
def _(spark, folder):
    return _profile_rows(op.profiles(view.users(spark, folder), view.tenants(spark, folder)))


@query(
    "flt_08_login",
    with_views(
        ["tenants", "users"],
        f"""{_PROFILE} WHERE u.username = 'customer#000000042'
        AND u.credential_digest IN (SELECT sha256('customer#000000042:' || c_mktsegment) FROM customer WHERE c_custkey = 42) LIMIT 1""",
    ),
)
def _(spark, folder):
    users = view.users(spark, folder)
    segment = view.table(spark, folder, "customer").where("c_custkey = 42").select("c_mktsegment").first()
    digest = F.sha2(F.lit(f"customer#000000042:{segment[0] if segment else ''}"), 256)
    return _profile_rows(op.login(users, view.tenants(spark, folder), "customer#000000042", digest))


@query(
    "flt_03_set_membership",
    with_views(
        ["chunks", "reports"],
        "SELECT id, report_id FROM chunks WHERE report_id IN (SELECT r.id FROM reports r JOIN labels l ON r.doc_id = l.doc_id WHERE quality = 1)",
    ),
)
def _(spark, folder):
    good = view.table(spark, folder, "labels").where("quality = 1").select("doc_id")
    wanted = view.reports(spark, folder).join(good, "doc_id").select(F.col("id").alias("report_id"))
    return view.line_chunks(spark, folder).join(wanted, "report_id", "left_semi").select("id", "report_id")


@query(
    "flt_18_uuid_check",
    with_views(
        ["reports"],
        """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE id END AS canonical FROM reports""",
    ),
)
def _(spark, folder):
    rows = view.reports(spark, folder)
    typed = (
        F.when(F.col("doc_id") % 4 == 0, F.upper("id"))
        .when(F.col("doc_id") % 4 == 1, F.replace("id", F.lit("-"), F.lit("")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" {"), "id", F.lit("} ")))
        .otherwise(F.concat("id", F.lit("0")))
    )
    return rows.select("doc_id", ids.canonical_uuid(typed).alias("canonical"))


@query(
    "win_03_reading_positions",
    with_views(
        ["chunks"],
        "SELECT id, row_number() OVER (PARTITION BY report_id ORDER BY page_number, chunk_index) AS pos FROM chunks",
    ),
)
def _(spark, folder):
    return positions.reading_positions(view.line_chunks(spark, folder)).select("id", "pos")


@query(
    "agg_03_window_bounds",
    with_views(
        ["chunks"],
        """SELECT report_id, min(pos) - 2 AS lo, max(pos) + 2 AS hi
        FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page_number, chunk_index) AS pos FROM chunks)
        WHERE contains(content, 'ti') GROUP BY report_id""",
    ),
)
def _(spark, folder):
    placed = positions.reading_positions(view.line_chunks(spark, folder))
    return placed.where(F.contains("content", F.lit("ti"))).groupBy("report_id").agg(
        (F.min("pos") - 2).alias("lo"), (F.max("pos") + 2).alias("hi")
    )


@query("set_03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, folder):
    docs = view.table(spark, folder, "documents").select("doc_id")
    return docs.join(view.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_02_union", "SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT vec_id FROM embeddings")
def _(spark, folder):
    good = view.table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return good.union(view.table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))).distinct()


@query(
    "agg_14_batch_summary",
    """SELECT count(*) AS total, count(*) FILTER (d.n_chars >= 100) AS succeeded, count(*) FILTER (d.n_chars < 100) AS failed,
              CASE WHEN count(*) FILTER (d.n_chars < 100) > 0 THEN 1 ELSE 0 END AS exit_code FROM documents d""",
)
def _(spark, folder):
    status = F.when(F.col("n_chars") >= 100, "succeeded").otherwise("failed").alias("status")
    return op.batch_summary(view.table(spark, folder, "documents").select(status))


@query(
    "ing_03_stop_on_error",
    """SELECT doc_id AS seq FROM documents
    WHERE doc_id <= coalesce((SELECT min(doc_id) FROM documents WHERE n_chars < 40), (SELECT max(doc_id) FROM documents))""",
)
def _(spark, folder):
    status = F.when(F.col("n_chars") >= 40, "succeeded").otherwise("failed").alias("status")
    rows = view.table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), status)
    return op.first_failure(rows).select("seq")


@query(
    "fn_25_key_values",
    r"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL
        ELSE 'lang=' || lang || ';note=a=b' || ';src=' || source END AS pairs FROM documents""",
)
def _(spark, folder):
    docs = view.table(spark, folder, "documents")
    items = F.array(
        F.lit("src=first"),
        F.concat(F.lit(" lang ="), "lang"),
        F.concat(F.lit("src="), "source"),
        F.when(F.col("doc_id") % 5 == 4, " = no key").otherwise("note=a=b"),
    )
    pairs = text.key_values(items)
    listed = F.array_sort(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return docs.select("doc_id", F.array_join(listed, ";").alias("pairs"))


@query(
    "flt_04_position_range",
    with_views(
        ["chunks"],
        """SELECT id, pos FROM (SELECT id, row_number() OVER (PARTITION BY report_id ORDER BY page_number, chunk_index) AS pos FROM chunks)
        WHERE pos BETWEEN 3 AND 6""",
    ),
)
def _(spark, folder):
    placed = positions.reading_positions(view.line_chunks(spark, folder))
    return placed.where(F.col("pos").between(3, 6)).select("id", "pos")
