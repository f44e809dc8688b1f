"""Channels, reports, tenants, users and sessions as joins over plain tables.

Plain Parquet has no row-level update, so every change is the set of rows that
replaces the touched partitions. The functions here compute those rows; the
warehouse writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamplight.functions import ids, text
from lamplight.settings import DEFAULTS

# Label of an unlinked tenant, and the feature that opens the admin pages.
NOT_LINKED = "— not linked —"
ADMIN_FEATURE = "admin_panel"


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return rows.groupBy(*key).count().where("count > 1")


# Channels ---------------------------------------------------------------------


def channels_oldest_first(channels: DataFrame) -> DataFrame:
    return channels.orderBy("created_at", "id")


def channel_by_id(channels: DataFrame, channel_id: str) -> DataFrame:
    return channels.where(F.col("id") == channel_id).limit(1)


def channel_by_name(channels: DataFrame, name: str) -> DataFrame:
    return channels.where(F.col("name") == name.strip()).limit(1)


def judge_new_channels(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (seq, name, …) with the stripped name and why a row cannot go in.

    The first of several equal names in one batch wins. A null name counts as blank.
    """
    named = wanted.withColumn("name", F.coalesce(text.strip(F.col("name")), F.lit("")))
    first = named.groupBy("name").agg(F.min("seq").alias("_first"))
    taken = channels.select("name", F.lit(True).alias("_taken"))
    reason = (
        F.when(F.col("name") == "", "blank name")
        .when(F.col("_taken") | (F.col("seq") > F.col("_first")), "name exists")
    )
    return (
        named.join(first, "name")
        .join(taken, "name", "left")
        .withColumn("reason", reason)
        .drop("_first", "_taken")
    )


def new_channels(channels: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    return judge_new_channels(channels, wanted).where(F.col("reason").isNull()).select(
        ids.stable_uuid("channel", F.col("name")).alias("id"),
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        "metadata",
        now.alias("created_at"),
    )


# Reports ----------------------------------------------------------------------


def report_by_id(reports: DataFrame, report_id: str) -> DataFrame:
    return reports.where(F.col("id") == report_id).limit(1)


def reports_of_channel(reports: DataFrame, channel_id: str) -> DataFrame:
    return reports.where(F.col("channel_id") == channel_id).orderBy("created_at", "id")


def report_id(channel_id: Column, filename: Column) -> Column:
    return ids.stable_uuid("report", channel_id, filename)


def default_title(title: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), fallback)


def upsert_reports(reports: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Reports after ``incoming`` (seq, channel_id, filename, title, metadata).

    A known (channel, filename) takes the new title and metadata and keeps its id and
    creation time. Of several incoming rows for one file the last wins.
    """
    key = ["channel_id", "filename"]
    named = incoming.withColumn("filename", text.strip(F.col("filename"))).where(F.col("filename") != "")
    latest = named.groupBy(*key).agg(
        F.max_by(F.struct("title", "metadata"), "seq").alias("_new")
    )
    old = reports.select(*key, F.struct("id", "title", "metadata", "created_at").alias("_old"))
    both = old.join(latest, key, "full_outer")
    fresh = F.col("_new").isNotNull()
    return both.select(
        F.coalesce(F.col("_old.id"), report_id(F.col("channel_id"), F.col("filename"))).alias("id"),
        *key,
        F.when(fresh, F.col("_new.title")).otherwise(F.col("_old.title")).alias("title"),
        F.when(fresh, F.col("_new.metadata")).otherwise(F.col("_old.metadata")).alias("metadata"),
        F.coalesce(F.col("_old.created_at"), now).alias("created_at"),
    )


def replace_chunks(chunks: DataFrame, incoming: DataFrame, replaced: DataFrame) -> DataFrame:
    """Chunks after the reports in ``replaced`` got ``incoming`` in place of theirs."""
    kept = chunks.join(replaced.select("report_id").distinct(), "report_id", "left_anti")
    return kept.unionByName(incoming)


def chunks_per_report(chunks: DataFrame, report_ids: DataFrame) -> DataFrame:
    """How many chunks each report in ``report_ids`` has, 0 included."""
    wanted = report_ids.select("report_id").distinct()
    counted = chunks.join(wanted, "report_id", "left_semi").groupBy("report_id").count()
    return wanted.join(counted, "report_id", "left").select(
        "report_id", F.coalesce("count", F.lit(0)).alias("chunks")
    )


def without_reports(rows: DataFrame, gone: DataFrame, column: str = "report_id") -> DataFrame:
    return rows.join(gone.select(F.col("report_id").alias(column)).distinct(), column, "left_anti")


def reports_of_channels(reports: DataFrame, gone_channels: DataFrame) -> DataFrame:
    """Reports that go when their channels go."""
    return reports.join(
        gone_channels.select("channel_id").distinct(), "channel_id", "left_semi"
    ).select(F.col("id").alias("report_id"))


def page_and_chunk_counts(chunks: DataFrame) -> DataFrame:
    """Distinct pages and chunks per report; pages are folded first, so one report
    with very many chunks is combined before the last shuffle."""
    by_page = chunks.groupBy("report_id", "page_number").agg(F.count(F.lit(1)).alias("_n"))
    return by_page.groupBy("report_id").agg(
        F.count("page_number").alias("page_count"), F.sum("_n").alias("chunk_count")
    )


def report_summaries(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Reports with their counts, 0 where nothing was chunked."""
    counts = page_and_chunk_counts(
        chunks.join(reports.select(F.col("id").alias("report_id")), "report_id", "left_semi")
    )
    return reports.join(counts, reports["id"] == counts["report_id"], "left").select(
        reports["id"].alias("report_id"),
        "filename",
        "title",
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        "created_at",
    )


def report_table(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "report_id",
        "filename",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("created_at"),
    )


def report_choices(summaries: DataFrame) -> DataFrame:
    label = F.concat("filename", F.lit(" ("), F.substring("report_id", 1, 8), F.lit("…)"))
    return summaries.select(label.alias("label"), "report_id")


# Tenants, users, sessions -------------------------------------------------------


def tenant_table(tenants: DataFrame) -> DataFrame:
    return tenants.select(
        "channelid",
        "name",
        F.coalesce("rag_channel_id", F.lit(NOT_LINKED)).alias("rag_channel_id"),
        F.array_join(F.coalesce("authorized_features", F.array()), ", ").alias("features"),
    )


def unlinked(tenants: DataFrame) -> DataFrame:
    return tenants.where(F.col("rag_channel_id").isNull())


def linked(tenants: DataFrame) -> DataFrame:
    return tenants.where(F.col("rag_channel_id").isNotNull())


def judge_links(tenants: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (channelid, rag_channel_id) with the reason a link is refused, if any."""
    known = tenants.select("channelid", F.col("rag_channel_id").alias("_own"), F.lit(True).alias("_known"))
    owners = linked(tenants).select("rag_channel_id", F.col("channelid").alias("_owner"))
    return (
        links.join(known, "channelid", "left")
        .join(owners, "rag_channel_id", "left")
        .select(
            "channelid",
            "rag_channel_id",
            F.when(F.col("_known").isNull(), "unknown channel")
            .when(F.col("_own").isNotNull(), "already linked")
            .when(F.col("_owner").isNotNull(), "corpus in use")
            .alias("reason"),
        )
    )


def link_tenants(tenants: DataFrame, links: DataFrame) -> DataFrame:
    """``tenants`` with the links that are in order. Of several links of one tenant, and then of several tenants that
    ask for one corpus, the first by id wins."""
    good = judge_links(tenants, links).where(F.col("reason").isNull())
    good = good.groupBy("channelid").agg(F.min("rag_channel_id").alias("_new"))
    good = good.groupBy("_new").agg(F.min("channelid").alias("channelid"))
    return tenants.join(good, "channelid", "left").withColumn(
        "rag_channel_id", F.coalesce("_new", "rag_channel_id")
    ).drop("_new")


def has_feature(feature: str, features: Column | None = None) -> Column:
    column = F.col("authorized_features") if features is None else features
    return F.coalesce(F.array_contains(column, feature), F.lit(False))


def profiles(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """User rows with the tenant they belong to."""
    owner = tenants.select(
        "channelid", F.col("name").alias("channel_name"), F.col("rag_channel_id")
    )
    return users.join(owner, "channelid").select(
        "userid",
        "name",
        "username",
        "channelid",
        F.coalesce("authorized_features", F.array().cast("array<string>")).alias("authorized_features"),
        F.coalesce("authorized_data", F.create_map().cast("map<string,string>")).alias("authorized_data"),
        "channel_name",
        "rag_channel_id",
    )


def login(users: DataFrame, tenants: DataFrame, username: str, credential_digest: str) -> DataFrame:
    match = users.where(
        (F.col("username") == username) & (F.col("credential_digest") == credential_digest)
    ).limit(1)
    return profiles(match, tenants)


def open_sessions(logins: DataFrame, hours: int = DEFAULTS.session_hours) -> DataFrame:
    """``logins`` (user_id, ip_address, login_at) as session rows that expire later."""
    return logins.select(
        ids.stable_uuid("session", F.col("user_id"), F.col("login_at"), F.col("ip_address")).alias("session_id"),
        "user_id",
        "ip_address",
        "login_at",
        (F.col("login_at") + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
    )


def end_sessions(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """``ended`` (session_id, at) stamps the end of those sessions; of several ends of one the first counts."""
    first = ended.groupBy("session_id").agg(F.min("at").alias("_at"))
    return (
        sessions.join(first, "session_id", "left")
        .withColumn("ended_at", F.coalesce("_at", "ended_at"))
        .drop("_at")
    )


def session_state(at: Column) -> Column:
    return (
        F.when(F.col("ended_at") <= at, "ended")
        .when(F.col("expires_at") <= at, "expired")
        .when(F.col("login_at") <= at, "open")
        .otherwise("future")
    )


# Migrations ---------------------------------------------------------------------


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Versions on file that the ledger does not have, in name order."""
    return files.join(applied.select("version"), "version", "left_anti").orderBy("version")


def migration_status(files: DataFrame, applied: DataFrame) -> DataFrame:
    return (
        files.select("version")
        .join(applied.select("version", "applied_at"), "version", "full_outer")
        .withColumn("state", F.when(F.col("applied_at").isNull(), "pending").otherwise("applied"))
        .orderBy("version")
    )


def record_applied(applied: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Ledger after ``done``; a version already there keeps its first time."""
    fresh = done.select("version").distinct().join(applied.select("version"), "version", "left_anti")
    return applied.unionByName(fresh.withColumn("applied_at", now))


# Batch runs ---------------------------------------------------------------------


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Outcome rows (status) as counts and the exit code of the run."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))


def first_failure(outcomes: DataFrame) -> DataFrame:
    """What a run that stops on the first error reports: rows up to that error."""
    stop = outcomes.where(F.col("status") == "failed").agg(F.min("seq")).first()[0]
    return outcomes if stop is None else outcomes.where(F.col("seq") <= stop)
