"""The engine's public calls over one warehouse.

Each call is one or two of the plans; rows come back as DataFrames. ``ValueError``
means a bad argument, ``LookupError`` something unknown, ``FileExistsError`` a clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lamplight import schemas
from lamplight.functions import ids
from lamplight.functions.providers import Embedder, LexicalEmbedder, OverlapReranker, Reranker
from lamplight.operators import catalog
from lamplight.plans import ingest, search
from lamplight.sources import extract, files
from lamplight.settings import ExtractOptions
from lamplight.sources.warehouse import Warehouse


@dataclass
class Service:
    store: Warehouse
    embedder: Embedder = field(default_factory=LexicalEmbedder)
    reranker: Reranker | None = field(default_factory=OverlapReranker)
    extractor: extract.Extractor | None = None

    @property
    def spark(self):
        return self.store.spark

    def _one(self, values: tuple, ddl: str) -> DataFrame:
        return self.spark.createDataFrame([values], ddl)

    # Channels

    def create_channel(self, name: str, description: str = "", metadata: dict[str, str] | None = None) -> str:
        wanted = self._one(
            (0, name, description, metadata or {}),
            "seq long, name string, description string, metadata map<string,string>",
        )
        channels = self.store.read("channels")
        reason = catalog.judge_new_channels(channels, wanted).first()["reason"]
        if reason == "blank name":
            raise ValueError("a channel needs a name")
        if reason:
            raise FileExistsError(f"channel {name.strip()!r} exists")
        new = catalog.new_channels(channels, wanted, F.current_timestamp())
        self.store.append("channels", new)
        return new.first()["id"]

    def channels(self) -> DataFrame:
        return catalog.channels_oldest_first(self.store.read("channels"))

    def channel(self, channel_id: str) -> DataFrame:
        return catalog.channel_by_id(self.store.read("channels"), channel_id)

    def channel_named(self, name: str) -> DataFrame:
        return catalog.channel_by_name(self.store.read("channels"), name)

    # Reports

    def upsert_report(
        self, channel_id: str, filename: str, title: str = "", metadata: dict[str, str] | None = None
    ) -> str:
        if not filename.strip():
            raise ValueError("a report needs a file name")
        incoming = self._one(
            (0, channel_id, filename, title, metadata or {}),
            "seq long, channel_id string, filename string, title string, metadata map<string,string>",
        )
        mine = self.store.read("reports").where(F.col("channel_id") == channel_id)
        self.store.overwrite("reports", catalog.upsert_reports(mine, incoming, F.current_timestamp()))
        return incoming.select(catalog.report_id(F.col("channel_id"), F.trim("filename"))).first()[0]

    def report(self, report_id: str) -> DataFrame:
        return catalog.report_by_id(self.store.read("reports"), report_id)

    def reports(self, channel_id: str) -> DataFrame:
        """Reports of a channel with their page and chunk counts, oldest first."""
        mine = self.store.read("reports").where(F.col("channel_id") == channel_id)
        chunks = self.store.read("report_chunks").where(F.col("channel_id") == channel_id)
        return catalog.report_summaries(mine, chunks).orderBy("created_at", "report_id")

    def delete_report(self, report_id: str) -> int:
        """Removes a report and its chunks; returns how many chunks went."""
        row = self.report(report_id).first()
        if row is None:
            raise LookupError(f"no report {report_id}")
        gone = self._one((row["channel_id"], report_id), "channel_id string, report_id string")
        none = self.spark.createDataFrame([], schemas.CHUNKS)
        deleted = self.store.replace_chunks(none, gone).first()["deleted"]
        mine = self.store.read("reports").where(F.col("channel_id") == row["channel_id"])
        left = catalog.without_reports(mine, gone, "id")
        emptied = gone.join(left.select("channel_id"), "channel_id", "left_anti")
        last = bool(emptied.take(1))
        if last:
            self.store.drop_partitions("reports", gone)
        else:
            self.store.overwrite("reports", left)
        return deleted

    # Ingest and query

    def ingest_path(
        self, path: str, channel_id: str, *, recursive: bool = False, title: str = "",
        metadata: dict[str, str] | None = None, options: ExtractOptions = ExtractOptions(), stop_on_error: bool = False,
    ) -> ingest.IngestResult:
        if self.extractor is None:
            raise RuntimeError("no extractor for PDF files is configured")
        if not self.channel(channel_id).take(1):
            raise LookupError(f"no channel {channel_id}")
        return ingest.ingest_files(
            self.store, path, channel_id, self.extractor, self.embedder,
            recursive=recursive, title=title, metadata=metadata, options=options, stop_on_error=stop_on_error,
        )

    def ingest_rows(self, docs: DataFrame, items: Column, tag: str) -> ingest.IngestResult:
        return ingest.ingest_documents(self.store, docs, items, self.embedder, tag)

    def query(self, text: str, channel_id: str, **knobs) -> DataFrame:
        knobs.setdefault("reranker", self.reranker)
        return search.hybrid_query(self.store.read("report_chunks"), text, channel_id, self.embedder, **knobs)

    # Tenants and sessions

    def tenants(self) -> DataFrame:
        return self.store.read("tenants").orderBy("channelid")

    def link_tenant(self, channelid: int, rag_channel_id: str) -> None:
        tenants = self.store.read("tenants")
        link = self._one((channelid, rag_channel_id), "channelid int, rag_channel_id string")
        reason = catalog.judge_links(tenants, link).first()["reason"]
        if reason == "unknown channel":
            raise LookupError(f"no tenant {channelid}")
        if reason:
            raise FileExistsError(reason)
        self.store.overwrite("tenants", catalog.link_tenants(tenants, link))

    def login(self, username: str, credential_digest: str, ip_address: str = "") -> tuple[DataFrame, str] | None:
        """The user's profile and a new session id, or nothing."""
        profile = catalog.login(
            self.store.read("users"), self.store.read("tenants"), username, credential_digest
        )
        user = profile.first()
        if user is None:
            return None
        opened = self._one((user["userid"], ip_address), "user_id int, ip_address string")
        now = self.spark.sql("SELECT current_timestamp() AS t").first()["t"]
        rows = catalog.open_sessions(opened.withColumn("login_at", F.lit(now)), self.store.settings.session_hours)
        self.store.append("sessions", rows)
        return profile, rows.first()["session_id"]

    def logout(self, session_id: str) -> None:
        ended = self._one((session_id,), "session_id string").withColumn("at", F.current_timestamp())
        self.store.overwrite("sessions", catalog.end_sessions(self.store.read("sessions"), ended))

    # Migrations

    def migrate(self, folder: str, dry_run: bool = False) -> list[str]:
        """Runs the SQL files the ledger does not have yet, in name order."""
        found = files.sql_files(self.spark, folder)
        waiting = catalog.pending(found, self.store.read("schema_migrations")).collect()
        for row in () if dry_run else waiting:
            for statement in filter(str.strip, row["sql"].split(";\n")):
                self.spark.sql(statement.strip().rstrip(";"))
            done = self._one((row["version"],), "version string").withColumn("applied_at", F.current_timestamp())
            self.store.append("schema_migrations", done)
        return [row["version"] for row in waiting]


def checked_uuid(spark, text: str, label: str) -> str:
    row = spark.createDataFrame([(text,)], "t string").select(ids.canonical_uuid(F.col("t"))).first()
    if row[0] is None:
        raise ValueError(f"{label} is not a UUID: {text}")
    return row[0]
