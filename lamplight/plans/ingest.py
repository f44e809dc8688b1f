"""Documents to stored chunks.

Each document stays one row from source to chunk array: items, blocks, packing and
language are all computed inside that row, and the chunks are then exploded and
embedded. Nothing is shuffled before the write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lamplight.functions import ids, text
from lamplight.functions.providers import Embedder
from lamplight.functions.splitting import pack
from lamplight.operators import catalog, layout
from lamplight.operators.rows import exploded
from lamplight.session import stored
from lamplight.sources import extract, files
from lamplight.sources.warehouse import Warehouse
from lamplight.settings import DEFAULTS, ExtractOptions, Settings

# Reasons a document is refused.
NO_VECTORS = "embedder returned the wrong number of vectors"


def packed_documents(docs: DataFrame, items: Column, boxed: bool = False) -> DataFrame:
    """``docs`` plus blocks, packed chunks and languages, still one row per document."""
    return (
        extract.with_blocks(docs, items, boxed)
        .withColumn("detected_languages", extract.languages_of_blocks(F.col("blocks")))
        .withColumn("packed", pack(F.col("blocks")))
    )


def chunk_rows(packed: DataFrame) -> DataFrame:
    """One row per chunk: chunk_index counts over the whole document."""
    keep = [c for c in packed.columns if c not in ("blocks", "packed", "detected_languages")]
    language = layout.document_language(F.col("detected_languages"))
    rows = packed.select(*keep, language.alias("language"), "packed")
    return exploded(rows, F.col("packed"), "chunk_index", "_c").select(
        *keep,
        "language",
        "chunk_index",
        F.coalesce(F.nullif("_c.page_number", F.lit(0)), F.lit(1)).alias("page_number"),
        "_c.content",
        "_c.section_title",
        "_c.block_types",
        "_c.bboxes",
        "_c.piece",
    )


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds both vectors and fails on a chunk whose vectors are missing or misshapen."""
    content = F.coalesce("content", F.lit(""))
    rows = chunks.withColumns(
        {"embedding": embedder.dense(content), "sparse_embedding": embedder.sparse(content)}
    )
    good = (F.size("embedding") == embedder.dimension) & F.col("sparse_embedding").isNotNull()
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("embedding")).otherwise(
        F.raise_error(F.lit(NO_VECTORS)).cast("array<float>")
    )
    return rows.withColumn("embedding", checked)


def chunk_table(chunks: DataFrame, extractor: str, now: Column) -> DataFrame:
    """Embedded chunks in the shape of the stored table, bucket aside."""
    return chunks.select(
        ids.stable_uuid("chunk", F.col("report_id"), F.col("chunk_index")).alias("id"),
        "channel_id",
        "report_id",
        F.col("page_number").cast("int").alias("page_number"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "content",
        "embedding",
        "sparse_embedding",
        F.struct(
            "section_title", "block_types", "bboxes", "language", F.lit(extractor).alias("extractor")
        ).alias("metadata"),
        now.alias("created_at"),
    )


def ingest_stats(
    packed: DataFrame, embedder: Embedder, extractor: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Per document: pages, chunks, models and object keys, from the packed row itself."""
    pages = F.array_distinct(F.transform("packed", lambda c: F.coalesce(F.nullif(c["page_number"], F.lit(0)), F.lit(1))))
    channel, report = F.col("channel_id"), F.col("report_id")
    prefix = settings.bucket_prefix.strip().strip("/")
    raw = text.object_key(prefix, channel, F.lit("raw"), report, text.safe_filename(F.col("filename")))
    markdown = text.object_key(prefix, channel, F.lit("markdown"), F.concat(report, F.lit(".md")))
    meta = text.object_key(prefix, channel, F.lit("metadata"), F.concat(report, F.lit(".json")))
    return packed.select(
        "channel_id",
        "report_id",
        F.size(pages).alias("pages_processed"),
        F.size("packed").alias("chunks_inserted"),
        F.size(F.array_distinct(F.transform("blocks", lambda b: b["page_number"]))).alias("pages_total"),
        F.lit(extractor).alias("extractor"),
        F.lit(embedder.name).alias("embed_model"),
        F.lit(embedder.dimension).alias("embed_dim"),
        F.lit(embedder.sparse_dimension).alias("embed_sparse_dim"),
        F.lit(settings.bucket).alias("bucket"),
        raw.alias("raw_key"),
        markdown.alias("markdown_key"),
        meta.alias("metadata_key"),
        "detected_languages",
        layout.document_language(F.col("detected_languages")).alias("language"),
    )


def metadata_document(
    docs: DataFrame, stats: DataFrame, now: Column, options: ExtractOptions = ExtractOptions()
) -> DataFrame:
    """The JSON record of each ingested document.

    ``docs`` brings report_id, filename, content_sha256, original_bytes, markdown_bytes.
    """
    rows = docs.select("report_id", "filename", "content_sha256", "original_bytes", "markdown_bytes").join(
        stats, "report_id"
    )
    record = F.struct(
        F.col("report_id").alias("document_id"),
        "channel_id",
        text.safe_filename(F.col("filename")).alias("source_filename"),
        "content_sha256",
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ingested_at"),
        "markdown_bytes",
        "original_bytes",
        F.lit(options.ocr_fallback).alias("use_ocr"),
        "extractor",
        "language",
        "detected_languages",
        "pages_total",
        F.col("pages_processed").alias("pages_with_chunks"),
        "chunks_inserted",
        "embed_model",
        "embed_dim",
        "embed_sparse_dim",
        F.struct("bucket", "raw_key", "markdown_key").alias("storage"),
    )
    return rows.select("report_id", "metadata_key", F.to_json(record).alias("record"))


@dataclass
class IngestResult:
    stats: DataFrame
    rejects: DataFrame
    deleted: DataFrame


def ingest_documents(
    store: Warehouse,
    docs: DataFrame,
    items: Column,
    embedder: Embedder,
    extractor: str,
    now: Column | None = None,
    boxed: bool = False,
) -> IngestResult:
    """Upsert the reports of ``docs``, replace their chunks, return what happened.

    ``docs`` has seq, channel_id, filename, title, metadata and whatever ``items``
    reads; a non-null ``fault`` column sends a row to the rejects instead. ``boxed``: the
    items have boxes, which go to the chunks. Running it twice leaves the same tables as
    running it once.
    """
    now = F.current_timestamp() if now is None else now
    stem = text.file_stem(F.col("filename"))
    titled = docs.withColumn("title", catalog.default_title(F.col("title"), stem))
    fault = F.col("fault") if "fault" in docs.columns else F.lit(None).cast("string")
    titled = titled.withColumn("fault", fault)
    rejects = titled.where(F.col("fault").isNotNull())
    good = titled.where(F.col("fault").isNull()).withColumn(
        "report_id", catalog.report_id(F.col("channel_id"), text.strip(F.col("filename")))
    )

    wanted = good.select("seq", "channel_id", "filename", "title", "metadata")
    channels = wanted.select("channel_id").distinct()
    reports = store.read("reports").join(channels, "channel_id", "left_semi")
    store.overwrite("reports", catalog.upsert_reports(reports, wanted, now))

    # Of several files of one name in a batch the last is ingested, as in sequence.
    # The earlier ones are few, so the documents themselves are not shuffled for it.
    last = good.groupBy("report_id").agg(F.max("seq").alias("_last"))
    earlier = good.select("report_id", "seq").join(last, "report_id").where("seq < _last").drop("_last")
    good = good.join(earlier, ["report_id", "seq"], "left_anti")
    # Extraction is the costly step: its result is written once, and the chunks, the
    # replaced reports and the statistics read the columns they need from there.
    kept = ["channel_id", "report_id", "filename", "blocks", "detected_languages", "packed"]
    # Of the blocks only the pages are read again, their words are in the chunks.
    pages = F.transform(F.array_distinct(F.transform("blocks", lambda b: b["page_number"])), lambda p: F.struct(p.alias("page_number")))
    packed = stored(packed_documents(good, items, boxed).select(*kept).withColumn("blocks", pages), "packed")
    # Dealt to the folders before they are embedded: their vectors are longer than they are.
    rows = store.dealt("report_chunks", store.with_bucket(chunk_rows(packed.drop("filename"))))
    table = chunk_table(embedded(rows, embedder), extractor, now)
    deleted = store.replace_chunks(table, packed.select("channel_id", "report_id"), again=True, dealt=True)
    stats = ingest_stats(packed, embedder, extractor, store.settings)
    return IngestResult(stats, rejects, deleted)


def ingest_files(
    store: Warehouse,
    path: str,
    channel_id: str,
    extractor: extract.Extractor,
    embedder: Embedder,
    *,
    recursive: bool = False,
    title: str = "",
    metadata: dict[str, str] | None = None,
    options: ExtractOptions = ExtractOptions(),
    stop_on_error: bool = False,
) -> IngestResult:
    """Every PDF under ``path`` into one channel; unreadable files become rejects.

    ``title`` applies when ``path`` is one file; in a folder each file keeps its stem.
    ``options`` turn kinds of items off. ``stop_on_error`` leaves out the files whose path
    comes after that of the first unreadable one. An extractor with ``parse`` is run once,
    its items and faults are written and read from there.
    """
    single = path.lower().endswith(".pdf")
    found = files.validate(files.pdf_files(store.spark, path, recursive))
    meta = F.create_map(*[F.lit(x) for pair in (metadata or {}).items() for x in pair])
    docs = found.select(
        F.col("path").alias("seq"),
        F.lit(channel_id).alias("channel_id"),
        files.file_name(F.col("path")).alias("filename"),
        F.lit(title if single else "").alias("title"),
        meta.cast("map<string,string>").alias("metadata"),
        "content",
        "fault",
        "size_bytes",
        "header_hex",
    )
    boxed = hasattr(extractor, "parse")
    if boxed:
        parsed = extractor.parse(F.when(F.col("fault").isNull(), F.col("content")))
        docs = stored(docs.withColumn("parsed", parsed).drop("content"), "parsed")
        docs = docs.withColumn("fault", F.coalesce("fault", "parsed.fault"))
    if stop_on_error:
        first = docs.where(F.col("fault").isNotNull()).agg(F.min("seq")).first()[0]
        docs = docs if first is None else docs.where(F.col("seq") <= first)
    items = F.col("parsed.items") if boxed else extractor.items(F.col("content"))
    return ingest_documents(
        store, docs, extract.wanted_items(items, options), embedder, extractor.tag, boxed=boxed
    )


def ingest_message(stats: DataFrame, latency_ms: int | None = None) -> DataFrame:
    """The summary a user sees after an ingest."""
    latency = "?" if latency_ms is None else str(latency_ms)
    return stats.select(
        "report_id",
        F.concat(
            F.lit("Ingestion complete.\n\n- **Report ID:** "), "report_id",
            F.lit("\n- **Pages processed:** "), F.col("pages_processed").cast("string"),
            F.lit(" / "), F.col("pages_total").cast("string"),
            F.lit("\n- **Chunks inserted:** "), F.col("chunks_inserted").cast("string"),
            F.lit(f"\n- **Latency:** {latency} ms"),
        ).alias("message"),
    )
