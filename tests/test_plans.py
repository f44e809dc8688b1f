"""The plans Spark makes, not their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamplight.functions.providers import LexicalEmbedder
from lamplight.operators import catalog, layout, positions
from lamplight.plans import ingest, search, traces
from lamplight.sources import extract, standins as view


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_shuffles_nothing_and_packs_once(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("report_id"), F.col("lang").alias("channel_id"), "text"
    )
    packed = ingest.packed_documents(docs, extract.text_items(F.col("text")))
    rows = ingest.embedded(ingest.chunk_rows(packed), LexicalEmbedder())
    plan = plan_of(rows)
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython [_pack(") == 1 and plan.count("ArrowEvalPython [_nfkc_lists(") == 1


def test_page_cap_is_applied_before_the_shuffle(spark, tiny):
    plan = plan_of(layout.regions(view.layout_items(spark, tiny), cap=200))
    assert plan.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, tiny):
    plan = plan_of(search.in_scope(view.corpus(spark, tiny), "en").select("id", "embedding"))
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "ArrowEvalPython" not in plan


def test_no_product_joins(spark, tiny):
    chunks = view.line_chunks(spark, tiny)
    plans = [
        catalog.report_summaries(view.reports(spark, tiny), chunks),
        positions.reading_positions(chunks),
        catalog.profiles(view.users(spark, tiny), view.tenants(spark, tiny)),
        traces.latency_by(view.table(spark, tiny, "events"), "user_id"),
    ]
    for df in plans:
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan
