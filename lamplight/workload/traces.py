"""Trace roll-ups, batch and streaming."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lamplight.plans import traces
from lamplight.session import shared_folder
from lamplight.sources import standins as view
from lamplight.streaming import jobs
from lamplight.workload.register import query

WIDTH = "1 day"
DELAY = "1 hour"


def _latency_sql(key: str) -> str:
    return f"""SELECT {key}, count(*) AS events, round(sum(value), 2) AS total_latency, round(quantile_cont(value, 0.5), 6) AS p50,
        round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max_latency FROM events GROUP BY {key}"""


def _latency(spark, folder, key):
    rows = traces.latency_by(view.table(spark, folder, "events"), key)
    # Totals have two digits, so unlike means they never sit on a rounding edge.
    total = F.round(F.col("mean_latency") * F.col("events"), 2).alias("total_latency")
    return rows.select(key, "events", total, *[F.round(c, 6).alias(c) for c in ("p50", "p95")], "max_latency")


@query("agg_16_latency_by_user", _latency_sql("user_id"))
def _(spark, folder):
    return _latency(spark, folder, "user_id")


@query("agg_16_latency_by_tag", _latency_sql("event_type"))
def _(spark, folder):
    return _latency(spark, folder, "event_type")


@query(
    "agg_16_session_totals",
    """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS questions, sum(length(text))::BIGINT AS chars
    FROM conversations GROUP BY conv_id""",
)
def _(spark, folder):
    return traces.session_totals(view.table(spark, folder, "conversations"), "conv_id", F.length("text"))


@query(
    "str_03_windows",
    """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS events,
       round(sum(value), 4) AS total_latency FROM events GROUP BY ALL""",
)
def _(spark, folder):
    events = view.table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = traces.windowed(events, "at", WIDTH, "event_type")
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events",
        F.round("total_latency", 4).alias("total_latency"),
    )


@query(
    "str_03_closed_windows",
    """SELECT strftime(day, '%Y-%m-%d') AS day, event_type, events, total_latency
    FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS events, round(sum(value), 4) AS total_latency
          FROM events GROUP BY ALL)
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def _(spark, folder):
    schema = view.table(spark, folder, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
        .withColumn("at", F.col("ts").cast("timestamp"))
    )
    place = f"{shared_folder(spark)}/trace-windows-{uuid4().hex}"
    closed = jobs.trace_windows(stream, "at", WIDTH, DELAY, "event_type")
    jobs.to_files(closed, f"{place}/rows", f"{place}/state").awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{place}/rows").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events",
        F.round("total_latency", 4).alias("total_latency"),
    )


@query(
    "fn_28_json_fields",
    """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
       coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""",
)
def _(spark, folder):
    bag = F.from_json("props", "map<string,string>")
    return view.table(spark, folder, "events").select(
        "event_id",
        F.coalesce(bag["k"].cast("long"), F.lit(0)).alias("k"),
        F.coalesce(bag["missing"], F.lit("none")).alias("missing"),
    )
