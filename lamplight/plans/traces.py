"""Roll-ups of trace events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


QUANTILES = (0.5, 0.95)
# A quantile's value is looked for between approximate quantiles this far to either side, whose own error is smaller.
MARGIN, ACCURACY = 0.002, 10_000
# Keys of fewer values are ranked whole: there the margin is less than two ranks.
FEW = 1_000


def latency_by(events: DataFrame, key: str, latency: str = "value") -> DataFrame:
    """Count, mean, median and 95th percentile (exact, interpolated) of latency per key.

    Approximate quantiles, folded by partial sums, bound the range that holds a wanted rank. Values below the range
    are only counted, values in it are counted by value and put in order: a few thousandths of a hot key's values.
    """
    x = F.col(latency)
    sides = [F.lit(q + side) for q in QUANTILES for side in (-MARGIN, MARGIN)]
    totals = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.count(x).alias("_n"),
        F.avg(x).alias("mean_latency"),
        F.max(x).alias("max_latency"),
        F.percentile_approx(x, F.array(*sides), F.lit(ACCURACY)).alias("_sides"),
    )
    few = F.col("_n") < FEW
    wanted = F.array(
        *[
            F.struct(
                F.lit(q).alias("q"),
                F.when(~few, F.get("_sides", F.lit(2 * i))).alias("low"),
                F.when(~few, F.get("_sides", F.lit(2 * i + 1))).alias("high"),
                ((F.col("_n") - 1) * q).alias("at"),
            )
            for i, q in enumerate(QUANTILES)
        ]
    )
    bounds = totals.where("_n > 0").select(F.col(key).alias("_key"), F.explode(wanted).alias("w")).select("_key", "w.*")
    near = events.where(x.isNotNull()).join(bounds, F.col(key).eqNullSafe(F.col("_key")))
    near = near.where(F.col("high").isNull() | (x <= F.col("high")))
    # All values below the range fall on one row without a value.
    value = F.when(F.col("low").isNull() | (x >= F.col("low")), x.cast("double"))
    counted = near.groupBy("_key", "q", "at", value.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("_key", "q").orderBy(F.col("x").asc_nulls_first())
    running = counted.withColumn("upto", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = running.groupBy("_key", "q", "at").agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col("x"))).alias("lower"),
        F.min(F.when(F.col("upto") > F.ceil("at"), F.col("x"))).alias("upper"),
    )
    share = F.col("at") - F.floor("at")
    found = ranked.select("_key", "q", (F.col("lower") * (1 - share) + F.col("upper") * share).alias("cut"))
    wide = found.groupBy("_key").agg(
        *[F.max(F.when(F.col("q") == q, F.col("cut"))).alias(f"p{round(100 * q)}") for q in QUANTILES]
    )
    return totals.join(wide, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key, "events", "mean_latency", "p50", "p95", "max_latency"
    )


def session_totals(turns: DataFrame, session: str, length: Column) -> DataFrame:
    return turns.groupBy(session).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("role") == "user").alias("questions"),
        F.sum(length).alias("chars"),
    )


def windowed(events: DataFrame, at: str, width: str, key: str, latency: str = "value") -> DataFrame:
    """Events and latency per time window and key; also valid on a stream."""
    return events.groupBy(F.window(at, width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("events"), F.sum(latency).alias("total_latency")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events", "total_latency")
