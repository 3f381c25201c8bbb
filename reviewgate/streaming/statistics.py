"""Running audit statistics and function metrics over streams.

A micro-batch writes the sums of its own rows per window, in a folder named by the batch
that a repeated batch overwrites. Reading adds the batches up. So every window is whole at any
time, the newest one and those that late rows still reach included, and no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewgate.functions.numbers import exact_sum
from reviewgate.operators.audit import approved
from reviewgate.sources.tables import write_rows

c = F.col


def _statistics_sums(audit: DataFrame, window: str) -> DataFrame:
    denied = c("policy_decision").isNotNull() & ~approved(c("policy_decision"))
    return audit.groupBy(
        F.window("timestamp", window).alias("window"),
        F.coalesce("event_type", F.lit("UNKNOWN")).alias("event_type"),
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(denied).alias("violations"),
        F.sum(F.coalesce("processing_duration_ms", F.lit(0)).cast("long")).alias("duration_ms"),
        exact_sum(c("model_metadata.cost_usd")).alias("total_cost"),
    )


def _statistics(sums: DataFrame) -> DataFrame:
    return sums.select(
        c("window.start").alias("window_start"),
        c("window.end").alias("window_end"),
        "event_type",
        "events",
        "violations",
        "duration_ms",
        c("total_cost").cast("double").alias("total_cost"),
    )


def windowed_statistics(audit: DataFrame, window: str = "1 hour") -> DataFrame:
    """Audit measures per window and event type of a batch table."""
    return _statistics(_statistics_sums(audit, window))


def read_statistics(spark: SparkSession, out: str) -> DataFrame:
    """The same measures of everything a stream has written so far."""
    sums = ["events", "violations", "duration_ms", "total_cost"]
    return _statistics(
        spark.read.parquet(out)
        .groupBy("window", "event_type")
        .agg(*[F.sum(x).alias(x) for x in sums])
    )


def _metric_sums(calls: DataFrame, window: str) -> DataFrame:
    return calls.groupBy(F.window("ts", window).alias("window"), "function").agg(
        F.count(F.lit(1)).alias("invocations"),
        F.count_if(c("is_error")).alias("errors"),
        F.sum(c("duration_ms").cast("long")).alias("duration_ms"),
        F.count("duration_ms").alias("timed"),
    )


def read_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Function metrics of everything a stream has written so far."""
    sums = ["invocations", "errors", "duration_ms", "timed"]
    return (
        spark.read.parquet(out)
        .groupBy("window", "function")
        .agg(*[F.sum(x).alias(x) for x in sums])
        .select(
            c("window.start").alias("window_start"),
            c("window.end").alias("window_end"),
            "function",
            "invocations",
            "errors",
            F.try_divide(c("duration_ms").cast("double"), c("timed")).alias("mean_duration_ms"),
        )
    )


def _start(rows: DataFrame, sums, out: str, checkpoint: str, trigger: dict | None):
    return (
        rows.writeStream.foreachBatch(
            lambda batch, batch_id: write_rows(sums(batch), out, batch_id)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_audit_statistics(
    audit: DataFrame,
    out: str,
    checkpoint: str,
    window: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the sums of arriving audit rows; ``read_statistics`` adds them up."""
    return _start(audit, lambda x: _statistics_sums(x, window), out, checkpoint, trigger)


def start_function_metrics(
    calls: DataFrame,
    out: str,
    checkpoint: str,
    window: str = "5 minutes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the sums of arriving calls; ``read_metrics`` adds them up."""
    return _start(calls, lambda x: _metric_sums(x, window), out, checkpoint, trigger)


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to a parquet folder, then stop."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
