"""Windowed function metrics and alarms. Input rows: ``function, ts, is_error,
duration_ms`` (one per call). Works on batch and streaming tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgate.constants import ALARM_RULES

c = F.col
#: Largest rule list that is broadcast.
MAX_RULES = 1000


def function_metrics(calls: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Invocations, errors and mean duration per function and tumbling window."""
    return (
        calls.groupBy(F.window("ts", window), "function")
        .agg(
            F.count(F.lit(1)).alias("invocations"),
            F.count_if(c("is_error")).alias("errors"),
            F.avg("duration_ms").alias("mean_duration_ms"),
        )
        .select(
            c("window.start").alias("window_start"),
            c("window.end").alias("window_end"),
            "function",
            "invocations",
            "errors",
            "mean_duration_ms",
        )
    )


def hourly_invocations(calls: DataFrame) -> DataFrame:
    return (
        calls.groupBy(F.window("ts", "1 hour"), "function")
        .agg(F.count(F.lit(1)).alias("invocations"))
        .select(c("window.start").alias("window_start"), "function", "invocations")
    )


def metric_values(metrics: DataFrame, executions: DataFrame | None = None) -> DataFrame:
    """Long form ``source, metric, window_start, value``.

    ``executions`` (``window_start, failures``) holds the workflow's failed executions.
    Without it the errors of all functions together stand in for them; an error that the
    workflow caught counts there too.
    """
    per_function = metrics.select(
        c("function").alias("source"),
        "window_start",
        F.stack(
            F.lit(3),
            F.lit("invocations"),
            c("invocations").cast("double"),
            F.lit("errors"),
            c("errors").cast("double"),
            F.lit("mean_duration_ms"),
            c("mean_duration_ms"),
        ).alias("metric", "value"),
    )
    failed = metrics.withColumnRenamed("errors", "failures")
    workflow = (
        (failed if executions is None else executions)
        .groupBy("window_start")
        .agg(F.sum("failures").cast("double").alias("value"))
        .select(
            F.lit("workflow").alias("source"),
            "window_start",
            F.lit("errors").alias("metric"),
            "value",
        )
    )
    return per_function.unionByName(workflow)


def alarms(
    values: DataFrame,
    window_seconds: int = 300,
    rules: list[tuple[str, str, str, float, int]] | None = None,
) -> DataFrame:
    """Windows at which a rule has been breached for its number of consecutive
    windows. A window without calls does not breach.

    A breach counts for its own window and for the following ones a rule looks
    back from, so consecutive breaches meet in one hash aggregate; no rule's
    windows are gathered and sorted in one task.
    """
    rules = ALARM_RULES if rules is None else rules
    names, sources, metrics, thresholds, periods = zip(*rules)
    table = values.sparkSession.createDataFrame(
        pa.table(
            {
                "alarm": pa.array(names, pa.string()),
                "source": pa.array(sources, pa.string()),
                "metric": pa.array(metrics, pa.string()),
                "threshold": pa.array(thresholds, pa.float64()),
                "periods": pa.array(periods, pa.int32()),
            }
        )
    )
    hinted = F.broadcast(table) if len(rules) <= MAX_RULES else table
    breaches = values.join(hinted, ["source", "metric"]).filter(
        c("value") >= c("threshold")
    )
    supported = breaches.select(
        "alarm",
        "periods",
        "threshold",
        "value",
        "window_start",
        F.explode(F.sequence(F.lit(0), c("periods") - 1)).alias("_ahead"),
    ).withColumn(
        "alarm_window",
        F.timestamp_seconds(
            F.unix_timestamp("window_start") + c("_ahead") * F.lit(window_seconds)
        ),
    )
    return (
        supported.groupBy("alarm", "alarm_window", "periods", "threshold")
        .agg(
            F.count(F.lit(1)).alias("breaches"),
            F.max(F.when(c("_ahead") == 0, c("value"))).alias("value"),
        )
        .filter(c("breaches") == c("periods"))
        .select("alarm", "alarm_window", "threshold", "periods", "value")
    )


def alarm_transitions(raised: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Changes of state from the windows at which alarms stand (see ``alarms``): to ALARM at the
    first of a run of windows, to OK at the first one after it. Windows meet their neighbours by
    equality, so no alarm's windows are gathered."""
    start = F.unix_timestamp("alarm_window")
    here = raised.select("alarm", start.alias("_at"), "value")
    times = here.select("alarm", "_at")
    follows = times.withColumn("_at", c("_at") + F.lit(window_seconds))
    begun = here.join(follows, ["alarm", "_at"], "left_anti").select(
        "alarm", "_at", F.lit("OK").alias("state_before"), F.lit("ALARM").alias("state")
    )
    ended = follows.join(times, ["alarm", "_at"], "left_anti").select(
        "alarm", "_at", F.lit("ALARM").alias("state_before"), F.lit("OK").alias("state")
    )
    changes = begun.unionByName(ended)
    return changes.select(
        "alarm", F.timestamp_seconds("_at").alias("alarm_window"), "state_before", "state"
    )
