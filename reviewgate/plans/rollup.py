"""Daily sums of the audit log, which reports read instead of the log.

Each run adds its own sums per day and event type, in a folder of its day and run that a
repeated run replaces. Sums, least and largest values merge, so reading adds the runs up. Days
that are over are compacted: one folder per day replaces those of the runs and names the runs it
holds; what is left of these does not count any more. Where a day cannot be corrected by
adding, after expiry or after a compacted run was repeated, its sums are made from the log again.

A report's period may begin or end within a day. The sums know the first and the last event of a
day, so a day is read from the log only if some of its events lie outside the period: two
days at most, however long the period is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.functions.numbers import exact_sum
from reviewgate.operators.audit import approved
from reviewgate.plans.reports import (
    analysis_measures,
    in_period,
    merged_analysis,
    parse_date,
)
from reviewgate.session import discard, materialise, scratch_path
from reviewgate.sources.tables import drop_expired, read_audit

c = F.col
#: Folder of a compacted day; no run is named so.
COMPACTED = "~compacted"


def day_sums(audit: DataFrame) -> DataFrame:
    """Measures per day and event type of some audit rows."""
    denied = c("policy_decision").isNotNull() & ~approved(c("policy_decision"))
    return audit.groupBy(
        "event_date", F.coalesce("event_type", F.lit("UNKNOWN")).alias("event_type")
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(denied).alias("violations"),
        F.sum(F.coalesce("processing_duration_ms", F.lit(0)).cast("long")).alias("duration_ms"),
        exact_sum(c("model_metadata.cost_usd")).alias("cost"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
        *analysis_measures(c("event_type") == "ANALYSIS"),
    )


def _merged() -> list[Column]:
    return [
        *[F.sum(x).alias(x) for x in ("events", "violations", "duration_ms", "cost")],
        F.min("earliest").alias("earliest"),
        F.max("latest").alias("latest"),
        *merged_analysis(),
    ]


def _write(sums: DataFrame, path: str) -> None:
    # Sums of sums are wider decimals; all files have the widest.
    wide = [f.name for f in sums.schema if isinstance(f.dataType, T.DecimalType)]
    sums.withColumns({x: c(x).cast("decimal(38,10)") for x in wide}).hint("rebalance", "event_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("event_date", "run").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException:
        return None
    kinds = {"run": T.StringType(), "event_date": T.DateType()}
    schema = T.StructType(
        [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found]
    )
    return spark.read.schema(schema).parquet(path)


def _live(stored: DataFrame) -> DataFrame:
    """Sums that count: not those of a run which its day's compacted folder holds."""
    held = stored.filter(c("run") == COMPACTED).select(
        "event_date", F.explode("runs").alias("run")
    )
    return stored.join(held.distinct(), ["event_date", "run"], "left_anti")


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Measures per day and event type."""
    stored = _stored(spark, path)
    if stored is None:
        raise ValueError(f"no sums are stored in {path}")
    return _live(stored).groupBy("event_date", "event_type").agg(*_merged())


def append_rollup(written: DataFrame, path: str, run_id: str | int, log: str) -> None:
    """Add the sums of one run's audit rows, as ``append_audit`` returned them.

    ``log`` is the stored log: days on which this run was compacted before are summed again.
    """
    spark = written.sparkSession
    run = str(run_id)
    stored = _stored(spark, path)
    again = []
    if stored is not None:
        held = stored.filter((c("run") == COMPACTED) & F.array_contains("runs", run))
        again = [r[0] for r in held.select("event_date").distinct().collect()]
    sums = day_sums(written)
    if again:
        sums = sums.filter(~c("event_date").isin(again))
    none = F.lit(None).cast("array<string>")
    _write(sums.withColumns({"runs": none, "run": F.lit(run)}), path)
    rebuild_days(spark, log, path, again)


def _replace(spark: SparkSession, path: str, days: list, sums: DataFrame) -> None:
    """Put compacted sums in the place of all folders of these days: written first, and
    naming the runs they hold, so that no reader counts a row twice or misses one."""
    before = _stored(spark, path).filter(c("event_date").isin(days))
    old = [tuple(r) for r in before.select("event_date", "run").distinct().collect()]
    scratch = scratch_path(spark, "rollup")
    fresh = materialise(sums.withColumn("run", F.lit(COMPACTED)), "rollup", scratch)
    _write(fresh, path)
    left = {r[0] for r in fresh.select("event_date").distinct().collect()}
    for day, run in old:
        if run != COMPACTED or day not in left:
            discard(spark, f"{path}/event_date={day}/run={run}")
    discard(spark, scratch)


def rebuild_days(spark: SparkSession, log: str, path: str, days: list) -> None:
    """Sums of some days from the log."""
    if not days:
        return
    rows = read_audit(spark, log).filter(c("event_date").isin(days))
    # One name per run of a day, as in the folders of the log.
    runs = rows.groupBy("event_date").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    _replace(spark, path, days, day_sums(rows).join(runs, "event_date"))


def compact_rollup(spark: SparkSession, path: str, before) -> None:
    """One folder for each day before the date ``before`` that has several."""
    stored = _stored(spark, path)
    many = stored.filter(c("event_date") < F.lit(before)).groupBy("event_date")
    days = [
        r["event_date"]
        for r in many.agg(F.count_distinct("run").alias("n")).filter("n > 1").collect()
    ]
    if not days:
        return
    rows = stored.filter(c("event_date").isin(days))
    names = F.when(c("run") == COMPACTED, c("runs")).otherwise(F.array("run"))
    runs = rows.groupBy("event_date").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias("runs")
    )
    sums = _live(rows).groupBy("event_date", "event_type").agg(*_merged())
    _replace(spark, path, days, sums.join(runs, "event_date"))


def expire(spark: SparkSession, log: str, path: str, now: Column) -> list:
    """Drop expired rows from the log and correct the sums of the days that lost some."""
    days = drop_expired(spark, log, now)
    rebuild_days(spark, log, path, days)
    return days


def type_sums(spark: SparkSession, log: str, path: str, start, end) -> DataFrame:
    """Measures per event type of a period, both ends inclusive."""
    first, last = parse_date(start), parse_date(end)
    days = read_rollup(spark, path).filter(
        c("event_date").between(F.lit(first.date()), F.lit(last.date()))
    )
    border = days.filter(c("event_date").isin([first.date(), last.date()]))
    # Two days at most.
    cut = [
        r["event_date"]
        for r in border.groupBy("event_date")
        .agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
        .collect()
        if r["earliest"] < first or r["latest"] > last
    ]
    rows = days
    if cut:
        part = read_audit(spark, log).filter(c("event_date").isin(cut))
        rows = days.filter(~c("event_date").isin(cut)).unionByName(
            day_sums(in_period(part, start, end))
        )
    return rows.groupBy("event_type").agg(*_merged()).drop("earliest", "latest")
