"""Compliance reports over the audit log for a period (both ends inclusive)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate.constants import ASPECTS
from reviewgate.functions.numbers import exact_sum, ratio
from reviewgate.functions.text import isoformat, rounded
from reviewgate.operators.audit import approved
from reviewgate.session import materialise

c = F.col
DETAIL_ROWS = 100
TOP_TYPES = 10


def parse_date(value: str | datetime) -> datetime:
    """ISO text (a trailing Z or offset allowed) as naive UTC time."""
    from datetime import timezone

    moment = value if isinstance(value, datetime) else datetime.fromisoformat(
        value.replace("Z", "+00:00")
    )
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def _time(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def in_period(audit: DataFrame, start, end) -> DataFrame:
    """Rows of the period; day partitions outside it are not read."""
    first, last = parse_date(start), parse_date(end)
    rows = audit.filter(c("timestamp").between(_time(first), _time(last)))
    if "event_date" in audit.columns:
        rows = rows.filter(c("event_date").between(F.lit(first.date()), F.lit(last.date())))
    return rows


def _filtered(rows: DataFrame, product_id, user_id) -> DataFrame:
    if product_id:
        rows = rows.filter(c("product_id") == product_id)
    if user_id:
        rows = rows.filter(c("user_id") == user_id)
    return rows


def _of_type(audit: DataFrame, event_type: str, cap: int | None) -> DataFrame:
    """Events of one type; ``cap`` looks at the newest ``cap`` events only."""
    rows = audit.filter(c("event_type") == event_type)
    if cap is not None:
        rows = rows.orderBy(F.desc("timestamp"), F.asc("audit_id")).limit(cap)
    return rows


def _denied() -> Column:
    return c("policy_decision").isNotNull() & ~approved(c("policy_decision"))


def events_by_type(audit: DataFrame, start, end) -> DataFrame:
    """Measures per event type: the one aggregate all statistics come from."""
    return (
        in_period(audit, start, end)
        .groupBy(F.coalesce("event_type", F.lit("UNKNOWN")).alias("event_type"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(_denied()).alias("violations"),
            F.sum(F.coalesce("processing_duration_ms", F.lit(0)).cast("long")).alias(
                "duration_ms"
            ),
            exact_sum(c("model_metadata.cost_usd")).alias("cost"),
        )
    )


def audit_statistics(audit: DataFrame, start, end) -> DataFrame:
    """One row: totals, counts per type, violations, mean duration, cost."""
    return statistics_of(events_by_type(audit, start, end))


def statistics_of(by_type: DataFrame) -> DataFrame:
    """The statistics row from measures per event type."""
    # At most one row per event type reaches the collected map.
    return (
        by_type.agg(
            F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct("event_type", "events")))
            ).alias("events_by_type"),
            F.coalesce(F.sum("violations"), F.lit(0)).alias("policy_violations"),
            F.sum("duration_ms").alias("_duration"),
            F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_cost"),
        )
        .withColumn("average_processing_time", ratio(c("_duration"), c("total_events")))
        .drop("_duration")
    )


def compliance_summary(statistics: DataFrame) -> DataFrame:
    """Compliance rate, approvals, durations and cost from the statistics row."""
    total, denied = c("total_events"), c("policy_violations")
    rate = ratio(total - denied, total, 1.0) * 100
    average = c("average_processing_time")
    return statistics.select(
        F.struct(
            total.alias("total_records"),
            rounded(rate, 2).alias("compliance_rate_percent"),
            denied.alias("policy_violations"),
            rounded(average, 2).alias("average_processing_time_ms"),
            rounded(c("total_cost"), 4).alias("total_cost_usd"),
        ).alias("summary"),
        c("events_by_type").alias("event_breakdown"),
        F.struct(
            (total - denied).alias("approved_content"),
            denied.alias("rejected_content"),
            rounded(rate, 2).alias("approval_rate_percent"),
            rounded(ratio(denied, total) * 100, 2).alias("rejection_rate_percent"),
        ).alias("compliance_metrics"),
        F.struct(
            F.when(total > 0, total * average)
            .otherwise(0.0)
            .alias("total_processing_time_ms"),
            average.alias("average_processing_time_ms"),
            rounded(ratio(c("total_cost"), total), 6).alias("cost_per_event_usd"),
        ).alias("performance_metrics"),
    )


# --- violations -------------------------------------------------------------
def violations(
    audit: DataFrame, start, end, product_id=None, user_id=None, cap: int | None = None
) -> DataFrame:
    """Denied policy decisions of the period."""
    rows = _filtered(
        in_period(_of_type(audit, "POLICY_DECISION", cap), start, end), product_id, user_id
    )
    return rows.filter(_denied()).select(
        c("audit_id").alias("event_id"),
        "timestamp",
        "review_id",
        "user_id",
        "product_id",
        F.coalesce(
            c("policy_decision.policy_violations"), F.array().cast("array<string>")
        ).alias("violation_reasons"),
        *[
            F.coalesce(c("analysis_results")[f"{a}_score"], F.lit(0.0)).alias(a)
            for a in ASPECTS
        ],
    )


def violation_breakdown(rows: DataFrame) -> DataFrame:
    """Count per reason."""
    return (
        rows.select(F.explode("violation_reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def top_violation_types(breakdown: DataFrame, n: int = TOP_TYPES) -> DataFrame:
    return breakdown.orderBy(F.desc("violations"), F.asc("reason")).limit(n)


def violations_detail(rows: DataFrame, n: int = DETAIL_ROWS) -> DataFrame:
    """The newest violations."""
    return rows.orderBy(F.desc("timestamp"), F.asc("event_id")).limit(n)


def violations_summary(rows: DataFrame) -> DataFrame:
    """One row: violations, distinct products and users, distinct reasons."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_violations"),
        F.count_distinct("product_id").alias("unique_products_affected"),
        F.count_distinct("user_id").alias("unique_users_affected"),
    )
    kinds = violation_breakdown(rows).agg(
        F.count(F.lit(1)).alias("violation_types_count")
    )
    return _one_row(totals, kinds)


def _one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames on one row."""
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united.agg(
        *[F.first(x, ignorenulls=True).alias(x) for x in united.columns]
    )


def violations_report(rows: DataFrame) -> DataFrame:
    """All parts of the report; the denied rows, few and narrow, are written once and
    every part reads them there."""
    rows = materialise(rows, "violations")
    breakdown = violation_breakdown(rows)
    reasons = F.struct("reason", "violations")
    # Reason codes form a short fixed vocabulary, detail rows are limited.
    histogram = breakdown.agg(
        F.map_from_entries(F.sort_array(F.collect_list(reasons))).alias(
            "violation_breakdown"
        )
    )
    top = (
        top_violation_types(breakdown)
        .agg(
            F.collect_list(
                F.struct((-c("violations")).alias("_order"), "reason", "violations")
            ).alias("_top")
        )
        .select(
            F.transform(
                F.sort_array("_top"),
                lambda x: F.struct(
                    x["reason"].alias("reason"), x["violations"].alias("violations")
                ),
            ).alias("top_violation_types")
        )
    )
    detail = violations_detail(rows).select(
        (-F.unix_micros("timestamp")).alias("_order"),
        "event_id",
        isoformat(c("timestamp")).alias("timestamp"),
        "review_id",
        "user_id",
        "product_id",
        "violation_reasons",
        F.struct(*ASPECTS).alias("analysis_scores"),
    )
    listing = detail.agg(
        F.sort_array(F.collect_list(F.struct(*detail.columns))).alias("_rows")
    ).select(
        F.transform(
            "_rows", lambda x: F.struct(*[x[n].alias(n) for n in detail.columns[1:]])
        ).alias("violations")
    )
    summary = violations_summary(rows)
    summary = summary.select(F.struct("*").alias("summary"))
    return _one_row(summary, histogram, listing, top)


# --- processing statistics --------------------------------------------------
def _stats(name: str) -> Column:
    """{min, max, avg, count}, zeros when there was nothing to measure."""
    n = c(f"{name}_n")
    return F.struct(
        F.coalesce(c(f"{name}_min"), F.lit(0.0)).alias("min"),
        F.coalesce(c(f"{name}_max"), F.lit(0.0)).alias("max"),
        ratio(c(f"{name}_sum"), n).alias("avg"),
        F.coalesce(n, F.lit(0)).alias("count"),
    )


def processing_stats(
    audit: DataFrame,
    start,
    end,
    product_id=None,
    user_id=None,
    apply_filters: bool = False,
    cap: int | None = None,
) -> DataFrame:
    """Durations and scores of ANALYSIS events, cost and type counts of all.

    One scan: all types are aggregated once and the ANALYSIS measures are
    conditional. Only ``cap`` needs its own, limited read. The product and user
    filters are accepted and ignored unless ``apply_filters`` is set.
    """
    events = in_period(audit, start, end)
    if apply_filters:
        events = _filtered(events, product_id, user_id)
    shared = [
        F.count(F.lit(1)).alias("events"),
        exact_sum(c("model_metadata.cost_usd")).alias("cost"),
    ]
    key = F.coalesce("event_type", F.lit("UNKNOWN")).alias("event_type")
    analysis = analysis_measures(c("event_type") == "ANALYSIS") if cap is None else []
    by_type = events.groupBy(key).agg(*shared, *analysis)
    if cap is None:
        return processing_of(by_type, start, end)
    newest = in_period(_of_type(audit, "ANALYSIS", cap), start, end)
    if apply_filters:
        newest = _filtered(newest, product_id, user_id)
    row = _one_row(by_type.agg(*_merged_types()), newest.agg(*analysis_measures(F.lit(True))))
    return _processing_report(row, start, end)


def analysis_measures(condition: Column) -> list[Column]:
    """Least, largest, sum and number of durations and scores where the condition holds."""
    values = {
        "time": F.when(
            c("processing_duration_ms") > 0, c("processing_duration_ms").cast("double")
        )
    }
    for a in ASPECTS:
        values[a] = F.when(
            c("analysis_results").isNotNull(),
            F.coalesce(c("analysis_results")[f"{a}_score"], F.lit(0.0)),
        )
    out = [F.count_if(condition).alias("analysed")]
    for name, value in values.items():
        kept = F.when(condition, value)
        out += [
            F.min(kept).alias(f"{name}_min"),
            F.max(kept).alias(f"{name}_max"),
            exact_sum(kept).alias(f"{name}_sum"),
            F.count(kept).alias(f"{name}_n"),
        ]
    return out


def merged_analysis() -> list[Column]:
    """The measures of several groups as those of one."""
    out = [F.coalesce(F.sum("analysed"), F.lit(0)).alias("analysed")]
    for name in ("time", *ASPECTS):
        out += [
            F.min(f"{name}_min").alias(f"{name}_min"),
            F.max(f"{name}_max").alias(f"{name}_max"),
            F.sum(f"{name}_sum").alias(f"{name}_sum"),
            F.sum(f"{name}_n").alias(f"{name}_n"),
        ]
    return out


def _merged_types() -> list[Column]:
    return [
        F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_cost"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("event_type", "events")))
        ).alias("event_type_distribution"),
    ]


def processing_of(by_type: DataFrame, start, end) -> DataFrame:
    """The processing report from measures per event type."""
    return _processing_report(by_type.agg(*_merged_types(), *merged_analysis()), start, end)


def _processing_report(row: DataFrame, start, end) -> DataFrame:
    days = (parse_date(end) - parse_date(start)).days
    return row.select(
        F.struct(
            c("analysed").alias("total_events_processed"),
            F.lit(days).alias("date_range_days"),
            (c("analysed").cast("double") / F.lit(float(max(days, 1)))).alias(
                "events_per_day"
            ),
        ).alias("summary"),
        F.struct(
            _stats("time").alias("processing_times_ms"),
            c("total_cost").alias("total_cost_usd"),
            (c("total_cost") / F.greatest(c("analysed"), F.lit(1))).alias(
                "average_cost_per_event"
            ),
        ).alias("processing_performance"),
        F.struct(*[_stats(a).alias(f"{a}_scores") for a in ASPECTS]).alias(
            "content_analysis_scores"
        ),
        "event_type_distribution",
    )


# --- dispatch ---------------------------------------------------------------
#: Reports that measures per event type are enough for.
FROM_SUMS = {
    "compliance_summary": lambda sums, start, end: compliance_summary(statistics_of(sums)),
    "processing_stats": lambda sums, start, end: processing_of(sums, start, end),
}


def build_report(
    audit: DataFrame,
    report_type: str = "compliance_summary",
    start_date=None,
    end_date=None,
    product_id: str | None = None,
    user_id: str | None = None,
    *,
    report_id: str | None = None,
    generated_at: datetime | None = None,
    apply_filters: bool = False,
    cap: int | None = None,
    sums: DataFrame | None = None,
    function_name: str = "unknown",
    request_id: str = "unknown",
) -> DataFrame:
    """One row: the report as JSON text with its size and record count.

    ``sums`` are the period's measures per event type, as ``rollup.type_sums`` reads them;
    reports over whole events that need no more are then made from them alone.
    """
    if not start_date or not end_date:
        raise ValueError("start_date and end_date are required")
    start, end = parse_date(start_date), parse_date(end_date)
    narrowed = apply_filters and (product_id or user_id)
    if sums is not None and not narrowed and cap is None and report_type in FROM_SUMS:
        body = FROM_SUMS[report_type](sums, start, end)
    elif report_type == "compliance_summary":
        events = _filtered(audit, product_id, user_id) if apply_filters else audit
        body = compliance_summary(audit_statistics(events, start, end))
    elif report_type == "policy_violations":
        body = violations_report(violations(audit, start, end, product_id, user_id, cap))
    elif report_type == "processing_stats":
        body = processing_stats(audit, start, end, product_id, user_id, apply_filters, cap)
    else:
        raise ValueError(f"Unknown report type: {report_type}")
    moment = (
        F.current_timestamp() if generated_at is None else _time(parse_date(generated_at))
    )
    metadata = F.struct(
        (F.uuid() if report_id is None else F.lit(report_id)).alias("report_id"),
        F.lit(report_type).alias("report_type"),
        isoformat(moment).alias("generated_at"),
        F.struct(
            F.lit(start.isoformat()).alias("start_date"),
            F.lit(end.isoformat()).alias("end_date"),
        ).alias("period"),
        F.struct(
            F.lit(product_id).cast("string").alias("product_id"),
            F.lit(user_id).cast("string").alias("user_id"),
        ).alias("filters"),
        F.struct(
            F.lit(function_name).alias("function_name"),
            F.lit(request_id).alias("request_id"),
        ).alias("generator"),
    )
    # Only the compliance report has a record total; the others report 0.
    total = (
        c("summary.total_records") if report_type == "compliance_summary" else F.lit(0)
    )
    data = body.columns
    return (
        body.withColumn("report_metadata", metadata)
        .withColumn(
            "report_json",
            F.to_json(
                F.struct(*data, "report_metadata"),
                {"pretty": "true", "ignoreNullFields": "false"},
            ),
        )
        .select(
            c("report_metadata.report_id").alias("report_id"),
            c("report_metadata.report_type").alias("report_type"),
            "report_json",
            F.octet_length("report_json").alias("report_size_bytes"),
            total.cast("long").alias("records_processed"),
        )
    )
