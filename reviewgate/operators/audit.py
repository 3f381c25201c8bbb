"""Audit records: construction, event type by branch, retention, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.functions.collections import no_strings
from reviewgate.schemas import AUDIT_EVENT

c = F.col


def branch_event_type(decision: Column) -> Column:
    """Approved reviews are logged as ANALYSIS, all others as POLICY_DECISION."""
    return F.when(decision.eqNullSafe(F.lit(K.ALLOW)), "ANALYSIS").otherwise(
        "POLICY_DECISION"
    )


def stored_decision(policy_result: Column) -> Column:
    """The evaluated decision in stored form, carrying both shapes readers use."""
    decision = policy_result["decision"]
    return F.when(
        policy_result.isNotNull(),
        F.struct(
            (decision == K.ALLOW).alias("approved"),
            F.when(decision == K.ALLOW, no_strings())
            .otherwise(policy_result["reasons"])
            .alias("policy_violations"),
            policy_result["explanation"].alias("decision_rationale"),
            F.lit(K.POLICY_VERSION).alias("policy_version"),
            no_strings().alias("evaluated_rules"),
            decision.alias("decision"),
            policy_result["reasons"].alias("reasons"),
            policy_result["explanation"].alias("explanation"),
        ),
    )


def approved(policy_decision: Column) -> Column:
    """Whether a stored decision approved; unknown counts as approved."""
    return F.coalesce(
        policy_decision["approved"],
        policy_decision["decision"] == K.ALLOW,
        F.lit(True),
    )


def ttl_stamp(timestamp: Column, days: int, ttl: Column | None = None) -> Column:
    """Expiry in epoch seconds; a stamp already set is kept."""
    stamp = F.unix_timestamp(timestamp) + F.lit(days * 86400)
    return stamp if ttl is None else F.coalesce(ttl, stamp)


def audit_records(
    df: DataFrame,
    event_time: Column | None = None,
    request_id: Column | None = None,
    retention_days: int = K.LOG_RETENTION_DAYS,
    suffix_chars: int = 8,
) -> DataFrame:
    """Audit rows of decided reviews.

    ``event_time`` is the logging time (default: now). The id suffix is cut from
    the hex digest of ``request_id`` (default: review id), so a retried task
    writes the same id. Eight characters are the customary id; a table with
    billions of rows wants the full 32.
    """
    time = F.current_timestamp() if event_time is None else event_time
    request = c("review_id") if request_id is None else request_id
    columns = set(df.columns)

    def given(name: str, kind: str) -> Column:
        return c(name) if name in columns else F.lit(None).cast(kind)

    rows = df.withColumns({"_time": time, "_request": request})
    metadata = (
        c("model_metadata")
        if "model_metadata" in columns
        else F.lit(None).cast(AUDIT_EVENT["model_metadata"].dataType)
    )
    event_type = (
        F.coalesce("event_type", F.lit("UNKNOWN"))
        if "event_type" in columns
        else branch_event_type(c("policy_result.decision"))
    )
    out = rows.select(
        F.concat(
            F.lit("audit-"),
            F.date_format("_time", "yyyyMMdd-HHmmss"),
            F.lit("-"),
            F.left(F.md5(F.coalesce("_request", F.lit(""))), F.lit(suffix_chars)),
        ).alias("audit_id"),
        c("_time").alias("timestamp"),
        event_type.alias("event_type"),
        F.coalesce("review_id", F.lit("unknown")).alias("review_id"),
        F.coalesce("user_id", F.lit("unknown")).alias("user_id"),
        F.coalesce("product_id", F.lit("unknown")).alias("product_id"),
        F.coalesce("region", F.lit("us-east-1")).alias("region"),
        c("analysis").alias("analysis_results"),
        stored_decision(c("policy_result")).alias("policy_decision"),
        metadata.alias("model_metadata"),
        given("summary_data", "string").alias("summary_data"),
        given("error_details", "string").alias("error_details"),
        F.coalesce(given("processing_duration_ms", "int"), F.lit(0))
        .cast("int")
        .alias("processing_duration_ms"),
        given("memory_used_mb", "int").alias("memory_used_mb"),
        ttl_stamp(c("_time"), retention_days).alias("ttl"),
        F.to_date("_time").alias("event_date"),
    )
    return out


def expire_audit(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows whose expiry lies after ``now``, and rows that have none."""
    moment = F.current_timestamp() if now is None else now
    return df.filter(c("ttl").isNull() | (c("ttl") > F.unix_timestamp(moment)))
