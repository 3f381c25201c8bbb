"""Routing on the decision, the response rows, and the fallback records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.functions.collections import same_text

c = F.col


def is_approved(policy_result: Column) -> Column:
    return policy_result["decision"].eqNullSafe(F.lit(K.ALLOW))


def route_approved(df: DataFrame) -> DataFrame:
    return df.filter(is_approved(c("policy_result")))


def route_rejected(df: DataFrame) -> DataFrame:
    """Everything that is not an explicit ALLOW, a missing decision included."""
    return df.filter(~is_approved(c("policy_result")))


def responses(df: DataFrame) -> DataFrame:
    """One response row per review.

    Both branches come out of the same projection: reading the input once per
    branch and uniting the branches would double the scan.
    """
    ok = is_approved(c("policy_result"))
    summary = c("summary") if "summary" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.lit(200).alias("status_code"),
        F.when(ok, "SUCCESS").otherwise("REJECTED").alias("result"),
        "review_id",
        "product_id",
        F.when(ok, "APPROVED").otherwise("DENIED").alias("policy_decision"),
        F.struct(
            *[c("analysis")[f"{a}_score"].alias(f"{a}_score") for a in K.ASPECTS]
        ).alias("analysis_summary"),
        c("policy_result.reasons").alias("policy_reasons"),
        F.when(ok, summary).alias("summary"),
        F.when(~ok, c("policy_result.explanation")).alias("rejection_explanation"),
        F.struct(
            "execution_id", "timestamp", F.lit(True).alias("audit_logged")
        ).alias("processing_metadata"),
    )


def error_fallbacks(
    df: DataFrame,
    analysis_failed: Column,
    policy_failed: Column,
    summary_failed: Column,
) -> DataFrame:
    """Replace the record of a failed stage: analysis fails to 10s, the policy
    to a denial, the summary to a fixed text with the review excluded."""
    fields = df.schema["policy_result"].dataType.fieldNames()
    literal = {
        "decision": F.lit(K.DENY),
        "reasons": F.array(F.lit(K.SYSTEM_ERROR)),
        "explanation": F.lit(K.POLICY_FAILED),
    }
    types = {f.name: f.dataType for f in df.schema["policy_result"].dataType}
    denial = F.struct(
        *[literal.get(f, F.lit(None).cast(types[f])).alias(f) for f in fields]
    )
    high_risk = F.struct(
        *[F.lit(10.0).alias(f"{a}_score") for a in K.ASPECTS],
        same_text(K.ANALYSIS_FAILED, K.ASPECTS).alias("explanations"),
        F.lit(None).cast("map<string,double>").alias("confidence_scores"),
    )
    metadata = F.struct(
        F.lit(1).alias("reviews_processed"),
        F.lit(0).alias("reviews_included"),
        F.lit(1).alias("reviews_excluded"),
        F.array(F.lit(K.SYSTEM_ERROR)).alias("exclusion_reasons"),
    )
    return df.withColumns(
        {
            "analysis": F.when(analysis_failed, high_risk).otherwise(c("analysis")),
            "policy_result": F.when(policy_failed, denial).otherwise(c("policy_result")),
            "summary": F.when(summary_failed, K.SUMMARY_FAILED).otherwise(c("summary")),
            "summary_metadata": F.when(summary_failed, metadata),
            "error_type": F.when(analysis_failed, "ANALYSIS_FAILED"),
        }
    )
