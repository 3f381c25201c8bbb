"""Stored forms: reviews, summaries and audit events as items, search documents,
JSON and decimal normalisation. An absent optional field is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.constants import MODEL_RETENTION_DAYS
from reviewgate.functions.collections import blank_to_null, empty_to_null
from reviewgate.functions.text import isoformat, parse_iso
from reviewgate.operators.audit import ttl_stamp

c = F.col
EXACT_NUMBER = T.DecimalType(38, 18)
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def review_to_item(df: DataFrame) -> DataFrame:
    """Review rows in stored form: ISO time, language filled, empties dropped."""
    return df.select(
        "review_id",
        "product_id",
        "user_id",
        "content",
        "rating",
        isoformat(c("timestamp")).alias("timestamp"),
        "region",
        "product_category",
        "status",
        empty_to_null(c("processing_errors")).alias("processing_errors"),
        blank_to_null(c("source_ip")).alias("source_ip"),
        blank_to_null(c("user_agent")).alias("user_agent"),
        F.coalesce(blank_to_null(c("language")), F.lit("en")).alias("language"),
        *[x for x in ("analysis_result", "policy_decision") if x in df.columns],
    )


def item_to_review(df: DataFrame) -> DataFrame:
    """The inverse; ``item_errors`` names the fields outside their enum."""
    from reviewgate import constants as K
    from reviewgate.functions.collections import listed, no_strings

    def outside(name: str, allowed: list[str]) -> Column:
        return ~F.coalesce(c(name).isin(allowed), F.lit(False))

    return df.withColumns(
        {
            "timestamp": parse_iso(c("timestamp")),
            "language": F.coalesce("language", F.lit("en")),
            "processing_errors": F.coalesce("processing_errors", no_strings()),
            "item_errors": listed(
                (outside("region", K.REGIONS), "region"),
                (outside("product_category", K.CATEGORIES), "product_category"),
                (outside("status", K.STATUSES), "status"),
            ),
        }
    )


def summary_to_item(df: DataFrame) -> DataFrame:
    """Summary rows in stored form; a score of 0.0 is kept, an absent one is not."""
    optional = [
        x
        for x in ("summary_quality_score", "factual_accuracy_score", "model_metadata")
        if x in df.columns
    ]
    return df.select(
        "summary_id",
        "product_id",
        "summary_text",
        "reviews_processed",
        "reviews_excluded",
        "exclusion_reasons",
        isoformat(c("generated_at")).alias("generated_at"),
        "policy_constraints",
        *optional,
    )


def item_to_summary(df: DataFrame) -> DataFrame:
    from reviewgate.functions.collections import no_strings

    scores = {
        x: c(x).cast("double")
        for x in ("summary_quality_score", "factual_accuracy_score")
        if x in df.columns
    }
    return df.withColumns(
        {
            "reviews_processed": c("reviews_processed").cast("long"),
            "reviews_excluded": c("reviews_excluded").cast("long"),
            "exclusion_reasons": F.coalesce("exclusion_reasons", no_strings()),
            "generated_at": parse_iso(c("generated_at")),
            **scores,
        }
    )


def audit_to_item(df: DataFrame) -> DataFrame:
    """Audit events in stored form; a memory figure of 0 is dropped."""
    return df.withColumns(
        {
            "timestamp": isoformat(c("timestamp")),
            "memory_used_mb": F.nullif("memory_used_mb", F.lit(0)),
        }
    )


def item_to_audit(df: DataFrame) -> DataFrame:
    """The inverse; an absent duration is 0, an absent expiry is set."""
    return df.withColumns(
        {
            "timestamp": parse_iso(c("timestamp")),
            "processing_duration_ms": F.coalesce("processing_duration_ms", F.lit(0)),
            "ttl": ttl_stamp(parse_iso(c("timestamp")), MODEL_RETENTION_DAYS, c("ttl")),
        }
    )


def search_document(df: DataFrame) -> DataFrame:
    """Flat projection of an audit event for a search index."""
    return df.select(
        isoformat(c("timestamp")).alias("@timestamp"),
        "audit_id",
        "review_id",
        "event_type",
        "user_id",
        "product_id",
        "region",
        "processing_duration_ms",
        *[
            c("analysis_results")[x].alias(x)
            for x in ("toxicity_score", "bias_score", "hallucination_score")
        ],
        c("policy_decision.approved").alias("policy_approved"),
        F.when(
            c("policy_decision").isNotNull(), F.size("policy_decision.policy_violations")
        ).alias("policy_violations_count"),
        c("policy_decision.policy_version").alias("policy_version"),
        c("model_metadata.model_id").alias("model_id"),
        c("model_metadata.prompt_version").alias("prompt_version"),
        F.when(c("model_metadata.cost_usd") != 0, c("model_metadata.cost_usd")).alias(
            "cost_usd"
        ),
        F.nullif("memory_used_mb", F.lit(0)).alias("memory_used_mb"),
    )


def to_json_text(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), JSON_TIMES).alias(name))


def from_json_text(
    df: DataFrame, schema: T.StructType, name: str = "json"
) -> DataFrame:
    return df.select(F.from_json(name, schema).alias("_row")).select("_row.*")


def _convert(col: Column, dtype: T.DataType, source, target) -> Column:
    """Recursively cast every ``source`` number to ``target``."""
    if isinstance(dtype, source):
        return col.cast(target)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _convert(x, dtype.elementType, source, target))
    if isinstance(dtype, T.MapType):
        return F.transform_values(
            col, lambda _, v: _convert(v, dtype.valueType, source, target)
        )
    if isinstance(dtype, T.StructType):
        return F.when(
            col.isNotNull(),
            F.struct(
                *[
                    _convert(col[f.name], f.dataType, source, target).alias(f.name)
                    for f in dtype
                ]
            ),
        )
    return col


def _has(dtype: T.DataType, source) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has(dtype.elementType, source)
    if isinstance(dtype, T.MapType):
        return _has(dtype.valueType, source)
    if isinstance(dtype, T.StructType):
        return any(_has(f.dataType, source) for f in dtype)
    return isinstance(dtype, source)


def _normalise(df: DataFrame, source, target) -> DataFrame:
    return df.select(
        *[
            _convert(c(f.name), f.dataType, source, target).alias(f.name)
            if _has(f.dataType, source)
            else c(f.name)
            for f in df.schema
        ]
    )


def floats_to_decimals(df: DataFrame) -> DataFrame:
    """Every float, at any depth, as an exact decimal of its printed value."""
    return _normalise(df, (T.DoubleType, T.FloatType), EXACT_NUMBER)


def decimals_to_floats(df: DataFrame) -> DataFrame:
    return _normalise(df, T.DecimalType, T.DoubleType())


