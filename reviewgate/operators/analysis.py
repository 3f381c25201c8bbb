"""From model responses to analysis records and risk.

``audit_response`` is the strict reader used by moderation: every failure has a
fixed high or moderate score, so a row never passes because its scoring failed.
``comprehensive_analysis`` is the tolerant three-prompt reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.functions import responses as R
from reviewgate.functions.collections import fill_keys, listed, no_strings, same_text
from reviewgate.functions.numbers import clamp, in_score_range
from reviewgate.functions.text import fixed, shorter_than

c = F.col
SCORES = [f"{aspect}_score" for aspect in K.ASPECTS]


def _system_error(message: Column) -> Column:
    return F.concat(F.lit("System error: "), message)


def audit_response(
    df: DataFrame, response: str = "raw_response", call_error: str | None = None
) -> DataFrame:
    """Content gate and strict response reading in one projection.

    Needs ``content`` and ``rating_error`` (see ``input_defaults``). Adds
    ``status_code``, ``error`` and ``analysis``. Order of precedence: rating not
    a number (10s), content under 5 characters (10s, status 400), failed call
    (8s), unparsable response (5s), response that is no object or lacks a score
    (10s), then each score on its own: no number or outside 0-10 becomes 5.
    """
    failed = c(call_error) if call_error else F.lit(None).cast("string")
    rows = df.withColumns(
        {
            "_short": shorter_than(c("content"), 5),
            "_call_error": failed,
            "_doc": R.strict_json(c(response)),
        }
    ).withColumns({f"_{s}": R.member_json(c("_doc"), s) for s in SCORES})
    # Taken out once here: inside a CASE branch it would be evaluated per use.
    rows = rows.withColumns({f"_{s}_value": R.number(c(f"_{s}")) for s in SCORES})

    absent = F.coalesce(*[F.when(c(f"_{s}").isNull(), F.lit(f"'{s}'")) for s in SCORES])
    root = F.to_json(c("_doc"))
    no_get = F.when(
        absent.isNotNull() & ~R.is_object(root),
        F.concat(F.lit("'"), R.python_type(root), F.lit("' object has no attribute 'get'")),
    )
    unread = ~c("_short") & c("_call_error").isNull() & c("_doc").isNotNull()
    rows = rows.withColumn(
        "_system",
        F.coalesce("rating_error", F.when(unread, F.coalesce(no_get, absent))),
    )

    def score(name: str) -> Column:
        value = c(f"_{name}_value")
        numeric = R.is_number(c(f"_{name}"))
        return (
            F.when(c("_system").isNotNull() | c("_short"), 10.0)
            .when(c("_call_error").isNotNull(), 8.0)
            .when(c("_doc").isNull(), 5.0)
            .when(numeric & in_score_range(value), value)
            .otherwise(5.0)
        )

    text = (
        F.when(c("_system").isNotNull(), _system_error(c("_system")))
        .when(c("_short"), K.INVALID_CONTENT)
        .when(
            c("_call_error").isNotNull(),
            F.concat(
                F.lit(K.CALL_FAILED_PREFIX), c("_call_error"), F.lit(K.CALL_FAILED_SUFFIX)
            ),
        )
        .when(c("_doc").isNull(), K.PARSE_FAILED)
    )
    rows = rows.withColumns(
        {
            "_text": text,
            "status_code": F.when(c("_system").isNotNull(), 500)
            .when(c("_short"), 400)
            .otherwise(200),
            "error": F.when(c("_system").isNotNull(), c("_system")).when(
                c("_short"), K.INVALID_CONTENT_ERROR
            ),
        }
    )
    given = F.try_variant_get(c("_doc"), "$.explanations", "map<string,string>")
    analysis = F.struct(
        *[score(s).alias(s) for s in SCORES],
        F.when(c("_text").isNotNull(), same_text(c("_text"), K.ASPECTS))
        .otherwise(given)
        .alias("explanations"),
        F.lit(None).cast("map<string,double>").alias("confidence_scores"),
    )
    return rows.withColumn("analysis", analysis).drop(
        "_short",
        "_call_error",
        "_doc",
        "_system",
        "_text",
        *[f"_{s}{part}" for s in SCORES for part in ("", "_value")],
    )


def parse_tolerant(df: DataFrame, response: str = "raw_response") -> DataFrame:
    """Add ``parsed`` (variant) or, when nothing parses, ``error`` and ``raw_content``."""
    rows = df.withColumn("parsed", R.tolerant_json(c(response)))
    lost = c("parsed").isNull()
    return rows.withColumns(
        {
            "error": F.when(lost, K.UNPARSED_RESPONSE),
            "raw_content": F.when(lost, c(response)),
        }
    )


def _float_error(json: Column) -> Column:
    """Text of the conversion error of a member that is no number."""
    text = F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>")[0]
    return F.when(
        json.startswith('"'),
        F.concat(F.lit("could not convert string to float: '"), text, F.lit("'")),
    ).otherwise(
        F.concat(
            F.lit("float() argument must be a string or a real number, not '"),
            R.python_type(json),
            F.lit("'"),
        )
    )


LIST_FIELDS = {
    "toxicity": ["detected_issues"],
    "bias": ["bias_types", "problematic_phrases"],
    "hallucination": ["questionable_claims", "realistic_claims"],
}


def _with_aspect(rows: DataFrame, aspect: str, call_error: Column, limit: float) -> DataFrame:
    """Add the aspect's result struct and ``_{aspect}_error`` (NULL when read).

    Members are taken out of the document once, in a projection of their own,
    so that no later expression repeats the path lookup; the document is only
    looked at again on the rare rows where a conversion failed.
    """
    key = f"{aspect}_score"
    rows = rows.withColumn("_doc", R.tolerant_json(c(f"{aspect}_response")))
    rows = rows.withColumns(
        {
            "_score": R.member_json(c("_doc"), key),
            "_sure": R.member_json(c("_doc"), "confidence"),
            "_why": R.member(c("_doc"), "explanation"),
        }
    )
    rows = rows.withColumns(
        {"_score_value": R.number(c("_score")), "_sure_value": R.number(c("_sure"))}
    )
    bare = c("_score").isNull() & c("_sure").isNull() & c("_why").isNull()
    rows = rows.withColumns(
        {
            "_root": F.when(bare & c("_doc").isNotNull(), F.to_json(c("_doc"))),
            "_bad": F.when(c("_score").isNotNull() & c("_score_value").isNull(), c("_score"))
            .when(c("_sure").isNotNull() & c("_sure_value").isNull(), c("_sure")),
            "_clamped": clamp(c("_score_value")),
        }
    )
    no_object = c("_root").isNotNull() & ~R.is_object(c("_root"))
    unexpected = F.when(
        no_object,
        F.concat(
            F.lit("'"),
            R.python_type(c("_root")),
            F.lit("' object does not support item assignment"),
        ),
    ).when(c("_bad").isNotNull(), _float_error(c("_bad")))
    error = F.when(
        call_error.isNotNull(),
        F.concat(F.lit(f"Failed to analyze {aspect}: "), call_error),
    ).otherwise(F.concat(F.lit(f"Unexpected error in {aspect} analysis: "), unexpected))
    result = F.struct(
        c("_clamped").alias(key),
        F.coalesce(R.as_text(c("_why")), F.lit(K.NO_EXPLANATION)).alias("explanation"),
        F.coalesce("_sure_value", F.lit(0.5)).alias("confidence"),
        *[
            F.coalesce(R.as_strings(R.member(c("_doc"), name)), no_strings()).alias(name)
            for name in LIST_FIELDS[aspect]
        ],
        (c("_clamped") > F.lit(limit)).alias("threshold_exceeded"),
    )
    return rows.withColumns({aspect: result, f"_{aspect}_error": error}).drop(
        "_doc", "_score", "_sure", "_why", "_score_value", "_sure_value",
        "_root", "_bad", "_clamped",
    )


def comprehensive_analysis(
    df: DataFrame,
    thresholds: dict[str, float] | None = None,
    call_errors: dict[str, str] | None = None,
) -> DataFrame:
    """Read the three aspect responses of a row and combine them.

    Needs ``toxicity_response``, ``bias_response``, ``hallucination_response``.
    Adds ``toxicity``, ``bias``, ``hallucination`` (per-aspect structs),
    ``analysis`` and ``analysis_error``; a row with an error has no analysis.
    """
    limits = thresholds or K.ANALYZER_THRESHOLDS
    call_errors = call_errors or {}
    rows = df
    for a in K.ASPECTS:
        failed = c(call_errors[a]) if a in call_errors else F.lit(None).cast("string")
        rows = _with_aspect(rows, a, failed, limits[a])
    rows = rows.withColumn(
        "analysis_error", F.coalesce(*[f"_{a}_error" for a in K.ASPECTS])
    )
    combined = F.struct(
        *[c(a)[f"{a}_score"].alias(f"{a}_score") for a in K.ASPECTS],
        F.create_map(
            *[x for a in K.ASPECTS for x in (F.lit(a), c(a)["explanation"])]
        ).alias("explanations"),
        F.create_map(
            *[x for a in K.ASPECTS for x in (F.lit(a), c(a)["confidence"])]
        ).alias("confidence_scores"),
    )
    return rows.withColumn(
        "analysis", F.when(c("analysis_error").isNull(), combined)
    ).drop(*[f"_{a}_error" for a in K.ASPECTS])


def batch_analysis(df: DataFrame, **options) -> DataFrame:
    """As ``comprehensive_analysis``; a failed row gets zero scores and its error."""
    rows = comprehensive_analysis(df, **options)
    failed = F.struct(
        *[F.lit(0.0).alias(s) for s in SCORES],
        same_text(F.concat(F.lit("Analysis failed: "), c("analysis_error")), K.ASPECTS).alias(
            "explanations"
        ),
        F.lit(None).cast("map<string,double>").alias("confidence_scores"),
    )
    return rows.withColumn("analysis", F.coalesce(c("analysis"), failed))


def fill_explanations(col: Column) -> Column:
    return fill_keys(col, K.ASPECTS, K.NO_EXPLANATION)


def update_thresholds(
    current: dict[str, float] | None = None, **changes: float | None
) -> dict[str, float]:
    """Analyser thresholds after a change; values are clamped to 0-10."""
    limits = dict(current or K.ANALYZER_THRESHOLDS)
    for aspect, value in changes.items():
        if value is not None:
            limits[aspect] = float(max(0, min(10, value)))
    return limits


def risk_summary(
    df: DataFrame, thresholds: dict[str, float] | None = None, analysis: str = "analysis"
) -> DataFrame:
    """Add ``risk`` struct: level, max score, violations, should_approve, and the
    scores and confidences it was taken from."""
    limits = thresholds or K.ANALYZER_THRESHOLDS
    scores = {a: c(analysis)[f"{a}_score"] for a in K.ASPECTS}
    top = F.greatest(*scores.values())
    violations = listed(
        *[
            (
                scores[a] > limits[a],
                F.concat(F.lit(f"{a} ("), fixed(scores[a], 1), F.lit(f" > {limits[a]})")),
            )
            for a in K.ASPECTS
        ]
    )
    nothing = F.create_map().cast("map<string,double>")
    known = "confidence_scores" in df.schema[analysis].dataType.fieldNames()
    confidence = c(analysis)["confidence_scores"] if known else nothing
    rows = df.withColumns({"_top": top, "_violations": violations})
    risk = F.struct(
        F.when(c("_top") >= 8, "HIGH")
        .when(c("_top") >= 5, "MEDIUM")
        .when(c("_top") >= 3, "LOW")
        .otherwise("MINIMAL")
        .alias("risk_level"),
        c("_top").alias("max_score"),
        c("_violations").alias("threshold_violations"),
        (F.size("_violations") == 0).alias("should_approve"),
        F.struct(*[s.alias(a) for a, s in scores.items()]).alias("scores"),
        F.coalesce(confidence, nothing).alias("confidence_scores"),
    )
    return rows.withColumn("risk", F.when(c(analysis).isNotNull(), risk)).drop(
        "_top", "_violations"
    )


def analyze_reviews(
    df: DataFrame, thresholds: dict[str, float] | None = None, **options
) -> DataFrame:
    """Analyse, then note violations in ``processing_errors``; the status stays."""
    rows = risk_summary(
        comprehensive_analysis(df, thresholds=thresholds, **options), thresholds
    )
    note = F.when(
        c("analysis_error").isNotNull(),
        F.array(F.concat(F.lit("Analysis failed: "), c("analysis_error"))),
    ).when(
        ~c("risk.should_approve"),
        F.array(
            F.concat(
                F.lit("Policy violations: "),
                F.array_join(c("risk.threshold_violations"), ", "),
            )
        ),
    )
    return rows.withColumn(
        "processing_errors", F.coalesce(note, c("processing_errors"))
    )


def analysis_response(
    df: DataFrame, thresholds: dict[str, float] | None = None
) -> DataFrame:
    """Response row of the analyser: scores, risk, limits, errors when present."""
    limits = thresholds or K.ANALYZER_THRESHOLDS
    return df.select(
        F.lit(True).alias("success"),
        "review_id",
        "status",
        c("processing_time_ms"),
        "analysis",
        c("risk").alias("summary"),
        F.struct(
            *[F.lit(limits[a]).alias(f"{a}_threshold") for a in K.ASPECTS]
        ).alias("thresholds"),
        F.when(F.size("processing_errors") > 0, c("processing_errors")).alias("errors"),
    )
