"""Row validation. Each check adds an ``errors`` array; ``split`` routes on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate.constants import CATEGORIES, EVENT_TYPES, MODES, REGIONS
from reviewgate.functions.collections import listed
from reviewgate.functions.numbers import in_score_range
from reviewgate.functions.responses import whole_json
from reviewgate.functions.text import shorter_than, strip

c = F.col


def whole_number(col: Column) -> Column:
    """Text or number to int; NULL when it is not a whole number.

    A number with a fraction is cut to its whole part, a text with one is no whole number.
    """
    fractional = F.rlike(F.typeof(col), F.lit("^(double|float|decimal)"))
    return F.when(fractional, col.try_cast("int")).otherwise(col.cast("string").try_cast("int"))


def _outside(col: Column, low: int, high: int) -> Column:
    return ~F.coalesce(col.between(low, high), F.lit(False))


def _not_one_of(name: str, allowed: list[str]) -> Column:
    return c(name).isNotNull() & ~c(name).isin(allowed)


def validate_api(df: DataFrame) -> DataFrame:
    """The gateway's request rules: ids 1-100, content 10-5000 as sent, rating a
    whole number 1-5, enums only checked when present."""
    return df.withColumn(
        "errors",
        listed(
            (_outside(F.length("product_id"), 1, 100), "product_id"),
            (_outside(F.length("user_id"), 1, 100), "user_id"),
            (_outside(F.length("content"), 10, 5000), "content"),
            (_outside(whole_number(c("rating")), 1, 5), "rating"),
            (_not_one_of("region", REGIONS), "region"),
            (_not_one_of("product_category", CATEGORIES), "product_category"),
            (_not_one_of("compliance_mode", MODES), "compliance_mode"),
        ),
    )


def validate_model(df: DataFrame) -> DataFrame:
    """The stored review's rules; content is checked as given, then stripped."""
    blank = shorter_than(c("content"), 1)
    checked = df.withColumn(
        "errors",
        listed(
            (_outside(F.length("product_id"), 1, 2**31 - 1), "product_id"),
            (_outside(F.length("user_id"), 1, 2**31 - 1), "user_id"),
            (_outside(F.length("content"), 1, 5000) | blank, "content"),
            (_outside(whole_number(c("rating")), 1, 5), "rating"),
            (~F.coalesce(c("region").isin(REGIONS), F.lit(False)), "region"),
            (
                ~F.coalesce(c("product_category").isin(CATEGORIES), F.lit(False)),
                "product_category",
            ),
        ),
    )
    return checked.withColumn("content", strip(c("content")))


def validate_scores(df: DataFrame) -> DataFrame:
    """Scores must be present and inside 0-10."""
    return df.withColumn(
        "errors",
        listed(
            *[
                (~in_score_range(c(name)), name)
                for name in ("toxicity_score", "bias_score", "hallucination_score")
            ]
        ),
    )


def validate_summary(df: DataFrame) -> DataFrame:
    """Counts must not be negative and not both zero."""
    processed, excluded = c("reviews_processed"), c("reviews_excluded")
    return df.withColumn(
        "errors",
        listed(
            (F.coalesce(processed < 0, F.lit(True)), "reviews_processed"),
            (F.coalesce(excluded < 0, F.lit(True)), "reviews_excluded"),
            ((processed == 0) & (excluded == 0), "review_totals"),
            (_outside(F.length("product_id"), 1, 2**31 - 1), "product_id"),
            (_outside(F.length("summary_text"), 1, 2**31 - 1), "summary_text"),
        ),
    )


def validate_audit(df: DataFrame) -> DataFrame:
    """Ids present, event type and region known, duration not negative."""
    return df.withColumn(
        "errors",
        listed(
            (_outside(F.length("review_id"), 1, 2**31 - 1), "review_id"),
            (_outside(F.length("user_id"), 1, 2**31 - 1), "user_id"),
            (_outside(F.length("product_id"), 1, 2**31 - 1), "product_id"),
            (~F.coalesce(c("event_type").isin(EVENT_TYPES), F.lit(False)), "event_type"),
            (~F.coalesce(c("region").isin(REGIONS), F.lit(False)), "region"),
            (
                F.coalesce(c("processing_duration_ms"), F.lit(0)) < 0,
                "processing_duration_ms",
            ),
        ),
    )


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without ``errors``, rejected rows with it)."""
    return (
        df.filter(F.size("errors") == 0).drop("errors"),
        df.filter(F.size("errors") > 0),
    )


def input_defaults(df: DataFrame) -> DataFrame:
    """Defaults for absent fields; ``rating_error`` holds the text of a failed
    integer conversion, which outranks every later check."""
    given = c("rating").cast("string")
    number = whole_number(c("rating"))
    return df.withColumns(
        {
            "review_id": F.coalesce("review_id", F.lit("unknown")),
            "content": F.coalesce("content", F.lit("")),
            "product_category": F.coalesce("product_category", F.lit("other")),
            "rating_error": F.when(
                given.isNotNull() & number.isNull(),
                F.concat(
                    F.lit("invalid literal for int() with base 10: '"), given, F.lit("'")
                ),
            ),
            "rating": F.when(given.isNull(), F.lit(3)).otherwise(number),
        }
    )


def normalise_input(df: DataFrame) -> DataFrame:
    """Read wrapped requests: JSON text in ``body``, or a struct in ``input``.

    Adds ``error`` with the first broken rule; a good row has NULL there.
    """
    from reviewgate.schemas import SUBMISSION

    body = F.from_json("body", SUBMISSION)
    bad_json = c("body").isNotNull() & whole_json(c("body")).isNull()
    fields = SUBMISSION.fieldNames()
    merged = df.withColumns({"_body": body, "_bad_json": bad_json}).select(
        *[x for x in df.columns if x not in ("body", "input")],
        "_bad_json",
        *[F.coalesce(c("_body")[name], c("input")[name]).alias(name) for name in fields],
    )
    rating = whole_number(c("rating"))
    error = F.when(c("_bad_json"), F.lit("Invalid JSON in request body"))
    for name in ("review_id", "content", "product_id", "user_id"):
        error = error.when(c(name).isNull(), F.lit(f"Missing required field: {name}"))
    error = (
        error.when(shorter_than(c("content"), 1), "Review content cannot be empty")
        .when(
            F.length("content") > 5000,
            "Review content exceeds maximum length of 5000 characters",
        )
        .when(
            c("rating").isNotNull() & _outside(rating, 1, 5),
            "Rating must be between 1 and 5",
        )
    )
    return merged.withColumns(
        {
            "error": error,
            "rating": F.when(c("rating").isNull(), F.lit(3)).otherwise(rating),
            "region": F.coalesce("region", F.lit("us-east-1")),
            "product_category": F.coalesce("product_category", F.lit("other")),
        }
    ).drop("_bad_json")


def known_event_type(df: DataFrame) -> DataFrame:
    """Any event type outside the enum becomes UNKNOWN."""
    return df.withColumn(
        "event_type",
        F.when(c("event_type").isin(EVENT_TYPES), c("event_type")).otherwise("UNKNOWN"),
    )
