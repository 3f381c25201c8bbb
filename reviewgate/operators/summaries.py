"""Per-product summaries: statistics, prompts, response reading, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reviewgate import constants as K
from reviewgate.functions import responses as R
from reviewgate.functions.collections import listed
from reviewgate.functions.numbers import python_float
from reviewgate.functions.text import fixed
from reviewgate.operators.lookups import top_n_per_key
from reviewgate.operators.prompts import product_prompt

c = F.col
PROMPT_REVIEWS = 10
#: Characters of reviews in one prompt of a summary within limits.
PART_CHARS = 100_000


def _passed() -> Column:
    return F.coalesce(c("analysis_passed"), F.lit(True))


def _rating() -> Column:
    """The rating as a number; 3 when absent, NULL when it is no number."""
    return F.when(c("rating").isNull(), 3.0).otherwise(
        python_float(c("rating").cast("string"))
    )


def review_line(df: DataFrame) -> Column:
    """A review's line in a prompt. A rating that arrived as text shows as a
    decimal number, a whole number as it is."""
    text = isinstance(df.schema["rating"].dataType, StringType)
    number = _rating() if text else c("rating")
    return F.concat(
        F.lit("Rating: "),
        F.coalesce(number.cast("string"), F.lit("3")),
        F.lit("/5 - "),
        F.coalesce("content", F.lit("")),
    )


def product_stats(reviews: DataFrame) -> DataFrame:
    """Counts and mean rating per product; one partial aggregate per task."""
    return reviews.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("reviews_processed"),
        F.count_if(_passed()).alias("reviews_included"),
        F.count_if(~_passed()).alias("reviews_excluded"),
        F.coalesce(F.avg(F.when(_passed(), _rating())), F.lit(0.0)).alias(
            "average_rating"
        ),
        F.count_if(_passed() & _rating().isNull()).alias("unreadable_ratings"),
    )


def rejected_products(stats: DataFrame) -> DataFrame:
    """Fixed record for products none of whose reviews passed."""
    return stats.filter(c("reviews_included") == 0).select(
        "product_id",
        F.lit(K.ALL_REJECTED_TEXT).alias("summary"),
        "reviews_processed",
        "reviews_included",
        "reviews_excluded",
        F.lit(0.0).alias("average_rating"),
        F.lit("neutral").alias("sentiment"),
        F.lit(0.0).alias("confidence"),
        F.array().cast("array<string>").alias("key_themes"),
        F.array(F.lit(K.ALL_REJECTED_REASON)).alias("exclusion_reasons"),
    )


def review_lines(
    reviews: DataFrame, n: int = PROMPT_REVIEWS, hot: DataFrame | None = None
) -> DataFrame:
    """Text of the first ``n`` passed reviews per product, oldest first.

    The rows are cut to ``n`` per product before they are collected, so no group
    is ever larger than ``n``. ``hot`` lists products with very many reviews
    (see ``hot_keys``); the texts of all others are then shuffled only once.
    """
    rows = reviews.filter(_passed()).select(
        "product_id",
        "timestamp",
        "review_id",
        review_line(reviews).alias("line"),
    )
    order = [F.asc("timestamp"), F.asc("review_id")]
    first = top_n_per_key(rows, ["product_id"], order, n, hot=hot)
    return (
        first.groupBy("product_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_lines"))
        .select("product_id", F.array_join("_lines.line", "\n").alias("reviews_text"))
    )


def review_parts(reviews: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """All passed reviews of every product, in parts of about ``part_chars`` characters.

    A review's part is a hash of its id, so a product with very many reviews becomes
    many parts and no group grows with it. Within a part the reviews stand oldest first.
    Columns: ``product_id, part, parts, reviews_content``.
    """
    rows = reviews.filter(_passed()).select(
        "product_id", "timestamp", "review_id", review_line(reviews).alias("line")
    )
    chars = F.sum(F.length("line") + 1)
    sizes = rows.groupBy("product_id").agg(F.ceil(chars / part_chars).alias("parts"))
    large = sizes.filter(c("parts") > 1).withColumnRenamed("product_id", "_product")
    parted = rows.join(large, c("product_id").eqNullSafe(c("_product")), "left")
    number = F.conv(F.left(F.md5("review_id"), F.lit(8)), 16, 10).cast("long")
    parted = parted.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    part = F.coalesce(F.pmod(number, c("parts")), F.lit(0).cast("long"))
    listed_rows = F.sort_array(F.collect_list(F.struct("timestamp", "review_id", "line")))
    return (
        parted.withColumn("part", part)
        .groupBy("product_id", "part", "parts")
        .agg(listed_rows.alias("_lines"))
        .select(
            "product_id",
            "part",
            "parts",
            F.array_join("_lines.line", "\n").alias("reviews_content"),
        )
    )


def merged_parts(summaries: DataFrame, fan_in: int) -> DataFrame:
    """The next level of a tree: ``fan_in`` neighbouring parts of a product as one.

    ``reviews_content`` lists the summaries that were read, each with the number of reviews
    behind it. ``calls`` tells whether there is anything to put together: a bundle of which
    one part or none was read keeps that part (``only``).
    """
    read = c("summary").isNotNull() & c("error").isNull() & c("call_error").isNull()
    line = F.concat(
        F.lit("Summary of "),
        F.coalesce("sources_used", F.lit(0)).cast("string"),
        F.lit(" reviews: "),
        F.regexp_replace("summary", r"\s+", " "),
    )
    part = F.struct(
        (~read).alias("unread"),
        "part",
        F.when(read, line).alias("line"),
        "summary",
        "confidence",
        "excluded_content",
        "error",
        "raw_content",
        "call_error",
    )
    above = F.ceil(c("parts") / fan_in).cast("long")
    bundles = summaries.groupBy(
        "product_id", F.floor(c("part") / fan_in).cast("long").alias("_part"), above.alias("_parts")
    ).agg(
        # At most fan_in parts meet.
        F.sort_array(F.collect_list(part)).alias("_read"),
        F.sum(F.when(read, c("sources_used"))).cast("int").alias("sources_below"),
        F.sum("n_parts").alias("n_parts"),
        F.sum("failed_parts").alias("failed_parts"),
        F.count_if(read).alias("_n"),
    )
    lines = F.filter("_read.line", lambda x: x.isNotNull())
    return bundles.select(
        "product_id",
        c("_part").alias("part"),
        c("_parts").alias("parts"),
        F.array_join(lines, "\n").alias("reviews_content"),
        "sources_below",
        "n_parts",
        "failed_parts",
        (c("_n") > 1).alias("calls"),
        F.element_at("_read", 1).alias("only"),
    )


def summary_prompts(reviews: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Statistics and summary prompt per product; the prompt is NULL when no
    review passed or a passed review's rating is no number."""
    rows = product_prompt(
        product_stats(reviews).join(review_lines(reviews, hot=hot), "product_id", "left")
    )
    return rows.withColumn("prompt", F.when(c("unreadable_ratings") == 0, c("prompt")))


def single_review_prompt(df: DataFrame, asked: Column) -> DataFrame:
    """Summary prompt over one review per row, where ``asked`` holds."""
    rows = df.withColumns(
        {
            "reviews_included": F.lit(1),
            "reviews_text": review_line(df),
            "average_rating": _rating(),
        }
    )
    prompt = F.when(asked & c("average_rating").isNotNull(), c("prompt"))
    return (
        product_prompt(rows)
        .withColumn("prompt", prompt)
        .drop("reviews_included", "reviews_text", "average_rating")
    )


def _read_number(value: Column) -> Column:
    return R.number(F.to_json(value))


def parse_summary(
    df: DataFrame, response: str = "summary_response", call_error: str | None = None
) -> DataFrame:
    """Read a summary response: adds ``summary``, ``sentiment``, ``confidence``,
    ``key_themes`` and ``status_code``."""
    failed = c(call_error) if call_error else F.lit(None).cast("string")
    rows = df.withColumns({"_failed": failed, "_doc": R.strict_json(c(response))})
    for key in ("summary", "sentiment", "confidence", "key_themes"):
        rows = rows.withColumn(f"_{key}", R.member(c("_doc"), key))
    lost = c("_doc").isNull()
    nothing = c("_summary").isNull() & c("_sentiment").isNull() & c("_confidence").isNull()
    broken = ~lost & nothing & ~R.is_object(F.to_json(c("_doc")))

    def pick(key, read, when_failed, when_lost, when_absent, when_broken):
        return (
            F.when(c("_failed").isNotNull(), when_failed)
            .when(lost, when_lost)
            .when(c("_broken"), when_broken)
            .when(c(f"_{key}").isNull(), when_absent)
            .otherwise(read(c(f"_{key}")))
        )

    def strings(values: list[str]) -> Column:
        return (
            F.array(*[F.lit(v) for v in values])
            if values
            else F.array().cast("array<string>")
        )

    rows = rows.withColumn("_broken", broken)
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return rows.withColumns(
        {
            "summary": pick(
                "summary",
                R.as_text,
                F.concat(F.lit(K.SUMMARY_CALL_FAILED_PREFIX), c("_failed")),
                F.lit(K.SUMMARY_PARSE_FAILED),
                F.lit(K.SUMMARY_DONE),
                F.lit(K.SUMMARY_SYSTEM_ERROR),
            ),
            "sentiment": pick(
                "sentiment", R.as_text, F.lit("mixed"), F.lit("mixed"), F.lit("mixed"), none_text
            ),
            "confidence": pick(
                "confidence", _read_number, F.lit(0.0), F.lit(0.5), F.lit(0.5), none_number
            ),
            "key_themes": pick(
                "key_themes",
                R.as_strings,
                strings(K.SUMMARY_CALL_FAILED_THEMES),
                strings(K.SUMMARY_PARSE_THEMES),
                strings([]),
                strings([]),
            ),
            "status_code": F.when(c("_failed").isNull() & c("_broken"), 500).otherwise(200),
        }
    ).drop(
        "_failed", "_doc", "_broken", "_summary", "_sentiment", "_confidence", "_key_themes"
    )


def read_constrained_summary(df: DataFrame, response: str = "summary_response") -> DataFrame:
    """Read the answer to a ``constrained_prompt`` tolerantly: adds ``summary``,
    ``confidence``, ``sources_used``, ``excluded_content``, or ``error`` and
    ``raw_content`` when nothing in the text parses."""
    rows = df.withColumn("_doc", R.tolerant_json(c(response)))
    lost = c("_doc").isNull()
    return rows.withColumns(
        {
            "summary": R.as_text(R.member(c("_doc"), "summary")),
            "confidence": _read_number(R.member(c("_doc"), "confidence")),
            "sources_used": _read_number(R.member(c("_doc"), "sources_used")).cast("int"),
            "excluded_content": R.as_strings(R.member(c("_doc"), "excluded_content")),
            "error": F.when(lost, K.UNPARSED_RESPONSE),
            "raw_content": F.when(lost, c(response)),
        }
    ).drop("_doc")


def products_without_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Error row for products nobody reviewed. Review keys are reduced to one
    row per product before the join, so a popular product is one row there."""
    reviewed = reviews.select("product_id").distinct()
    return products.join(reviewed, "product_id", "left_anti").select(
        "product_id",
        F.lit(400).alias("status_code"),
        F.lit(K.NO_REVIEWS_ERROR).alias("error"),
    )


def system_error_record(product_id: Column, message: Column) -> Column:
    """Record of a summary that failed as a whole."""
    return F.struct(
        F.lit(500).alias("status_code"),
        product_id.alias("product_id"),
        message.alias("error"),
        F.lit(K.SUMMARY_SYSTEM_ERROR).alias("summary"),
        F.lit(0).alias("reviews_processed"),
        F.lit(0).alias("reviews_included"),
        F.lit(0).alias("reviews_excluded"),
        F.array(F.lit(K.SYSTEM_ERROR)).alias("exclusion_reasons"),
        F.lit(False).alias("ai_generated"),
    )


def summary_records(
    prompts: DataFrame, response: str = "summary_response", call_error: str | None = None
) -> DataFrame:
    """Finished summary rows: read responses for products with passed reviews,
    the fixed record for products without, the error record for products with a
    rating that is no number; all in one projection."""
    rows = parse_summary(prompts, response, call_error)
    failed = c("unreadable_ratings") > 0
    none = c("reviews_included") == 0

    def counted(name: str) -> Column:
        return F.when(failed, F.lit(0)).otherwise(c(name)).alias(name)

    done = rows.select(
        "product_id",
        F.when(none, K.ALL_REJECTED_TEXT).otherwise(c("summary")).alias("summary"),
        counted("reviews_processed"),
        counted("reviews_included"),
        counted("reviews_excluded"),
        "average_rating",
        F.when(none, "neutral").otherwise(c("sentiment")).alias("sentiment"),
        F.when(none, 0.0).otherwise(c("confidence")).alias("confidence"),
        F.when(none, F.array().cast("array<string>"))
        .otherwise(c("key_themes"))
        .alias("key_themes"),
        F.when(none, F.array(F.lit(K.ALL_REJECTED_REASON)))
        .otherwise(F.array().cast("array<string>"))
        .alias("exclusion_reasons"),
        (~none & ~failed).alias("ai_generated"),
        F.when(~none & ~failed, K.MODEL_ID).alias("model_used"),
        failed.alias("_failed"),
    )
    no_themes = F.array().cast("array<string>")
    return done.withColumns(
        {
            "summary": F.when(c("_failed"), K.SUMMARY_SYSTEM_ERROR).otherwise(c("summary")),
            "average_rating": F.when(~c("_failed"), c("average_rating")),
            "sentiment": F.when(~c("_failed"), c("sentiment")),
            "confidence": F.when(~c("_failed"), c("confidence")),
            "key_themes": F.when(c("_failed"), no_themes).otherwise(c("key_themes")),
            "exclusion_reasons": F.when(
                c("_failed"), F.array(F.lit(K.SYSTEM_ERROR))
            ).otherwise(c("exclusion_reasons")),
        }
    ).drop("_failed")


def exclusion_reasons(
    df: DataFrame,
    max_toxicity: float = 5.0,
    shortest: int = 10,
    longest: int = 2000,
) -> DataFrame:
    """Why a review is left out of a summary; an empty array keeps it.

    The length limits are parameters; only the kinds of reason are prescribed.
    """
    length = F.length(F.coalesce(c("content"), F.lit("")))
    return df.withColumn(
        "exclusion_reasons",
        listed(
            (~_passed(), "FAILED_POLICY_ANALYSIS"),
            (F.coalesce(c("toxicity_score"), F.lit(0.0)) > max_toxicity, "HIGH_TOXICITY"),
            (length < shortest, "CONTENT_TOO_SHORT"),
            (length > longest, "CONTENT_TOO_LONG"),
        ),
    )


def fallback_summary(stats: DataFrame) -> DataFrame:
    """Plain text summary when no model answers."""
    return stats.withColumn(
        "summary",
        F.when(
            c("reviews_included") > 0,
            F.concat(
                F.lit("Based on "),
                c("reviews_included").cast("string"),
                F.lit(" reviews, this product has an average rating of "),
                fixed(c("average_rating"), 1),
                F.lit(" stars."),
            ),
        ).otherwise(K.NO_REVIEWS_FALLBACK),
    )


def enough_reviews(stats: DataFrame, minimum: int) -> DataFrame:
    """Mark products with too few passed reviews for a summary."""
    few = c("reviews_included") < minimum
    return stats.withColumns(
        {
            "summary": F.when(
                few,
                F.concat(
                    F.lit("Insufficient reviews for summary: "),
                    c("reviews_included").cast("string"),
                    F.lit(f" of {minimum} required"),
                ),
            ),
            "quality_score": F.when(few, 0.0),
        }
    )
