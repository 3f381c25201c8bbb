"""Prompt columns. All of them are plain concatenations, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.functions.text import fill, fixed, shorter_than
from reviewgate.operators.validation import whole_number

c = F.col


def analysis_prompt(df: DataFrame, name: str = "prompt") -> DataFrame:
    """The combined prompt for all three scores."""
    return df.withColumn(
        name,
        fill(
            K.ANALYSIS_PROMPT,
            {
                "product_category": F.coalesce("product_category", F.lit("other")),
                "rating": F.coalesce(whole_number(c("rating")).cast("string"), F.lit("3")),
                "content": c("content"),
            },
        ),
    )


def gated_prompt(df: DataFrame) -> DataFrame:
    """The combined prompt of rows that may be scored, NULL for the others: a
    text under five characters or a rating that is no number costs no call."""
    unread = c("rating").isNotNull() & whole_number(c("rating")).isNull()
    ready = ~shorter_than(c("content"), 5) & ~unread
    return analysis_prompt(df).withColumn("prompt", F.when(ready, c("prompt")))


def aspect_prompts(df: DataFrame) -> DataFrame:
    """One prompt per aspect, as three columns of the same row."""
    templates = {
        "toxicity_prompt": K.TOXICITY_PROMPT,
        "bias_prompt": K.BIAS_PROMPT,
        "hallucination_prompt": K.HALLUCINATION_PROMPT,
    }
    return df.withColumns(
        {name: fill(text, {"content": c("content")}) for name, text in templates.items()}
    )


def constrained_prompt(
    df: DataFrame,
    max_toxicity: float | Column = 5.0,
    max_bias: float | Column = 3.0,
    max_hallucination: float | Column = 6.0,
) -> DataFrame:
    """Summary request that states the policy limits, over ``reviews_content``."""

    def limit(value):
        return value if isinstance(value, Column) else F.lit(float(value))

    return df.withColumns(
        {
            "prompt": fill(
                K.SUMMARIZATION_PROMPT,
                {
                    "reviews_content": c("reviews_content"),
                    "max_toxicity": limit(max_toxicity),
                    "max_bias": limit(max_bias),
                    "max_hallucination": limit(max_hallucination),
                },
            ),
            "max_tokens": F.lit(K.SUMMARY_MAX_TOKENS),
        }
    )


def product_prompt(df: DataFrame) -> DataFrame:
    """Summary request of a product from its statistics and its listed reviews."""
    return df.withColumn(
        "prompt",
        F.when(
            c("reviews_included") > 0,
            fill(
                K.PRODUCT_SUMMARY_PROMPT,
                {
                    "approved_count": c("reviews_included"),
                    "product_id": c("product_id"),
                    "reviews_text": c("reviews_text"),
                    "average_rating": fixed(c("average_rating"), 1),
                },
            ),
        ),
    )
