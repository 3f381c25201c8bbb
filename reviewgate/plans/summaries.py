"""Product summaries from moderated reviews."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.operators.lookups import hot_keys
from reviewgate.operators.prompts import constrained_prompt
from reviewgate.operators.scoring import Scorer, score_prompts
from reviewgate.operators.summaries import (
    PART_CHARS,
    merged_parts,
    read_constrained_summary,
    review_parts,
    summary_prompts,
    summary_records,
)
from reviewgate.session import materialise

c = F.col


def summarise_products(
    reviews: DataFrame, scorer: Scorer, path: str | None = None, **options
) -> DataFrame:
    """Prompt per product, one model call per product with passed reviews, and
    the finished records. The called rows are written before they are read on; products
    without a prompt pass the scoring stage without a call."""
    prompts = summary_prompts(reviews, hot_keys(reviews, ["product_id"]))
    rows = materialise(score_prompts(prompts, scorer, **options), "summary-calls", path)
    return summary_records(
        rows.withColumns(
            {
                "summary_response": c("scored.response_text"),
                "summary_error": c("scored.call_error"),
            }
        ),
        call_error="summary_error",
    )


def summarise_within_limits(
    reviews: DataFrame, scorer: Scorer, path: str | None = None, **options
) -> DataFrame:
    """Summaries that must keep the policy limits: one call for each part of a
    product's reviews, with the token budget, written before the answers are read."""
    budget = {"max_tokens": K.SUMMARY_MAX_TOKENS}
    asked = constrained_prompt(review_parts(reviews)).drop("max_tokens", "reviews_content")
    called = materialise(
        score_prompts(asked, scorer, call_options=budget, **options), "limited-calls", path
    )
    read = called.withColumns(
        {"_response": c("scored.response_text"), "call_error": c("scored.call_error")}
    )
    return read_constrained_summary(read.drop("scored"), "_response").drop("_response")


def summarise_tree(
    reviews: DataFrame,
    scorer: Scorer,
    part_chars: int = PART_CHARS,
    fan_in: int = 10,
    path: str | None = None,
    **options,
) -> DataFrame:
    """One summary per product that keeps the policy limits, however many reviews it has.

    The reviews are summarised in parts, then ``fan_in`` neighbouring summaries at a time,
    until a product has one. Each level is written before the next one reads it, so a call is
    made once; a part without neighbours goes up without a call. No group holds more than
    ``fan_in`` summaries, and the number of levels grows with the logarithm of the parts.

    ``sources_used`` adds up over the tree, and so do ``n_parts`` and ``failed_parts``: a part
    without a readable summary is left out of those above it, and its error is kept only if
    no other part of the product was read.
    """
    done = None
    level = _called(review_parts(reviews, part_chars), scorer, _at(path, 0), options)
    level = level.withColumns(
        {"n_parts": F.lit(1).cast("long"), "failed_parts": _unread().cast("long")}
    )
    most, depth = level.agg(F.max("parts")).first()[0] or 0, 0
    while most > 1:
        whole = level.filter("parts = 1")
        done = whole if done is None else done.unionByName(whole)
        bundles = merged_parts(level.filter("parts > 1"), fan_in)
        depth += 1
        answered = _called(bundles, scorer, _at(path, depth), options, keep=bundles.columns)
        level = _risen(answered).select(*whole.columns)
        most = math.ceil(most / fan_in)
    rows = level if done is None else done.unionByName(level)
    return rows.drop("part", "parts")


def _at(path: str | None, depth: int) -> str | None:
    return None if path is None else f"{path}/level={depth}"


def _unread() -> Column:
    return c("error").isNotNull() | c("call_error").isNotNull() | c("summary").isNull()


def _called(
    parts: DataFrame, scorer: Scorer, path: str | None, options: dict, keep: tuple | list = ()
) -> DataFrame:
    """Parts with their answers read: written once, then read from there."""
    budget = {"max_tokens": K.SUMMARY_MAX_TOKENS}
    asked = constrained_prompt(parts).drop("max_tokens")
    if "calls" in parts.columns:
        asked = asked.withColumn("prompt", F.when(c("calls"), c("prompt")))
    called = materialise(
        score_prompts(asked.drop("reviews_content"), scorer, call_options=budget, **options),
        "part-calls", path,
    )
    read = called.withColumns(
        {"_response": c("scored.response_text"), "call_error": c("scored.call_error")}
    )
    return read_constrained_summary(read.drop("scored"), "_response").drop("_response")


def _risen(answered: DataFrame) -> DataFrame:
    """Bundles after their call; those without one keep the answer of their only part."""
    fields = ("summary", "confidence", "excluded_content", "error", "raw_content", "call_error")
    rows = answered
    for name in fields:
        rows = rows.withColumn(
            name, F.when(c("calls"), c(name)).otherwise(c(f"only.{name}"))
        )
    return rows.withColumn("sources_used", c("sources_below"))


def stored_summaries(
    records: DataFrame, run_id: str, generated_at: Column | None = None
) -> DataFrame:
    """Finished records in the shape of the summaries table. The id is that of the
    product in this run, so a later run adds to the history and a repeated one does not."""
    moment = F.current_timestamp() if generated_at is None else generated_at
    return records.select(
        F.concat(
            F.lit("summary-"), F.md5(F.concat_ws("|", "product_id", F.lit(run_id)))
        ).alias("summary_id"),
        "product_id",
        c("summary").alias("summary_text"),
        "reviews_processed",
        "reviews_excluded",
        "exclusion_reasons",
        moment.alias("generated_at"),
        F.create_map().cast("map<string,double>").alias("policy_constraints"),
    )
