"""The whole moderation flow as one chain of projections.

From raw submissions to responses and audit records there is no shuffle: the
policy tables are broadcast, everything else is row-wise. The same chain runs on
a batch table and on a stream.
"""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.operators.analysis import audit_response
from reviewgate.operators.audit import audit_records
from reviewgate.operators.policy import PolicySet, threshold_policy
from reviewgate.operators.prompts import gated_prompt
from reviewgate.operators.routing import is_approved, responses
from reviewgate.operators.scoring import Scorer, model_cost, score_distinct, score_prompts
from reviewgate.operators.summaries import parse_summary, single_review_prompt
from reviewgate.operators.validation import input_defaults, split, validate_api
from reviewgate.session import materialise
from reviewgate.plans.rollup import append_rollup
from reviewgate.sources.tables import append_audit, write_corrupt_lines, write_dead_letters, write_rows

log = logging.getLogger(__name__)
c = F.col
INPUT_FIELDS = [
    "review_id",
    "product_id",
    "user_id",
    "content",
    "rating",
    "region",
    "product_category",
    "compliance_mode",
]


def prepare_input(
    df: DataFrame,
    entered_at: Column | None = None,
    execution_id: Column | str = "batch",
    keep: list[str] | None = None,
) -> DataFrame:
    """The eight request fields, the entry time and the execution id."""
    execution = F.lit(execution_id) if isinstance(execution_id, str) else execution_id
    return df.select(
        *INPUT_FIELDS,
        (F.current_timestamp() if entered_at is None else entered_at).alias("timestamp"),
        execution.alias("execution_id"),
        *(keep or []),
    )


def decide(
    prepared: DataFrame,
    response: str = "raw_response",
    call_error: str | None = None,
    summary_response: str | None = None,
    policies: PolicySet | None = None,
) -> DataFrame:
    """Defaults, content gate, response reading, policy; one row per review with
    ``analysis``, ``policy_result`` and, for approved reviews, ``summary``."""
    rows = audit_response(input_defaults(prepared), response, call_error)
    rows = threshold_policy(
        rows.withColumnRenamed("status_code", "analysis_status"), policies=policies
    )
    if summary_response is None:
        return rows
    read = parse_summary(rows, summary_response)
    return read.withColumn(
        "summary", F.when(is_approved(c("policy_result")), c("summary"))
    ).drop("sentiment", "confidence", "key_themes", "status_code")


def moderate(prepared: DataFrame, **options) -> DataFrame:
    """Responses of all reviews, approved and rejected."""
    return responses(decide(prepared, **options))


def scored_reviews(
    df: DataFrame, scorer: Scorer, distinct: bool = True, **options
) -> DataFrame:
    """Add ``raw_response``, ``call_error``, time and tokens by calling the scorer.

    ``distinct`` scores equal (content, category, rating) once; without it the
    stage has no shuffle and may run in a stream. Rows the content gate will
    refuse are not sent.
    """
    if distinct:
        rows = score_distinct(
            df, scorer, gated_prompt, ["content", "product_category", "rating"], **options
        )
    else:
        rows = score_prompts(gated_prompt(df), scorer, **options).withColumn(
            "shared_by", F.lit(1).cast("long")
        )
    return rows.withColumns(
        {
            "raw_response": c("scored.response_text"),
            "call_error": c("scored.call_error"),
            "elapsed_ms": c("scored.elapsed_ms"),
            "processing_duration_ms": c("scored.elapsed_ms").cast("int"),
            "input_tokens": c("scored.input_tokens"),
            "output_tokens": c("scored.output_tokens"),
        }
    ).drop("scored")


def summarise_approved(decided: DataFrame, scorer: Scorer, **options) -> DataFrame:
    """Add ``summary`` to approved reviews, one model call each."""
    prompts = single_review_prompt(decided, is_approved(c("policy_result")))
    scored = score_prompts(prompts, scorer, **options).withColumns(
        {
            "_response": c("scored.response_text"),
            "_error": c("scored.call_error"),
            "_asked": c("scored.attempts") > 0,
        }
    )
    read = parse_summary(scored.drop("scored"), "_response", "_error")
    text = F.when(c("_asked"), c("summary")).otherwise(K.SUMMARY_SYSTEM_ERROR)
    return read.withColumn(
        "summary", F.when(is_approved(c("policy_result")), text)
    ).drop(
        "_response", "_error", "_asked", "sentiment", "confidence", "key_themes", "status_code"
    )


def log_decisions(
    decided: DataFrame, out: str, run_id: str | int, moment: Column, rollup: bool = False
) -> DataFrame | None:
    """Write the audit rows of a run, and with ``rollup`` its daily sums. If that fails the
    flow goes on: the decisions are set aside for a later audit, and there is no log to return."""
    try:
        logged = append_audit(
            audit_records(decided, event_time=c("timestamp"), suffix_chars=32),
            f"{out}/audit",
            run_id,
        )
        if rollup:
            append_rollup(logged, f"{out}/rollup", run_id, f"{out}/audit")
        return logged
    except Exception:
        log.exception("audit of run %s failed", run_id)
        write_dead_letters(
            decided.withColumn("errors", F.array(F.lit("audit"))),
            f"{out}/audit_dead_letters",
            run_id,
            moment,
        )
        return None


def run_moderation(
    submissions: DataFrame,
    scorer: Scorer,
    out: str,
    *,
    run_id: str,
    entered_at: datetime | None = None,
    policies: PolicySet | None = None,
    summary_scorer: Scorer | None = None,
    rollup: bool = False,
    corrupt: DataFrame | None = None,
    **scorer_options,
) -> dict[str, DataFrame]:
    """Batch job: validate, score, decide, then write decisions, responses, audit
    log and dead letters under ``out``.

    Decisions are written once and everything after them reads that table, so
    neither a lost executor nor the second sink repeats a model call. With a
    ``summary_scorer`` every approved review also gets a summary of its own. ``corrupt``
    are the malformed lines of the same input (``read_json_lines``).
    """
    moment = (
        F.current_timestamp()
        if entered_at is None
        else F.lit(entered_at.isoformat(sep=" ")).cast("timestamp")
    )
    # Written once: the refused rows, the distinct texts and the scored rows read it.
    good, bad = split(materialise(validate_api(submissions), "checked"))
    dead = write_dead_letters(bad, f"{out}/dead_letters", run_id, moment)
    if corrupt is not None:
        write_corrupt_lines(corrupt, f"{out}/dead_letters", run_id, moment)
    prepared = prepare_input(good, moment, run_id)
    scored = scored_reviews(prepared, scorer, **scorer_options)
    costed = model_cost(scored, K.MODEL_ID, K.PROMPT_VERSION, K.INFERENCE_CONFIG)
    decided = write_rows(
        decide(costed, call_error="call_error", policies=policies),
        f"{out}/decisions",
        run_id,
    )
    if summary_scorer is not None:
        decided = write_rows(
            summarise_approved(decided, summary_scorer), f"{out}/summarised", run_id
        )
    answered = write_rows(responses(decided), f"{out}/responses", run_id)
    return {
        "decisions": decided,
        "responses": answered,
        "audit": log_decisions(decided, out, run_id, moment, rollup),
        "dead_letters": dead,
    }
