"""Continuous moderation of arriving reviews."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewgate import constants as K
from reviewgate.operators.policy import PolicySet
from reviewgate.operators.policy_history import PolicyHistory
from reviewgate.operators.routing import responses
from reviewgate.operators.scoring import Scorer, model_cost
from reviewgate.operators.validation import split, validate_api
from reviewgate.plans.moderation import (
    decide,
    log_decisions,
    prepare_input,
    scored_reviews,
    summarise_approved,
)
from reviewgate.sources.reviews import split_lines
from reviewgate.sources.tables import (
    put_by_key,
    write_corrupt_lines,
    write_dead_letters,
    write_rows,
)


def scoring_decider(
    scorer: Scorer,
    run_id: str,
    entered_at: datetime | None = None,
    policies: PolicySet | Callable[[SparkSession], PolicySet | PolicyHistory] | None = None,
    summary_scorer: Scorer | None = None,
    **options,
) -> Callable[[DataFrame], DataFrame]:
    """Turn submissions into decided rows by calling the scorer per row, which
    needs no shuffle and keeps no state. With a ``summary_scorer`` every approved
    review also gets a summary of its own. ``policies`` may be a function: it is asked for
    every micro-batch, so a running stream takes up an update (``read_policy_history``)."""

    def decide_rows(rows: DataFrame) -> DataFrame:
        prepared = prepare_input(rows, _moment(entered_at), run_id)
        scored = scored_reviews(prepared, scorer, distinct=False, **options)
        costed = model_cost(scored, K.MODEL_ID, K.PROMPT_VERSION, K.INFERENCE_CONFIG)
        current = policies(rows.sparkSession) if callable(policies) else policies
        decided = decide(costed, call_error="call_error", policies=current)
        if summary_scorer is None:
            return decided
        return summarise_approved(decided, summary_scorer, **options)

    return decide_rows


def _moment(at: datetime | None) -> Column:
    if at is None:
        return F.current_timestamp()
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def write_batch(
    batch: DataFrame,
    batch_id: int,
    out: str,
    decide_rows: Callable[[DataFrame], DataFrame],
    received_at: datetime | None = None,
    rollup: bool = False,
) -> None:
    """Write one micro-batch. Every sink folder is named by the batch id and
    overwritten, so a batch that is run again leaves the same rows."""
    moment = _moment(received_at)
    # Both sides of the split read the batch once; it is small and may be read again.
    checked = validate_api(batch).persist()
    try:
        good, bad = split(checked)
        write_dead_letters(bad, f"{out}/dead_letters", batch_id, moment)
        decided = write_rows(decide_rows(good), f"{out}/decisions", batch_id)
    finally:
        checked.unpersist()
    write_rows(responses(decided), f"{out}/responses", batch_id)
    log_decisions(decided, out, batch_id, moment, rollup)


def start_moderation(
    reviews: DataFrame,
    out: str,
    checkpoint: str,
    decide_rows: Callable[[DataFrame], DataFrame] = decide,
    received_at: datetime | None = None,
    trigger: dict | None = None,
    rollup: bool = False,
) -> StreamingQuery:
    """Moderate reviews as they arrive.

    By default everything there is, then stop; with ``trigger``, such as
    ``{"processingTime": "30 seconds"}``, go on until stopped. ``decide_rows`` turns
    valid submissions into decided rows; it may call a scorer, whose result is
    written before any other sink reads it. With ``rollup`` each batch adds its daily sums
    of the audit log (see ``plans.rollup``), which reports then read.
    """
    return (
        reviews.writeStream.foreachBatch(
            lambda batch, batch_id: write_batch(
                batch, batch_id, out, decide_rows, received_at, rollup
            )
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_json_moderation(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    decide_rows: Callable[[DataFrame], DataFrame] = decide,
    received_at: datetime | None = None,
    trigger: dict | None = None,
    rollup: bool = False,
) -> StreamingQuery:
    """Moderate reviews that arrive as JSON lines (``stream_json_lines``). Malformed lines go
    to the dead letters with their file; the others go the way of ``start_moderation``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_lines(batch)
        write_corrupt_lines(bad, f"{out}/dead_letters", batch_id, _moment(received_at))
        write_batch(good, batch_id, out, decide_rows, received_at, rollup)

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_upsert(
    rows: DataFrame,
    out: str,
    checkpoint: str,
    key: str = "review_id",
    version: str = "timestamp",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the last delivery of every key in a stored table, whenever it arrives.

    A batch that is run again puts the same rows, so nothing is counted twice.
    """
    return (
        rows.writeStream.foreachBatch(
            lambda batch, _: put_by_key(out, batch, key, version)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def without_redelivery(
    reviews: DataFrame, time: str = "timestamp", delay: str = "10 minutes"
) -> DataFrame:
    """Keep one row of a review that is delivered again within ``delay``."""
    return reviews.withWatermark(time, delay).dropDuplicatesWithinWatermark(["review_id"])
