"""Calling a model over a table of prompts.

A scorer is any picklable callable that takes a prompt text (and the call options, if
any are given) and returns the response text, or a tuple ``(text, input tokens, output
tokens)``. It runs inside ``mapInArrow`` with a bounded number of calls in flight
per task, so the partition count of the stage bounds the load on the service. Below that bound
each task follows the service: a refused call (``Throttled``) lowers the number of its calls in
flight by a factor, answered ones raise it slowly.
"""

from __future__ import annotations

import random
import sys
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reviewgate import constants as K
from reviewgate.functions.collections import text_map
from reviewgate.functions.numbers import call_cost
from reviewgate.schemas import SCORER_RESULT
from reviewgate.session import materialise

# Executors need not have this package installed: ship this module by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Scorer = Callable[[str], str | tuple[str, int, int]]
c = F.col


class Throttled(Exception):
    """Raised by a scorer when the service asks to slow down; it is retried."""


class InFlight:
    """How many calls of a task may run at once: additive increase, multiplicative decrease.

    Refusals of calls that began before the last decrease tell nothing new and change nothing.
    """

    FACTOR, STEP = 0.85, 0.1

    def __init__(self, most: int):
        self.most, self.limit = most, float(most)
        self._active, self._epoch = 0, 0
        self._changed = threading.Condition()

    def enter(self) -> int:
        with self._changed:
            self._changed.wait_for(lambda: self._active < int(self.limit))
            self._active += 1
            return self._epoch

    def leave(self, epoch: int, refused: bool) -> None:
        with self._changed:
            self._active -= 1
            if not refused:
                # About one more call after 1 / STEP rounds of calls.
                self.limit = min(self.most, self.limit + self.STEP / self.limit)
            elif epoch == self._epoch:
                self.limit = max(1.0, self.limit * self.FACTOR)
                self._epoch += 1
            self._changed.notify_all()


def _call(
    scorer: Scorer,
    prompt: str | None,
    retries: int,
    base_delay: float,
    options: dict | None = None,
    load: InFlight | None = None,
):
    """(response, error, attempts, ms, input tokens, output tokens) of one call.
    An absent prompt is not called."""
    if prompt is None:
        return None, None, 0, 0, None, None
    attempts, response, error, started = 0, None, None, 0.0
    while True:
        attempts += 1
        epoch = load.enter() if load else 0
        if attempts == 1:  # waiting for one's turn is not the model's time
            started = time.monotonic()
        refused = False
        try:
            try:
                response = scorer(prompt, **(options or {}))
            except Throttled:
                refused = True
                raise
            finally:
                if load:
                    load.leave(epoch, refused)
            break
        except Throttled as slow:
            if attempts > retries:
                error = str(slow)
                break
            pause = base_delay * 2 ** (attempts - 1)
            time.sleep(pause + random.uniform(0, min(1.0, base_delay)))
        except Exception as failure:  # a failed call is a result, not a failed job
            error = str(failure)
            break
    elapsed_ms = int((time.monotonic() - started) * 1000)
    text, *usage = response if isinstance(response, tuple) else (response, None, None)
    return text, error, attempts, elapsed_ms, *usage


def score_prompts(
    df: DataFrame,
    scorer: Scorer,
    prompts: dict[str, str] | None = None,
    *,
    templates: dict[str, str] | None = None,
    text: str = "content",
    in_flight: int = 5,
    retries: int = 3,
    base_delay: float = 1.0,
    partitions: int | None = None,
    call_options: dict | None = None,
) -> DataFrame:
    """Call the scorer on every prompt of every row.

    ``prompts`` maps a prompt column to the struct column that receives
    ``response_text, call_error, attempts, elapsed_ms, input_tokens,
    output_tokens``. Instead, ``templates`` maps such a column to a prompt text whose
    ``{content}`` is filled from the ``text`` column where the call is made, so the text
    goes there once however many prompts there are. All prompts are scored in one
    pass over the rows; a NULL prompt is not called. The other columns pass through as
    they are. ``call_options`` go to every call. There is no shuffle unless
    ``partitions`` is given: it fixes the number of tasks, and with
    ``in_flight`` the most calls the service can ever see at once.
    """
    if partitions:
        df = df.repartition(partitions)
    if templates is None:
        jobs = [(x, None, out) for x, out in (prompts or {"prompt": "scored"}).items()]
        kept = [f for f in df.schema if f.name not in {x for x, _, _ in jobs}]
    else:
        jobs = [(text, tuple(t.split("{content}", 1)), out) for out, t in templates.items()]
        kept = list(df.schema)
    schema = T.StructType(kept + [T.StructField(out, SCORER_RESULT) for _, _, out in jobs])
    kept_at = [df.columns.index(f.name) for f in kept]
    work = [(df.columns.index(x), ends) for x, ends, _ in jobs]
    fields, kind = SCORER_RESULT.fieldNames(), to_arrow_type(SCORER_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = InFlight(in_flight)
        with ThreadPoolExecutor(max_workers=in_flight) as pool:
            for batch in batches:
                out = [batch.column(i) for i in kept_at]
                for at, ends in work:
                    texts = batch.column(at).to_pylist()
                    if ends is not None:
                        texts = [None if x is None else x.join(ends) for x in texts]
                    results = pool.map(
                        lambda x: _call(scorer, x, retries, base_delay, call_options, load),
                            texts,
                    )
                    out.append(pa.array([dict(zip(fields, row)) for row in results], kind))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return df.mapInArrow(run, schema)


def score_distinct(
    df: DataFrame,
    scorer: Scorer,
    build_prompt: Callable[[DataFrame], DataFrame] | None,
    inputs: list[str],
    *,
    hot_share: float = 1e-4,
    path: str | None = None,
    templates: dict[str, str] | None = None,
    salts: int = 16,
    store: dict | None = None,
    **options,
) -> DataFrame:
    """Score each distinct input once and give the result to every row.

    The distinct inputs are aggregated map-side first, so a text that fills a
    third of the table costs one call and one shuffled row per task. Responses
    are written before they are joined back: a model call is never repeated by
    a recomputed stage. They are joined back on the inputs' hash, once. Inputs that hold
    more than ``hot_share`` of the rows, of which there are at most ``1 / hot_share``
    however large the table is, are dealt over ``salts`` slices; only their hashes
    are broadcast. ``shared_by`` tells how many rows a call served. With ``templates``
    (see ``score_prompts``) the one input is filled into several prompts. ``store``
    (``path``, ``run_id``, ``model``; see ``responses_store.score_stored``) keeps the answers
    of one prompt per row over runs: what it holds is not called.
    """
    # Two hashes: 64 bits alone would collide on a table of billions of texts.
    plain = [F.coalesce(c(x).cast("string"), F.lit("\x00")) for x in inputs]
    keys = {"_h": F.xxhash64(*inputs), "_m": F.md5(F.concat_ws("\x1f", *plain))}
    on = ["_h", "_m"]
    distinct = df.groupBy(*inputs).agg(F.count(F.lit(1)).alias("_rows")).withColumns(keys)
    if templates is None:
        asked = build_prompt(distinct).select(*on, "_rows", "prompt")
        if store is None:
            called = score_prompts(asked, scorer, **options)
        else:
            from reviewgate.operators.responses_store import score_stored

            called = score_stored(asked, scorer, **store, **options)
        results = ["scored"]
    else:
        asked = distinct.select(*on, "_rows", *inputs)
        called = score_prompts(asked, scorer, templates=templates, text=inputs[0], **options)
        results = list(templates)
    scored = materialise(
        called.select(*on, "_rows", *results), "scored-prompts", path
    )
    limit = F.lit((scored.agg(F.sum("_rows")).first()[0] or 0) * hot_share)
    hot = scored.filter(c("_rows") > limit).select(*on, F.lit(True).alias("_hot"))
    slices = F.when(c("_rows") > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    answers = scored.select(
        *on, F.explode(slices).alias("_salt"), *results, c("_rows").alias("shared_by")
    )
    salt = F.when(c("_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    marked = df.withColumns(keys).join(F.broadcast(hot), on, "left")
    keyed = marked.withColumn("_salt", salt).drop("_hot")
    return keyed.join(answers, [*on, "_salt"]).drop(*on, "_salt")


def mock_scores(df: DataFrame) -> DataFrame:
    """Constant scores for smoke runs without a model."""
    return df.withColumns(
        {
            "analysis": F.struct(
                *[F.lit(K.MOCK_SCORES[a]).alias(f"{a}_score") for a in K.ASPECTS],
                text_map(K.MOCK_EXPLANATIONS).alias("explanations"),
                F.lit(None).cast("map<string,double>").alias("confidence_scores"),
            ),
            "model_metadata": model_metadata(
                K.LIBRARY_MODEL_ID, K.LIBRARY_PROMPT_VERSION, K.INFERENCE_CONFIG
            ),
            "processing_time_ms": F.lit(K.MOCK_PROCESSING_MS),
        }
    )


def mock_scorer(prompt: str) -> str:
    """The same constant scores as a scorer's response text."""
    return (
        '{"toxicity_score": 1.0, "bias_score": 0.5, "hallucination_score": 2.0, '
        '"explanations": {"toxicity": "Content appears positive and non-toxic", '
        '"bias": "No obvious bias indicators detected", '
        '"hallucination": "Claims appear reasonable for product review"}}'
    )


def model_metadata(
    model_id: str,
    prompt_version: str,
    config: dict[str, str],
    elapsed_ms: Column | None = None,
    cost_usd: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(model_id).alias("model_id"),
        F.lit(prompt_version).alias("prompt_version"),
        text_map(config).alias("inference_config"),
        (F.lit(None) if elapsed_ms is None else elapsed_ms)
        .cast("int")
        .alias("processing_time_ms"),
        (F.lit(None) if cost_usd is None else cost_usd).cast("double").alias("cost_usd"),
    )


def model_cost(
    df: DataFrame,
    model_id: str = K.LIBRARY_MODEL_ID,
    prompt_version: str = K.LIBRARY_PROMPT_VERSION,
    config: dict[str, str] | None = None,
) -> DataFrame:
    """Cost of a call from its token counts, and the metadata record.

    Rows that shared a call (``shared_by``) share its cost, so that costs add up
    to what was spent.
    """
    cost = call_cost(c("input_tokens"), c("output_tokens"))
    if "shared_by" in df.columns:
        cost = cost / c("shared_by")
    elapsed = c("elapsed_ms") if "elapsed_ms" in df.columns else None
    settings = K.LIBRARY_INFERENCE_CONFIG if config is None else config
    return df.withColumns(
        {
            "cost_usd": cost,
            "model_metadata": model_metadata(
                model_id, prompt_version, settings, elapsed, cost
            ),
        }
    )
