"""Answers of a model, kept over runs.

A stored answer is found by a digest of everything that decides it: the model's name, the call
options and the prompt. Before calling, the digests of a run are looked up in the store; only
what is missing is called, in waves, and every wave is written to the store when it ends. So a
second run over the same prompts calls nothing, and a run that was killed goes on after the last
wave that ended. Failed calls are written, too, but never found: the next run calls them again.

Layout: ``path/bucket=<first hex digit of the key>/run=<run>-<attempt>-<wave>``. Every attempt
has folders of its own, so a repeated run replaces nothing that others rely on; of several
answers to a key the first run's counts. ``compact`` merges the runs of a store.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.operators.scoring import Scorer, score_prompts
from reviewgate.schemas import SCORER_RESULT
from reviewgate.session import discard, materialise, scratch_path

c = F.col
#: Calls of one wave, about: what a killed run has to repeat at most.
WAVE_CALLS = 100_000
STORED = T.StructType(
    [
        T.StructField("prompt_key", T.StringType()),
        T.StructField("scored", SCORER_RESULT),
        T.StructField("bucket", T.StringType()),
        T.StructField("run", T.StringType()),
    ]
)


def prompt_key(prompt: Column, model: str, options: dict | None = None) -> Column:
    """Digest of all that an answer depends on; NULL for no prompt."""
    settings = json.dumps([model, options or {}], sort_keys=True)
    return F.sha2(F.concat(F.lit(settings), F.lit("\x1f"), prompt).cast("binary"), 256)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored calls; an empty table if there is no store yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def _answers(store: DataFrame) -> DataFrame:
    """One answer per key. Runs at the same time may both have called for it."""
    return (
        store.filter(c("scored.call_error").isNull())
        .groupBy("bucket", "prompt_key")
        .agg(F.min_by("scored", "run").alias("scored"))
    )


def score_stored(
    df: DataFrame,
    scorer: Scorer,
    path: str,
    run_id: str,
    *,
    model: str,
    prompt: str = "prompt",
    out: str = "scored",
    wave_calls: int = WAVE_CALLS,
    call_options: dict | None = None,
    **options,
) -> DataFrame:
    """Rows with distinct prompts and their answers, from the store or from new calls.

    Takes and gives what ``score_prompts`` does for one prompt column, plus ``from_store``.
    The result is a written table. ``model`` names what answers; a changed name, prompt or
    option is a different key.
    """
    spark = df.sparkSession
    keyed = df.withColumn("prompt_key", prompt_key(c(prompt), model, call_options))
    asked = materialise(
        keyed.withColumn("bucket", F.left("prompt_key", F.lit(1))), "stored-asked"
    )
    wanted = asked.filter("prompt_key is not null").select("bucket", "prompt_key").distinct()
    # The store is far larger than a run, as a rule: its rows are dropped by a Bloom filter
    # of the wanted keys, where Spark finds that worth its price, before they are shuffled.
    known = materialise(
        _answers(read_store(spark, path).join(wanted, ["bucket", "prompt_key"], "left_semi")),
        "stored-known",
    )
    missing = materialise(
        asked.join(known, ["bucket", "prompt_key"], "left_anti")
        .filter("prompt_key is not null")
        .groupBy("bucket", "prompt_key")
        .agg(F.any_value(prompt).alias("prompt")),
        "stored-missing",
    )
    n = missing.count()
    waves, attempt = max(1, math.ceil(n / wave_calls)), f"{run_id}-{uuid.uuid4().hex}"
    wave = F.pmod(F.conv(F.substring("prompt_key", 3, 8), 16, 10).cast("long"), F.lit(waves))
    for i in range(waves if n else 0):
        rows = score_prompts(
            missing.filter(wave == i), scorer, call_options=call_options, **options
        )
        append_answers(rows, path, f"{attempt}-{i}")
    fresh = read_store(spark, path).filter(c("run").startswith(f"{attempt}-"))
    called = fresh.join(missing, ["bucket", "prompt_key"], "left_semi").select(
        "bucket", "prompt_key", "scored", F.lit(False).alias("from_store")
    )
    answers = known.withColumn("from_store", F.lit(True)).unionByName(called)
    joined = asked.drop(prompt).join(answers, ["bucket", "prompt_key"], "left")
    nothing = F.struct(
        *[
            (F.lit(0) if f.name in ("attempts", "elapsed_ms") else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in SCORER_RESULT
        ]
    )
    return materialise(
        joined.withColumns(
            {
                out: F.coalesce("scored", nothing),
                "from_store": F.coalesce("from_store", F.lit(False)),
            }
        ).drop("bucket", "prompt_key", *([] if out == "scored" else ["scored"])),
        "stored-answered",
    )


def append_answers(rows: DataFrame, path: str, run: str) -> None:
    """One wave, in folders of its own."""
    rows.select("prompt_key", "scored", "bucket", F.lit(run).alias("run")).hint(
        "rebalance", "bucket"
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket", "run"
    ).parquet(path)


def compact(spark: SparkSession, path: str, run: str) -> None:
    """Merge all runs into the folders of ``run``, one answer per key; failed calls go.

    The merged rows are written first and the old folders go afterwards, so a reader finds
    every answer at any time, at most twice, which ``score_stored`` allows for.
    """
    store = read_store(spark, path)
    old = [(r.bucket, r.run) for r in store.select("bucket", "run").distinct().collect()]
    scratch = scratch_path(spark, "store")
    merged = materialise(_answers(store), "store", scratch)
    append_answers(merged, path, run)
    for bucket, name in old:
        if name != run:
            discard(spark, f"{path}/bucket={bucket}/run={name}")
    discard(spark, scratch)
