"""Answers kept over runs: what was answered once is not called again."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from reviewgate.operators import responses_store as R
from reviewgate.operators.scoring import score_distinct

MODEL = "model-1"


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def noting(calls, fails=lambda prompt: False, dies=lambda prompt: False):
    folder = str(calls)

    def model(prompt, **options):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
            out.write(prompt)
        if dies(prompt):
            os._exit(1)
        if fails(prompt):
            raise RuntimeError("busy")
        return f"answer to {prompt}{options or ''}", 3, 4

    return model


def made(calls):
    """Prompts called so far, then forgotten."""
    out = sorted(x.read_text() for x in calls.iterdir())
    for x in calls.iterdir():
        x.unlink()
    return out


@pytest.fixture
def prompts(spark):
    return spark.range(60).select(
        "id",
        F.when(F.col("id") == 7, F.lit(None))
        .otherwise(F.concat(F.lit("p"), (F.col("id") % 20).cast("string")))
        .alias("prompt"),
    )


def answered(frame):
    return {r.id: r.scored.response_text for r in frame.collect()}


def test_a_second_run_calls_nothing(prompts, calls, tmp_path):
    path = str(tmp_path / "store")
    kept = {"path": path, "model": MODEL}
    first = R.score_stored(prompts, noting(calls), run_id="1", **kept)
    assert made(calls) == sorted(f"p{i}" for i in range(20))
    want = {i: None if i == 7 else f"answer to p{i % 20}" for i in range(60)}
    assert answered(first) == want and first.columns == ["id", "scored", "from_store"]
    assert first.filter("from_store").count() == 0
    second = R.score_stored(prompts, noting(calls), run_id="2", **kept)
    assert made(calls) == [] and answered(second) == want
    assert second.filter("from_store").count() == 59
    assert second.filter("id = 7").first().scored.attempts == 0
    more = prompts.withColumn("prompt", F.concat(F.lit("p"), F.col("id").cast("string")))
    R.score_stored(more, noting(calls), run_id="3", **kept)
    assert made(calls) == sorted(f"p{i}" for i in range(20, 60))


def test_failed_calls_are_called_again(prompts, calls, tmp_path):
    kept = {"path": str(tmp_path / "store"), "model": MODEL, "base_delay": 0.0}
    fails = lambda p: p in ("p3", "p4")
    first = R.score_stored(prompts, noting(calls, fails), run_id="1", **kept)
    errors = {r.id for r in first.filter("scored.call_error = 'busy'").collect()}
    assert errors == {i for i in range(60) if i % 20 in (3, 4)}
    made(calls)
    second = R.score_stored(prompts, noting(calls), run_id="2", **kept)
    assert made(calls) == ["p3", "p4"]
    assert second.filter("scored.call_error is not null").count() == 0


def test_a_killed_run_goes_on_after_its_last_wave(prompts, calls, tmp_path):
    path = str(tmp_path / "store")
    kept = {"path": path, "model": MODEL, "wave_calls": 4, "partitions": 1, "in_flight": 1}
    waves = {}
    for i in range(20):
        key = prompts.sparkSession.range(1).select(R.prompt_key(F.lit(f"p{i}"), MODEL)).first()[0]
        waves.setdefault(int(key[2:10], 16) % 5, []).append(f"p{i}")
    assert len(waves) > 2
    last = waves[max(waves)]

    class Killed(Exception):
        pass

    real, done = R.append_answers, []

    def killed(rows, path, run):
        if run.endswith(f"-{max(waves)}"):
            raise Killed
        real(rows, path, run)
        done.append(run)

    R.append_answers = killed
    try:
        with pytest.raises(Killed):
            R.score_stored(prompts, noting(calls), run_id="1", **kept)
    finally:
        R.append_answers = real
    assert sorted(made(calls) + last) == sorted(f"p{i}" for i in range(20))
    again = R.score_stored(prompts, noting(calls), run_id="1", **kept)
    assert made(calls) == sorted(last)
    assert answered(again)[5] == "answer to p5"
    # Nothing of the killed attempt was lost from the store.
    R.score_stored(prompts, noting(calls), run_id="2", **kept)
    assert made(calls) == []


def test_model_and_options_are_part_of_the_key(prompts, calls, tmp_path):
    path = str(tmp_path / "store")
    few = prompts.filter("id < 3")
    R.score_stored(few, noting(calls), path, "1", model=MODEL)
    R.score_stored(few, noting(calls), path, "2", model="model-2")
    got = R.score_stored(
        few, noting(calls), path, "3", model=MODEL, call_options={"max_tokens": 9}
    )
    assert len(made(calls)) == 9
    assert answered(got)[1] == "answer to p1{'max_tokens': 9}"


def test_compaction_keeps_every_answer(spark, prompts, calls, tmp_path):
    path = str(tmp_path / "store")
    for run in range(3):
        part = prompts.filter(F.col("id") % 20 < 5 * (run + 2))
        R.score_stored(part, noting(calls, lambda p: p == "p9"), path, str(run), model=MODEL)
    before = {r.prompt_key for r in R.read_store(spark, path).filter("scored.call_error is null").collect()}
    R.compact(spark, path, "merged")
    after = R.read_store(spark, path).collect()
    assert {r.prompt_key for r in after} == before and len(after) == len(before) == 19
    assert {r.run for r in after} == {"merged"}
    made(calls)
    R.score_stored(prompts, noting(calls), path, "4", model=MODEL)
    assert made(calls) == ["p9"]


def test_distinct_texts_through_the_store(spark, calls, tmp_path):
    rows = spark.range(300).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("content")
    )
    build = lambda df: df.withColumn("prompt", F.col("content"))
    store = {"path": str(tmp_path / "store"), "model": MODEL}
    for run, n in (("1", 8), ("2", 0)):
        got = score_distinct(
            rows, noting(calls), build, ["content"], store=store | {"run_id": run}
        )
        assert {r.scored.response_text == f"answer to {r.content}" for r in got.collect()} == {True}
        assert got.count() == 300 and len(made(calls)) == n
