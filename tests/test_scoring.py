import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from reviewgate.operators.scoring import (
    InFlight,
    Throttled,
    _call,
    mock_scorer,
    model_cost,
    score_distinct,
    score_prompts,
)
from reviewgate.operators.prompts import analysis_prompt
from reviewgate.plans.moderation import scored_reviews


def test_calls_in_flight_follow_the_service():
    """A service that bears 20 calls at once, asked with up to 40: few retries, most of its rate."""
    lock, active, seen = threading.Lock(), [0], []

    def limited(prompt):
        with lock:
            active[0] += 1
            over = active[0] > 20
            seen.append((over, active[0] - over))
        try:
            time.sleep(0.0005 if over else 0.01)
            if over:
                raise Throttled("slow down")
            return "ok"
        finally:
            with lock:
                active[0] -= 1

    load = InFlight(40)
    with ThreadPoolExecutor(40) as pool:
        found = list(
            pool.map(lambda x: _call(limited, x, 9, 0.001, load=load), map(str, range(4_000)))
        )
    assert all(x[0] == "ok" for x in found)
    assert len(seen) - 4_000 < 0.05 * 4_000
    steady = [n for _, n in seen[500:-100]]
    assert sum(steady) / len(steady) >= 0.9 * 20 * 0.95


def test_one_call_at_a_time_is_always_allowed():
    load = InFlight(4)
    for _ in range(50):
        load.leave(load.enter(), True)
    assert load.limit == 1.0
    epochs = [load.enter()]
    load.leave(epochs[0], False)
    assert 1.0 < load.limit < 4
    late = InFlight(8)
    old = [late.enter() for _ in range(8)]
    for epoch in old:  # eight refusals of one moment count once
        late.leave(epoch, True)
    assert late.limit == 8 * InFlight.FACTOR


def test_throttled_calls_are_retried():
    seen = []

    def slow(prompt):
        seen.append(prompt)
        if len(seen) < 3:
            raise Throttled("slow down")
        return "ok"

    assert _call(slow, "p", 3, 0.0)[:3] == ("ok", None, 3)

    def never(prompt):
        raise Throttled("slow down")

    assert _call(never, "p", 3, 0.0)[:3] == (None, "slow down", 4)

    def broken(prompt):
        raise ValueError("bad request")

    assert _call(broken, "p", 3, 0.0)[:3] == (None, "bad request", 1)
    assert _call(broken, None, 3, 0.0) == (None, None, 0, 0, None, None)
    assert _call(lambda p: ("text", 12, 34), "p", 3, 0.0)[4:] == (12, 34)


def test_backoff_doubles(monkeypatch):
    pauses = []
    monkeypatch.setattr("reviewgate.operators.scoring.time.sleep", pauses.append)

    def never(prompt):
        raise Throttled("slow down")

    _call(never, "p", 3, 1.0)
    assert len(pauses) == 3
    assert all(2**n <= pause <= 2**n + 1 for n, pause in enumerate(pauses))


def reviews(spark, n=3000):
    """A third of the rows share one text, others come in small groups."""
    k = F.col("id")
    return spark.range(n).select(
        k,
        F.when(k % 3 == 0, F.lit("the same text again"))
        .when(k % 100 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("text number "), (k - k % 4).cast("string")))
        .alias("content"),
        F.lit("books").alias("product_category"),
        F.lit(4).alias("rating"),
    )


def counting_scorer(folder):
    def score(prompt):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if len(prompt) % 5 == 0:
            raise RuntimeError("down")
        return f"answer {len(prompt)}"

    return score


@pytest.mark.parametrize("hot_share", [1e-4, 0.01, 0.9])
def test_each_distinct_text_is_scored_once_and_no_row_is_lost(spark, tmp_path, hot_share):
    df = reviews(spark)
    plain = {
        r["id"]: (r["scored"]["response_text"], r["scored"]["call_error"])
        for r in score_prompts(analysis_prompt(df.fillna("", ["content"])), _pure()).collect()
    }
    out = score_distinct(
        df,
        counting_scorer(str(tmp_path)),
        lambda d: analysis_prompt(d.fillna("", ["content"])),
        ["content", "product_category", "rating"],
        hot_share=hot_share,
        base_delay=0.0,
    )
    got = out.collect()
    assert len(got) == 3000
    assert {r["id"]: (r["scored"]["response_text"], r["scored"]["call_error"]) for r in got} == plain
    distinct = df.select("content").distinct().count()
    assert len(os.listdir(tmp_path)) == distinct


def _pure():
    def score(prompt):
        if len(prompt) % 5 == 0:
            raise RuntimeError("down")
        return f"answer {len(prompt)}"

    return score


def test_scored_reviews_with_the_mock(spark):
    df = reviews(spark, 30).fillna("empty", ["content"])
    for distinct in (True, False):
        got = scored_reviews(df, mock_scorer, distinct=distinct).collect()
        assert len(got) == 30
        assert {r["raw_response"] for r in got} == {mock_scorer("")}
        assert {r["call_error"] for r in got} == {None}


def test_refused_rows_cost_no_call(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, " ab ", "books", "4"), (2, None, "books", "4"), (3, "long enough", "books", "4.5"),
         (4, "long enough", "books", None), (5, "long enough", None, " 3 ")],
        "id int, content string, product_category string, rating string",
    )
    for i, distinct in enumerate((True, False)):
        folder = tmp_path / str(i)
        folder.mkdir()
        got = scored_reviews(df, counting_scorer(str(folder)), distinct=distinct, base_delay=0.0)
        asked = [r["id"] for r in got.collect() if r["raw_response"] or r["call_error"]]
        assert sorted(asked) == [4, 5]
        assert len(os.listdir(folder)) == 2


def test_costs_of_shared_calls_add_up(spark):
    def model(prompt):
        return "{}", 1000, 500

    rows = scored_reviews(reviews(spark, 90).fillna("empty", ["content"]), model)
    one = 1000 / 1000 * 0.0008 + 500 / 1000 * 0.0032
    calls = reviews(spark, 90).select("content").distinct().count()
    total = model_cost(rows).agg(F.sum("cost_usd")).first()[0]
    assert abs(total - calls * one) < 1e-9


def test_partitions_bound_the_tasks(spark):
    df = analysis_prompt(reviews(spark, 30).fillna("", ["content"]))
    assert score_prompts(df, mock_scorer, partitions=3).rdd.getNumPartitions() == 3


def test_other_columns_pass_unchanged(spark):
    big = 2**53 + 1
    df = spark.createDataFrame(
        [(1, big, [1.5, None], "a"), (2, None, None, "b")],
        "id int, n long, xs array<double>, prompt string",
    )
    got = {r["id"]: (r["n"], r["xs"]) for r in score_prompts(df, mock_scorer).collect()}
    assert got == {1: (big, [1.5, None]), 2: (None, None)}


def test_call_options_reach_the_scorer(spark):
    def model(prompt, max_tokens):
        return f"{prompt} {max_tokens}"

    df = spark.createDataFrame([("a",)], "prompt string")
    row = score_prompts(df, model, call_options={"max_tokens": 7}).first()
    assert row["scored"]["response_text"] == "a 7"


def test_three_prompts_are_called_once_per_text(spark, tmp_path):
    from reviewgate.plans.analysis import score_aspects

    df = reviews(spark, 90).fillna("", ["content"])
    rows = score_aspects(df, counting_scorer(str(tmp_path)), base_delay=0.0).collect()
    assert len(rows) == 90
    assert len(os.listdir(tmp_path)) == 3 * df.select("content").distinct().count()


def test_scored_rows_are_read_once(spark, tmp_path):
    src = str(tmp_path / "reviews")
    reviews(spark, 300).fillna("", ["content"]).write.parquet(src)
    out = score_distinct(
        spark.read.parquet(src), _pure(), analysis_prompt,
        ["content", "product_category", "rating"], base_delay=0.0,
    )
    assert plan_of(out).count(f"[file:{src}]") == 1
