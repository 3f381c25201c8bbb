"""Trees of summaries: parts, parts of parts, one row per product."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from reviewgate.operators import summaries as S
from reviewgate.plans.summaries import summarise_products, summarise_tree


@pytest.fixture(scope="module")
def many(spark):
    """A third of 900 reviews in one product, one product with a single review."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") == 1, "single")
        .otherwise(F.concat(F.lit("p"), F.col("id") % 5))
        .alias("product_id"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"),
        F.concat(F.lit("text\nof "), F.col("id").cast("string")).alias("content"),
        F.lit(4).alias("rating"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
        (F.col("id") % 7 != 0).alias("analysis_passed"),
    )
    return rows


def counter(calls=None, fails=lambda prompt: False):
    """Adds up reviews; notes each call in a folder that tasks share."""

    def summarise(prompt, max_tokens):
        import os
        import uuid

        if calls:
            with open(os.path.join(calls, uuid.uuid4().hex), "w") as out:
                out.write(prompt)
        if fails(prompt):
            raise RuntimeError("busy")
        below = re.findall(r"(?m)^Summary of (\d+) reviews: \1 reviews$", prompt)
        n = sum(map(int, below)) or len(re.findall(r"(?m)^Rating: \d/5 - ", prompt))
        return json.dumps({"summary": f"{n} reviews", "confidence": 0.5, "sources_used": n})

    return summarise


def wanted(many):
    rows = many.filter("analysis_passed").groupBy("product_id").count().collect()
    return {r["product_id"]: r["count"] for r in rows}


@pytest.mark.parametrize(("part_chars", "fan_in"), [(100_000, 10), (400, 2), (150, 7)])
def test_one_row_per_product_for_any_part_size(many, part_chars, fan_in):
    rows = summarise_tree(many, counter(), part_chars=part_chars, fan_in=fan_in).collect()
    want = wanted(many)
    assert {r.product_id: r.sources_used for r in rows} == want and len(rows) == len(want)
    assert {r.product_id: r.summary for r in rows} == {p: f"{n} reviews" for p, n in want.items()}
    assert {r.failed_parts for r in rows} == {0} and {r.error for r in rows} == {None}


def test_calls_and_groups_are_bounded(many, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    parts = S.review_parts(many, 300).groupBy("product_id").count().collect()
    summarise_tree(many, counter(str(calls)), part_chars=300, fan_in=3).collect()
    prompts = [x.read_text() for x in calls.iterdir()]
    above = [x for x in prompts if "\nSummary of " in x]
    assert len(prompts) - len(above) == sum(r["count"] for r in parts)
    assert max(len(re.findall(r"(?m)^Summary of", x)) for x in above) <= 3
    assert min(len(re.findall(r"(?m)^Summary of", x)) for x in above) >= 2
    # Every part is read once, however many levels there are.
    most = max(r["count"] for r in parts)
    assert most > 9 and len(above) <= sum(math.ceil(r["count"] / 2) for r in parts)


def test_lost_parts_are_counted_and_left_out(many):
    fails = lambda prompt: "of 45\n" in prompt
    hot = many.filter("product_id = 'hot'")
    row = summarise_tree(hot, counter(fails=fails), part_chars=300, fan_in=4, base_delay=0.0).first()
    lost = [
        r.reviews_content
        for r in S.review_parts(hot, 300).collect()
        if "of 45\n" in r.reviews_content + "\n"
    ]
    gone = len(re.findall("(?m)^Rating", lost[0]))
    assert (row.failed_parts, row.error, row.call_error) == (1, None, None)
    assert row.sources_used == wanted(many)["hot"] - gone
    none = summarise_tree(hot, counter(fails=lambda p: True), part_chars=300, fan_in=4).first()
    assert none.failed_parts == none.n_parts > 4 and none.summary is None
    assert none.call_error == "busy"


def test_tree_of_nothing(many):
    assert summarise_tree(many.limit(0), counter()).collect() == []
    assert summarise_tree(many.filter("not analysis_passed"), counter()).collect() == []


def test_products_read_their_prompts_once(many, monkeypatch):
    """One scoring stage over all prompts; nothing is computed for a second branch."""
    from reviewgate.plans import summaries as plans

    seen = []
    real = plans.score_prompts
    monkeypatch.setattr(
        plans, "score_prompts", lambda df, *a, **k: seen.append(df) or real(df, *a, **k)
    )
    model = lambda prompt: '{"summary": "x"}'
    summarise_products(many, model).collect()
    assert len(seen) == 1
    # Unfiltered: products without a prompt go along.
    assert seen[0].filter("prompt is null").count() + seen[0].filter("prompt is not null").count() == 7
