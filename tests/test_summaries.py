from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import plan_of
from reviewgate.operators import summaries as S
from reviewgate.plans.summaries import stored_summaries, summarise_products

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "product_id string, review_id string, content string, rating string, "
    "timestamp timestamp, analysis_passed boolean, toxicity_score double"
)


def reviews(spark):
    rows = [
        ("p", "r1", "Great product, highly recommend it.", "5", T0, True, 1.0),
        ("p", "r2", "Good value for money.", "4", T0 + timedelta(1), None, 2.0),
        ("p", "r3", "Terrible product.", "1", T0 + timedelta(2), False, 8.0),
        ("bad", "r4", "Awful thing here", "1", T0, False, 9.0),
    ]
    rows += [
        ("hot", f"h{i:04d}", f"text {i}", str(1 + i % 5), T0 + timedelta(minutes=i % 40), True, 0.0)
        for i in range(400)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_statistics(spark):
    got = {r["product_id"]: r for r in S.product_stats(reviews(spark)).collect()}
    assert tuple(got["p"])[1:] == (3, 2, 1, 4.5, 0)
    assert tuple(got["bad"])[1:] == (1, 0, 1, 0.0, 0)
    assert tuple(got["hot"])[1:] == (400, 400, 0, 3.0, 0)
    rejected = S.rejected_products(S.product_stats(reviews(spark))).collect()
    assert [(r["product_id"], r["exclusion_reasons"], r["sentiment"]) for r in rejected] == [
        ("bad", ["ALL_REVIEWS_REJECTED"], "neutral")
    ]


def test_prompt_lists_the_first_ten_reviews(spark):
    got = {r["product_id"]: r["prompt"] for r in S.summary_prompts(reviews(spark)).collect()}
    assert got["bad"] is None
    assert (
        # The ratings of these reviews arrived as text.
        "Rating: 5.0/5 - Great product, highly recommend it.\n"
        "Rating: 4.0/5 - Good value for money."
        in got["p"]
    )
    assert "Analyze these 2 customer reviews for product p" in got["p"]
    assert "AVERAGE RATING: 4.5/5" in got["p"]
    first = sorted(
        ((i % 40, f"h{i:04d}", i) for i in range(400))
    )[:10]
    lines = "\n".join(f"Rating: {1 + i % 5}.0/5 - text {i}" for _, _, i in first)
    assert f"REVIEWS TO ANALYZE:\n{lines}\n\nAVERAGE" in got["hot"]
    tree = plan_of(S.review_lines(reviews(spark)))
    assert "WindowGroupLimit" in tree


def test_read_summaries(spark):
    texts = [
        '{"summary": "s", "sentiment": "positive", "key_themes": ["a"], "confidence": 1}',
        "```json\n{}\n```",
        "nonsense",
        "[1]",
        '{"summary": null, "confidence": 0.25}',
        None,
    ]
    df = spark.createDataFrame(
        [(i, t, "down" if t is None else None) for i, t in enumerate(texts)],
        "id int, summary_response string, failed string",
    )
    got = [
        (r["summary"], r["sentiment"], r["confidence"], r["key_themes"], r["status_code"])
        for r in S.parse_summary(df, call_error="failed").orderBy("id").collect()
    ]
    assert got == [
        ("s", "positive", 1.0, ["a"], 200),
        ("Summary generation completed.", "mixed", 0.5, [], 200),
        ("Customer reviews provide mixed feedback about this product.", "mixed", 0.5,
         ["quality", "value", "functionality"], 200),
        ("Summary generation failed due to system error", None, None, [], 500),
        (None, "mixed", 0.25, [], 200),
        ("Unable to generate summary due to system error: down", "mixed", 0.0,
         ["system_error"], 200),
    ]


def test_constrained_summary(spark):
    texts = [
        'Here: {"summary": "Solid.", "confidence": 0.8, "sources_used": 3, '
        '"excluded_content": ["insult"]} Bye.',
        "nothing",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, summary_response string")
    a, b = S.read_constrained_summary(df).orderBy("id").collect()
    assert (a["summary"], a["confidence"], a["sources_used"], a["excluded_content"]) == (
        "Solid.", 0.8, 3, ["insult"],
    )
    assert (b["error"], b["raw_content"]) == ("Failed to parse model response", "nothing")


def test_missing_products_and_system_error(spark):
    products = spark.createDataFrame([("p",), ("new",)], "product_id string")
    got = S.products_without_reviews(products, reviews(spark)).collect()
    assert [tuple(r) for r in got] == [
        ("new", 400, "No reviews provided for summarization")
    ]
    row = products.select(S.system_error_record(F.col("product_id"), F.lit("x")).alias("e")).first()
    assert row["e"]["exclusion_reasons"] == ["SYSTEM_ERROR"] and row["e"]["status_code"] == 500


def test_exclusion_reasons(spark):
    rows = [
        ("p", "1", "Good", "5", T0, True, None),
        ("p", "2", "A" * 2500, "4", T0, True, None),
        ("p", "3", "Perfect length review", "5", T0, True, 2.0),
        ("p", "4", "Terrible product", "1", T0, True, 8.0),
        ("p", "5", "x", "1", T0, False, 9.0),
    ]
    df = S.exclusion_reasons(spark.createDataFrame(rows, SCHEMA)).orderBy("review_id")
    assert [r["exclusion_reasons"] for r in df.collect()] == [
        ["CONTENT_TOO_SHORT"], ["CONTENT_TOO_LONG"], [], ["HIGH_TOXICITY"],
        ["FAILED_POLICY_ANALYSIS", "HIGH_TOXICITY", "CONTENT_TOO_SHORT"],
    ]


def test_fallback_and_minimum(spark):
    stats = S.product_stats(reviews(spark))
    text = {r["product_id"]: r["summary"] for r in S.fallback_summary(stats).collect()}
    assert "2 reviews" in text["p"] and "4.5 stars" in text["p"]
    assert text["bad"] == "No reviews available for summarization."
    few = {r["product_id"]: r for r in S.enough_reviews(stats, 2).collect()}
    assert "Insufficient reviews" in few["bad"]["summary"] and few["bad"]["quality_score"] == 0.0
    assert few["p"]["summary"] is None


def test_summarise_products(spark):
    def model(prompt):
        if "product hot" in prompt:
            raise RuntimeError("busy")
        return '{"summary": "Liked.", "sentiment": "positive", "confidence": 0.9}'

    odd = [("odd", "o1", "Fine enough", "six", T0, True, 1.0),
           ("whole", "w1", "Fine enough", "4", T0, True, 1.0)]
    mixed = reviews(spark).unionByName(spark.createDataFrame(odd, SCHEMA))
    rows = summarise_products(mixed, model, base_delay=0.0)
    got = {r["product_id"]: r for r in rows.collect()}
    assert set(got) == {"p", "bad", "hot", "odd", "whole"}
    assert got["odd"]["summary"] == "Summary generation failed due to system error"
    assert (got["odd"]["reviews_processed"], got["odd"]["exclusion_reasons"]) == (
        0, ["SYSTEM_ERROR"],
    )
    whole = mixed.filter("product_id = 'whole'").withColumn("rating", F.lit(4))
    assert "Rating: 4/5 - Fine enough" in S.summary_prompts(whole).first()["prompt"]
    assert (got["p"]["summary"], got["p"]["average_rating"]) == ("Liked.", 4.5)
    assert got["hot"]["summary"] == "Unable to generate summary due to system error: busy"
    assert got["bad"]["exclusion_reasons"] == ["ALL_REVIEWS_REJECTED"]
    assert not got["bad"]["ai_generated"] and got["p"]["ai_generated"]
    assert stored_summaries(rows, "run-1").count() == 5


def test_parts_hold_every_review_and_are_bounded(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5)).alias(
            "product_id"
        ),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("review_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"),
        F.lit(4).alias("rating"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
        (F.col("id") % 7 != 0).alias("analysis_passed"),
    )
    parts = S.review_parts(rows, part_chars=2000).collect()
    lines = [x for p in parts for x in p["reviews_content"].split("\n")]
    want = [f"Rating: 4/5 - text {i}" for i in range(3000) if i % 7]
    assert sorted(lines) == sorted(want)
    assert max(len(p["reviews_content"]) for p in parts) < 4000
    assert len({p["part"] for p in parts if p["product_id"] == "hot"}) > 5
