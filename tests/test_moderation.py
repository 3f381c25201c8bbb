"""The whole flow, its documented examples, and the shape of its plan."""

from datetime import datetime

from pyspark.sql import functions as F

from checks import fixtures as X
from conftest import plan_of
from reviewgate.operators.routing import error_fallbacks, route_approved, route_rejected
from reviewgate.operators.policy import threshold_policy
from reviewgate.plans.moderation import decide, moderate, prepare_input, run_moderation
from reviewgate.session import scratch_root

NOW = datetime(2024, 5, 1)
TERRIBLE = "This product is terrible! It broke immediately and the company refuses to help."
FIELDS = (
    "review_id string, product_id string, user_id string, content string, rating string, "
    "region string, product_category string, compliance_mode string"
)


def model():
    def score(prompt):
        t, b, h = (2, 1, 5) if "terrible" in prompt else (0, 0, 0)
        return f'{{"toxicity_score": {t}, "bias_score": {b}, "hallucination_score": {h}}}'

    return score


def submitted(spark):
    def row(i, content, mode, rating="4"):
        return (f"r{i}", f"test-product-{i:03d}", f"test-user-{i:03d}", content, rating,
                "us-east-1", "electronics", mode)

    return spark.createDataFrame(
        [
            row(1, "Great product! Works well and arrived quickly. Good value for money.", "standard"),
            row(2, TERRIBLE, "standard", "1"),
            row(3, TERRIBLE, "strict", "1"),
            row(4, "Short", "standard"),
        ],
        FIELDS,
    )


def test_documented_examples(spark, tmp_path):
    out = run_moderation(
        submitted(spark), model(), str(tmp_path), run_id="day-1", entered_at=NOW, base_delay=0.0
    )
    got = {r["review_id"]: r.asDict(recursive=True) for r in out["responses"].collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert (got["r1"]["result"], got["r1"]["policy_decision"]) == ("SUCCESS", "APPROVED")
    assert got["r1"]["policy_reasons"] == ["CONTENT_APPROVED"]
    assert got["r2"]["analysis_summary"] == {
        "toxicity_score": 2.0, "bias_score": 1.0, "hallucination_score": 5.0,
    }
    assert got["r2"]["policy_decision"] == "APPROVED"
    assert (got["r3"]["result"], got["r3"]["policy_decision"]) == ("REJECTED", "DENIED")
    assert got["r3"]["policy_reasons"] == ["HALLUCINATION_THRESHOLD_EXCEEDED"]
    assert got["r3"]["rejection_explanation"] == "Content rejected based on strict compliance mode"
    assert got["r3"]["processing_metadata"]["execution_id"] == "day-1"
    dead = out["dead_letters"].collect()
    assert [r["errors"] for r in dead] == [["content"]]
    events = {r["review_id"]: r["event_type"] for r in out["audit"].collect()}
    assert events == {"r1": "ANALYSIS", "r2": "ANALYSIS", "r3": "POLICY_DECISION"}
    metadata = out["audit"].select("model_metadata.*").collect()
    assert {r["prompt_version"] for r in metadata} == {"2.0"}
    # A second run under the same id leaves one copy of everything.
    again = run_moderation(
        submitted(spark), model(), str(tmp_path), run_id="day-1", entered_at=NOW, base_delay=0.0
    )
    assert spark.read.parquet(f"{tmp_path}/audit").count() == again["responses"].count() == 3


def test_each_approved_review_gets_a_summary(spark, tmp_path):
    def summary_model(prompt):
        assert "Analyze these 1 customer reviews" in prompt
        return '{"summary": "Short and kind."}' if "Great" in prompt else "garbage"

    out = run_moderation(
        submitted(spark), model(), str(tmp_path), run_id="day-1", entered_at=NOW,
        base_delay=0.0, summary_scorer=summary_model,
    )
    got = {r["review_id"]: r["summary"] for r in out["responses"].collect()}
    assert got == {
        "r1": "Short and kind.",
        "r2": "Customer reviews provide mixed feedback about this product.",
        "r3": None,
    }


def test_routes_cover_every_row(spark, sf):
    decided = X.decided(X.reviews(spark, sf))
    missing = decided.withColumn(
        "policy_result", F.when(F.col("review_id") != "rev-0", F.col("policy_result"))
    )
    a, r = route_approved(missing), route_rejected(missing)
    assert a.count() + r.count() == missing.count()
    assert r.filter("review_id = 'rev-0'").count() == 1


def test_moderation_has_no_shuffle(spark, sf):
    prepared = prepare_input(
        X.with_responses(X.reviews(spark, sf)), F.col("timestamp"), "run", ["raw_response"]
    )
    plan = plan_of(moderate(prepared))
    tree = plan[: plan.index("\n\n\n")]
    assert tree.count("Scan parquet") == 1
    assert tree.replace("BroadcastExchange", "").count("Exchange") == 0
    assert "Python" not in tree
    decisions = decide(prepared).select("review_id", "policy_result.decision")
    schema = plan_of(decisions).split("ReadSchema:")[1].split("\n")[0]
    assert "source" not in schema and "lang" not in schema


def test_fallbacks(spark, sf):
    rows = threshold_policy(X.analysis_of(X.reviews(spark, sf))).withColumn(
        "summary", F.lit("fine")
    )
    k = F.col("k")
    got = error_fallbacks(rows, k == 0, k == 1, k == 2).filter(k < 4).orderBy("k").collect()
    assert got[0]["analysis"]["bias_score"] == 10.0
    assert got[0]["error_type"] == "ANALYSIS_FAILED"
    assert got[1]["policy_result"]["reasons"] == ["SYSTEM_ERROR"]
    assert got[1]["policy_result"]["explanation"] == "Policy validation failed - defaulting to deny"
    assert got[2]["summary"] == "Summary generation failed"
    assert got[2]["summary_metadata"]["exclusion_reasons"] == ["SYSTEM_ERROR"]
    assert got[3]["summary"] == "fine" and got[3]["summary_metadata"] is None


def test_scratch_is_the_session_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_root(spark) == configured.rstrip("/")
    else:
        assert scratch_root(spark) == scratch_root(spark)
