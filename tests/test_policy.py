import pytest
from pyspark.sql import functions as F

from reviewgate.operators.policy import (
    MAX_POLICY_ROWS,
    PolicySet,
    content_policy,
    policy_entry,
    summary_policy,
    threshold_policy,
    unknown_modes,
)

T, B, H = (
    "TOXICITY_THRESHOLD_EXCEEDED",
    "BIAS_THRESHOLD_EXCEEDED",
    "HALLUCINATION_THRESHOLD_EXCEEDED",
)
R, C = "REGIONAL_COMPLIANCE_VIOLATION", "CATEGORY_RESTRICTION_VIOLATION"
OK = "CONTENT_APPROVED"


def rows(spark, data):
    schema = (
        "toxicity_score double, bias_score double, hallucination_score double, "
        "region string, product_category string, compliance_mode string"
    )
    numbered = [(i, *row) for i, row in enumerate(data)]
    df = spark.createDataFrame(numbered, "id int, " + schema)
    return df.withColumn(
        "analysis", F.struct("toxicity_score", "bias_score", "hallucination_score")
    ).drop("toxicity_score", "bias_score", "hallucination_score")


def results(df):
    return [r.asDict(recursive=True) for r in df.orderBy("id").collect()]


CONTENT = [
    ((2.0, 1.0, 3.0, "us-east-1", "electronics", "standard"), "ALLOW", [OK]),
    ((8.0, 1.0, 3.0, "us-east-1", "electronics", "standard"), "DENY", [T, R, C]),
    ((2.0, 6.0, 3.0, "us-east-1", "electronics", "standard"), "DENY", [B, R, C]),
    ((2.0, 1.0, 8.0, "us-east-1", "electronics", "standard"), "DENY", [H, C]),
    ((8.0, 6.0, 8.0, "us-east-1", "electronics", "standard"), "DENY", [T, B, H, R, R, C, C, C]),
    ((4.0, 1.0, 3.0, "eu-west-1", "electronics", "standard"), "DENY", [R]),
    ((2.0, 0.5, 1.0, "us-east-1", "children_toys", "standard"), "DENY", [C]),
    ((4.0, 1.0, 3.0, "us-east-1", "electronics", "strict"), "DENY", [T]),
    ((6.0, 5.0, 7.0, "us-east-1", "electronics", "mild"), "DENY", [R, R, C, C, C]),
    ((6.0, 5.0, 7.0, "us-west-2", "books", "mild"), "ALLOW", [OK]),
    # A score at its limit passes; an absent score counts as 0.
    ((5.0, 4.0, 6.0, "us-west-2", "books", "standard"), "ALLOW", [OK]),
    ((3.0, 2.0, 4.0, "us-west-2", "books", "strict"), "ALLOW", [OK]),
    ((8.0, 7.0, 8.0, "us-west-2", "books", "mild"), "ALLOW", [OK]),
    ((None, None, None, "us-east-1", "electronics", "strict"), "ALLOW", [OK]),
    ((2.0, 1.0, 3.0, None, None, "standard"), "ALLOW", [OK]),
]


def test_content_policy(spark):
    got = results(content_policy(rows(spark, [x[0] for x in CONTENT])))
    assert [(r["policy_result"]["decision"], r["policy_result"]["reasons"]) for r in got] == [
        (d, reasons) for _, d, reasons in CONTENT
    ]
    assert "Toxicity score 8.0 exceeds threshold 5.0" in got[1]["policy_result"]["explanation"]
    assert got[1]["policy_result"]["explanation"] == (
        "Content policy violations: Toxicity score 8.0 exceeds threshold 5.0; "
        "Regional toxicity limit exceeded for us-east-1; "
        "Category toxicity limit exceeded for electronics"
    )
    assert got[0]["policy_result"]["explanation"] == "Content meets all policy requirements"
    assert got[5]["policy_result"]["metadata"]["context"]["region"] == "eu-west-1"
    assert got[5]["policy_result"]["metadata"]["thresholds_applied"]["bias"] == 4.0


def test_unknown_mode_is_set_aside(spark):
    df = rows(spark, [(1.0, 1.0, 1.0, "us-east-1", "books", m) for m in ("odd", "mild", None)])
    got = results(content_policy(df))
    assert [r["policy_error"] for r in got] == ["UNKNOWN_MODE", None, "UNKNOWN_MODE"]
    assert [r["policy_result"] is None for r in got] == [True, False, True]
    assert [r["id"] for r in results(unknown_modes(df))] == [0, 2]


THRESHOLD = [
    ((2.0, 1.0, 5.0, "standard"), "ALLOW", [OK]),
    ((2.0, 1.0, 5.0, "strict"), "DENY", [H]),
    # A score at its threshold is denied; an absent score counts as 10.
    ((5.0, 4.0, 6.0, "standard"), "DENY", [T, B, H]),
    ((3.0, 2.0, 4.0, "strict"), "DENY", [T, B, H]),
    ((8.0, 7.0, 8.0, "mild"), "DENY", [T, B, H]),
    ((7.9, 6.9, 7.9, "mild"), "ALLOW", [OK]),
    ((None, 1.0, None, "mild"), "DENY", [T, H]),
    ((4.9, 3.9, 5.9, "odd"), "ALLOW", [OK]),
    ((5.0, 3.9, 5.9, None), "DENY", [T]),
]


def test_threshold_policy(spark):
    data = [(*x[0][:3], "us-east-1", "books", x[0][3]) for x in THRESHOLD]
    got = results(threshold_policy(rows(spark, data)))
    assert [(r["policy_result"]["decision"], r["policy_result"]["reasons"]) for r in got] == [
        (d, reasons) for _, d, reasons in THRESHOLD
    ]
    texts = [r["policy_result"]["explanation"] for r in got]
    assert texts[1] == "Content rejected based on strict compliance mode"
    assert texts[7] == "Content approved based on odd compliance mode"
    assert texts[8] == "Content rejected based on standard compliance mode"
    assert got[7]["policy_result"]["thresholds_applied"] == {
        "toxicity": 5.0, "bias": 4.0, "hallucination": 6.0,
    }


def test_summary_policy(spark):
    df = spark.createDataFrame(
        [(0, 2, 10, 8.0), (1, 8, 10, 8.0), (2, 2, 10, 3.0), (3, None, None, None), (4, 5, 0, 9.0),
         (5, 1, 3, 5.0), (6, 2, 3, 4.5)],
        "id int, reviews_excluded int, total_reviews int, quality_score double",
    )
    got = [r["policy_result"] for r in results(summary_policy(df))]
    assert [x["decision"] for x in got] == [
        "ALLOW", "DENY", "DENY", "ALLOW", "ALLOW", "ALLOW", "DENY",
    ]
    assert got[1]["explanation"] == (
        "Summary policy violations: High exclusion rate: 80.00% of reviews excluded"
    )
    assert got[1]["reasons"] == [R]
    assert got[2]["explanation"].endswith("Summary quality score 3.0 below threshold")
    assert got[6]["reasons"] == [R, H]
    assert "66.67%" in got[6]["explanation"]


def test_update_replaces_entries_and_ignores_unknown_types(spark):
    new = PolicySet().updated(
        {
            "toxicity": {"standard": 7.0},
            "regional_compliance": {"eu-west-1": {"max_toxicity": 6.0}},
            "shipping": {"late": 1},
        }
    )
    assert new.policies["toxicity"] == {"mild": 8.0, "standard": 7.0, "strict": 3.0}
    assert "shipping" not in new.policies
    assert PolicySet().policies["toxicity"]["standard"] == 5.0
    df = rows(spark, [(6.5, 3.0, 1.0, "us-west-2", "books", "standard"),
                      (5.5, 3.0, 1.0, "eu-west-1", "books", "standard")])
    assert [r["policy_result"]["decision"] for r in results(content_policy(df, policies=new))] == [
        "ALLOW", "ALLOW",
    ]
    assert [r["policy_result"]["decision"] for r in results(content_policy(df))] == ["DENY", "DENY"]


def test_large_policy_sets_are_joined_without_a_hint(spark, monkeypatch):
    from reviewgate.operators import policy

    df = rows(spark, [(6.5, 3.0, 1.0, "us-west-2", "books", "standard"),
                      (1.0, 1.0, 1.0, "eu-west-1", "books", "mild")])
    want = [r["policy_result"]["decision"] for r in results(content_policy(df))]
    assert PolicySet().hinted(df) is not df
    monkeypatch.setattr(policy, "MAX_POLICY_ROWS", 2)
    assert PolicySet().hinted(df) is df
    assert [r["policy_result"]["decision"] for r in results(content_policy(df))] == want


def test_half_defined_mode_is_an_error_and_own_columns_stay(spark):
    from reviewgate.operators.policy import unknown_modes

    df = rows(spark, [(1.0, 10.0, 10.0, "us-west-2", "books", "new")])
    df = df.withColumn("credit_limit", F.lit(7)).withColumn("x_max_y", F.lit(8))
    for kind in ("toxicity", "bias", "hallucination"):
        half = PolicySet().updated({kind: {"new": 9.0}})
        row = content_policy(df, policies=half).first()
        assert (row["policy_result"], row["policy_error"]) == (None, "UNKNOWN_MODE")
        assert (row["credit_limit"], row["x_max_y"]) == (7, 8)
        assert unknown_modes(df, half).count() == 1


def test_policy_set_is_listed(spark):
    listing = PolicySet().listing(spark).collect()
    assert len(listing) == 24
    assert {r["policy_version"] for r in listing} == {"1.0.0"}
    assert ("regional_compliance", "eu-west-1", "gdpr_required", 1.0) in {
        tuple(r[:4]) for r in listing
    }
    assert PolicySet.load(PolicySet().listing(spark)) == PolicySet()
    huge = spark.range(3 * MAX_POLICY_ROWS + 5).selectExpr(
        "'toxicity' AS policy_type", "cast(id AS string) AS policy_key",
        "'threshold' AS limit_name", "1D AS limit_value",
    )
    with pytest.raises(ValueError):
        PolicySet.load(huge)


def test_policy_entry(spark):
    base = rows(
        spark,
        [(2.0, 1.0, 3.0, None, None, None), (9.0, 1.0, 1.0, "us-east-1", "books", "strict"),
         (1.0, 1.0, 1.0, None, None, None), (1.0, 1.0, 1.0, None, None, "odd")],
    )
    extra = spark.createDataFrame(
        [(0, None, None, None, None), (1, "summary", 8, 10, 8.0), (2, "invalid_type", 1, 2, 1.0),
         (3, "content", None, None, None)],
        "id int, validation_type string, reviews_excluded int, total_reviews int, "
        "quality_score double",
    )
    got = results(policy_entry(base.join(extra, "id")))
    assert got[0]["policy_result"]["decision"] == "ALLOW"
    assert (got[0]["region"], got[0]["product_category"], got[0]["compliance_mode"]) == (
        "us-east-1", "general", "standard",
    )
    assert "High exclusion rate" in got[1]["policy_result"]["explanation"]
    assert got[2]["policy_result"] is None
    assert got[2]["error"] == "Unknown validation type: invalid_type"
    assert got[3]["error"] == "UNKNOWN_MODE"
