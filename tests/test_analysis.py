from pyspark.sql import functions as F

from reviewgate.functions.numbers import call_cost, clamp
from reviewgate.functions.text import fixed, isoformat, rounded
from reviewgate.operators import analysis, prompts
from reviewgate.operators.scoring import mock_scores, model_cost

ASPECTS = ["toxicity", "bias", "hallucination"]


def with_scores(spark, data):
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(data)],
        "id int, toxicity_score double, bias_score double, hallucination_score double",
    )
    return df.withColumn("analysis", F.struct(*[f"{a}_score" for a in ASPECTS]))


def test_risk_summary(spark):
    df = with_scores(
        spark, [(6.5, 2.1, 3.8), (1.5, 0.8, 2.2), (8.0, 3.0, 6.0), (3.0, 1.0, 1.0), (2.5, 1.2, 3.1)]
    )
    got = [r["risk"] for r in analysis.risk_summary(df).orderBy("id").collect()]
    assert (got[0]["risk_level"], got[0]["max_score"]) == ("MEDIUM", 6.5)
    assert got[0]["threshold_violations"] == ["toxicity (6.5 > 5.0)"]
    assert not got[0]["should_approve"]
    assert got[1].asDict(recursive=True) == {
        "risk_level": "MINIMAL", "max_score": 2.2, "threshold_violations": [],
        "should_approve": True, "confidence_scores": {},
        "scores": {"toxicity": 1.5, "bias": 0.8, "hallucination": 2.2},
    }
    # A score at its threshold does not exceed it.
    assert (got[2]["risk_level"], got[2]["threshold_violations"]) == ("HIGH", ["toxicity (8.0 > 5.0)"])
    assert [x["risk_level"] for x in got[3:]] == ["LOW", "LOW"]


def test_thresholds_are_clamped():
    assert analysis.update_thresholds(toxicity=-1, bias=15) == {
        "toxicity": 0.0, "bias": 10.0, "hallucination": 6.0,
    }
    assert analysis.update_thresholds()["bias"] == 3.0


def aspects(spark, rows):
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "id int, toxicity_response string, bias_response string, hallucination_response string",
    )


def test_comprehensive_and_batch(spark):
    ok = '{"%s_score": 4.5, "explanation": "why", "confidence": 0.9}'
    bias, hall = ok % "bias", ok % "hallucination"
    rows = [
        ('{"toxicity_score": 15.0, "detected_issues": ["x", "y"]}', bias, hall),
        ('{"toxicity_score": "7"}', "not json", hall),
        ('{"toxicity_score": null}', bias, hall),
        ('{"toxicity_score": "high"}', bias, hall),
        ('{"toxicity_score": 1, "confidence": "low"}', bias, hall),
        ("[1]", bias, hall),
        ("{}", "{}", "{}"),
    ]
    df = analysis.comprehensive_analysis(aspects(spark, rows))
    got = [r.asDict(recursive=True) for r in df.orderBy("id").collect()]
    first = got[0]["analysis"]
    assert first["toxicity_score"] == 10.0 and got[0]["toxicity"]["threshold_exceeded"]
    assert got[0]["toxicity"]["detected_issues"] == ["x", "y"]
    assert first["explanations"] == {
        "toxicity": "No explanation provided", "bias": "why", "hallucination": "why",
    }
    assert first["confidence_scores"] == {"toxicity": 0.5, "bias": 0.9, "hallucination": 0.9}
    assert got[0]["bias"]["threshold_exceeded"]
    assert (got[1]["analysis"]["toxicity_score"], got[1]["analysis"]["bias_score"]) == (7.0, 0.0)
    assert got[1]["bias"]["problematic_phrases"] == []
    prefix = "Unexpected error in toxicity analysis: "
    assert [r["analysis_error"] for r in got[2:6]] == [
        prefix + "float() argument must be a string or a real number, not 'NoneType'",
        prefix + "could not convert string to float: 'high'",
        prefix + "could not convert string to float: 'low'",
        prefix + "'list' object does not support item assignment",
    ]
    assert all(r["analysis"] is None for r in got[2:6])
    assert got[6]["analysis"]["bias_score"] == 0.0
    batch = analysis.batch_analysis(aspects(spark, rows)).orderBy("id").collect()
    assert batch[3]["analysis"]["bias_score"] == 0.0
    assert batch[3]["analysis"]["explanations"]["bias"] == (
        "Analysis failed: " + prefix + "could not convert string to float: 'high'"
    )
    assert batch[0]["analysis"]["toxicity_score"] == 10.0


def test_call_errors_and_review_notes(spark):
    df = aspects(spark, [("{}", None, "{}"), ('{"toxicity_score": 9.26}', "{}", "{}"), ("{}",) * 3])
    df = df.withColumns(
        {
            "bias_failed": F.when(F.col("id") == 0, "timeout"),
            "status": F.lit("PENDING"),
            "processing_errors": F.array(F.lit("old")),
        }
    )
    got = analysis.analyze_reviews(df, call_errors={"bias": "bias_failed"}).orderBy("id").collect()
    assert [r["processing_errors"] for r in got] == [
        ["Analysis failed: Failed to analyze bias: timeout"],
        ["Policy violations: toxicity (9.3 > 5.0)"],
        ["old"],
    ]
    assert {r["status"] for r in got} == {"PENDING"}


def test_fill_explanations_clamp_cost(spark):
    df = spark.createDataFrame(
        [(0, {"bias": "b", "other": "o"}, 15.0), (1, None, -3.0), (2, {}, None)],
        "id int, m map<string,string>, x double",
    )
    got = df.select(
        analysis.fill_explanations(F.col("m")).alias("m"), clamp(F.col("x")).alias("x")
    ).collect()
    assert got[0]["m"] == {
        "bias": "b", "other": "o", "toxicity": "No explanation provided",
        "hallucination": "No explanation provided",
    }
    assert got[1]["m"] == {a: "No explanation provided" for a in ASPECTS}
    assert [r["x"] for r in got] == [10.0, 0.0, 0.0]
    tokens = spark.createDataFrame([(1000, 500), (None, None)], "input_tokens int, output_tokens int")
    costs = [r[0] for r in tokens.select(call_cost(F.col("input_tokens"), F.col("output_tokens"))).collect()]
    assert costs == [1000 / 1000 * 0.0008 + 500 / 1000 * 0.0032, 0.0]
    assert model_cost(tokens).first()["model_metadata"]["inference_config"]["maxTokens"] == "1000"
    assert mock_scores(tokens).first()["analysis"]["toxicity_score"] == 1.0


def test_number_texts_round_like_python(spark):
    values = [0.25, 0.35, 0.45, 2.675, 95.125, 1.005, 0.5, 1e-7, 12345.675, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(
        fixed(F.col("x"), 1), fixed(F.col("x"), 2), rounded(F.col("x"), 2)
    ).collect()
    assert [tuple(r) for r in got] == [(f"{v:.1f}", f"{v:.2f}", round(v, 2)) for v in values]


def test_isoformat(spark):
    from datetime import datetime

    times = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120), datetime(1969, 12, 31)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, t timestamp")
    got = df.select(isoformat(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.isoformat() for t in times]


def test_prompts_take_texts_literally(spark):
    tricky = 'He said "{rating}" and {content} cost $1 \\1'
    df = spark.createDataFrame([(tricky, None, None), ("x", "toys", 2)],
                               "content string, product_category string, rating int")
    a, b = prompts.analysis_prompt(df).collect()
    assert f'Product Category: other\nRating: 3/5\nContent: "{tricky}"\n' in a["prompt"]
    assert 'Product Category: toys\nRating: 2/5\nContent: "x"' in b["prompt"]
    assert b["prompt"].endswith('"hallucination": "<brief explanation>"\n  }\n}')
    one = prompts.aspect_prompts(df).first()
    assert all(f'Review to analyze: "{tricky}"' in one[f"{x}_prompt"] for x in ASPECTS)
    text = prompts.constrained_prompt(df.withColumnRenamed("content", "reviews_content"), 4.5).first()
    assert "Maximum toxicity score allowed: 4.5\n- Maximum bias score allowed: 3.0" in text["prompt"]
    assert text["max_tokens"] == 1500
