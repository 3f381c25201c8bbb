import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from reviewgate.operators.audit import approved, audit_records, expire_audit
from reviewgate.plans import reports
from reviewgate.schemas import AUDIT_EVENT
from reviewgate.sources import tables

START, END = "2024-01-01T00:00:00Z", "2024-01-31T23:59:59Z"
BASE = datetime(2024, 1, 1)


def event(i, kind="ANALYSIS", decision="ALLOW", reasons=None, at=None, **more):
    reasons = reasons or ["CONTENT_APPROVED"]
    row = dict.fromkeys(AUDIT_EVENT.fieldNames())
    row |= {
        "audit_id": f"a{i:04d}",
        "timestamp": at or BASE + timedelta(minutes=i),
        "event_type": kind,
        "review_id": f"r{i}",
        "user_id": f"u{i % 7}",
        "product_id": f"p{i % 3}",
        "region": "us-east-1",
        "processing_duration_ms": 1500,
        "policy_decision": {
            "approved": None, "policy_violations": [] if decision == "ALLOW" else reasons,
            "decision_rationale": "", "policy_version": "1.0.0", "evaluated_rules": [],
            "decision": decision, "reasons": reasons, "explanation": "",
        },
        "analysis_results": {
            "toxicity_score": float(i % 10), "bias_score": None, "hallucination_score": 2.0,
            "explanations": {}, "confidence_scores": None,
        },
        "model_metadata": {
            "model_id": "m", "prompt_version": "1", "inference_config": {},
            "processing_time_ms": 1, "cost_usd": 0.005,
        },
    }
    return row | more


def log(spark, events):
    df = spark.createDataFrame(
        [tuple(e[n] for n in AUDIT_EVENT.fieldNames()) for e in events], AUDIT_EVENT
    )
    return df.withColumn("event_date", F.to_date("timestamp"))


def hundred(spark):
    return log(
        spark,
        [event(i) for i in range(80)]
        + [
            event(i, "POLICY_DECISION", "DENY", ["TOXICITY_THRESHOLD_EXCEEDED"])
            for i in range(80, 85)
        ]
        + [event(i, "POLICY_DECISION") for i in range(85, 100)],
    )


def test_compliance_summary(spark):
    row = reports.compliance_summary(reports.audit_statistics(hundred(spark), START, END)).first()
    assert row["summary"].asDict() == {
        "total_records": 100, "compliance_rate_percent": 95.0, "policy_violations": 5,
        "average_processing_time_ms": 1500.0, "total_cost_usd": 0.5,
    }
    assert row["event_breakdown"] == {"ANALYSIS": 80, "POLICY_DECISION": 20}
    assert row["compliance_metrics"]["rejection_rate_percent"] == 5.0
    assert row["performance_metrics"]["total_processing_time_ms"] == 150000.0
    assert row["performance_metrics"]["cost_per_event_usd"] == 0.005


def test_empty_period(spark):
    stats = reports.audit_statistics(hundred(spark), "2030-01-01", "2030-02-01")
    assert stats.first()["total_events"] == 0
    row = reports.compliance_summary(stats).first()
    assert row["summary"]["compliance_rate_percent"] == 100.0
    assert row["compliance_metrics"]["rejection_rate_percent"] == 0.0
    assert row["event_breakdown"] == {}
    row = reports.processing_stats(hundred(spark), "2030-01-01", "2030-02-01").first()
    assert row["processing_performance"]["processing_times_ms"].asDict() == {
        "min": 0.0, "max": 0.0, "avg": 0.0, "count": 0,
    }
    empty = reports.violations(hundred(spark), "2030-01-01", "2030-02-01")
    assert tuple(reports.violations_summary(empty).first()) == (0, 0, 0, 0)


def test_both_ends_are_inside(spark):
    df = log(
        spark,
        [event(0, at=BASE), event(1, at=datetime(2024, 1, 31, 23, 59, 59)),
         event(2, at=datetime(2024, 2, 1))],
    )
    assert reports.audit_statistics(df, START, END).first()["total_events"] == 2
    # 01:00 at +02:00 is 23:00 of the day before in UTC.
    assert reports.parse_date("2024-01-01T01:00:00+02:00") == datetime(2023, 12, 31, 23)


def violations_log(spark):
    two = ["BIAS_THRESHOLD_EXCEEDED", "TOXICITY_THRESHOLD_EXCEEDED"]
    return log(
        spark,
        [event(i, "POLICY_DECISION", "DENY", two if i % 2 else two[:1]) for i in range(250)]
        + [event(300, "POLICY_DECISION"), event(301, "ANALYSIS", "DENY", two)],
    )


def test_violations(spark):
    rows = reports.violations(violations_log(spark), START, END)
    assert tuple(reports.violations_summary(rows).first()) == (250, 3, 7, 2)
    top = reports.top_violation_types(reports.violation_breakdown(rows)).collect()
    assert [tuple(r) for r in top] == [
        ("BIAS_THRESHOLD_EXCEEDED", 250), ("TOXICITY_THRESHOLD_EXCEEDED", 125),
    ]
    detail = reports.violations_detail(rows).collect()
    assert [r["event_id"] for r in detail] == [f"a{i:04d}" for i in range(249, 149, -1)]
    only = reports.violations(violations_log(spark), START, END, product_id="p1", user_id="u3")
    assert only.count() == sum(i % 3 == 1 and i % 7 == 3 for i in range(250))
    capped = reports.violations(violations_log(spark), START, END, cap=10)
    assert capped.count() == 9  # the newest decision of the ten is an approval


def test_processing_stats(spark):
    df = log(
        spark,
        [event(i, processing_duration_ms=i) for i in range(11)]
        + [event(50, "POLICY_DECISION", processing_duration_ms=9999)]
        + [event(51, analysis_results=None, processing_duration_ms=0)],
    )
    for cap in (None, 1000):
        row = reports.processing_stats(df, START, END, cap=cap).first()
        times = row["processing_performance"]["processing_times_ms"]
        assert times.asDict() == {"min": 1.0, "max": 10.0, "avg": 5.5, "count": 10}
        assert row["content_analysis_scores"]["bias_scores"].asDict() == {
            "min": 0.0, "max": 0.0, "avg": 0.0, "count": 11,
        }
        assert row["summary"].asDict() == {
            "total_events_processed": 12, "date_range_days": 30, "events_per_day": 12 / 30,
        }
        assert row["processing_performance"]["total_cost_usd"] == 0.065
        assert row["event_type_distribution"] == {"ANALYSIS": 12, "POLICY_DECISION": 1}
    few = reports.processing_stats(df, START, END, product_id="p0", apply_filters=True).first()
    assert few["summary"]["total_events_processed"] == 5
    same = reports.processing_stats(df, START, END, product_id="p0").first()
    assert same["summary"]["total_events_processed"] == 12


def test_one_scan_per_statistics(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_audit(hundred(spark), path, "1")
    stored = tables.read_audit(spark, path)
    for df in (
        reports.audit_statistics(stored, START, END),
        reports.processing_stats(stored, START, END),
    ):
        plan = plan_of(df)
        tree = plan[: plan.index("\n\n\n")]
        assert tree.count("Scan parquet") == 1
        assert "PartitionFilters: [isnotnull(event_date" in plan
        # Only the needed columns are read.
        assert "review_id" not in plan.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize("kind", ["compliance_summary", "policy_violations", "processing_stats"])
def test_report_files(spark, tmp_path, kind):
    report = reports.build_report(
        violations_log(spark), kind, START, END, generated_at=datetime(2024, 2, 2)
    )
    row = tables.write_report(report, str(tmp_path)).first()
    assert row["report_url"] == f"{tmp_path}/reports/{kind}/{row['report_id']}.json"
    text = "\n".join(r[0] for r in spark.read.text(row["report_url"]).collect())
    assert len(text.encode()) == row["report_size_bytes"]
    data = json.loads(text)
    assert data["report_metadata"]["report_id"] == row["report_id"]
    assert data["report_metadata"]["period"]["start_date"] == "2024-01-01T00:00:00"
    assert row["records_processed"] == (252 if kind == "compliance_summary" else 0)
    if kind == "policy_violations":
        assert data["summary"]["total_violations"] == 250
        assert len(data["violations"]) == 100
        assert data["violations"][0]["event_id"] == "a0249"
        assert data["violations"][0]["analysis_scores"]["bias"] == 0.0
        assert [x["violations"] for x in data["top_violation_types"]] == [250, 125]


def test_report_errors(spark):
    with pytest.raises(ValueError, match="start_date and end_date are required"):
        reports.build_report(hundred(spark), "compliance_summary")
    with pytest.raises(ValueError, match="Unknown report type: weekly"):
        reports.build_report(hundred(spark), "weekly", START, END)


def test_audit_records_and_expiry(spark):
    df = spark.createDataFrame(
        [("r1", "u", "p", None, ("DENY", ["X"], "why")), (None, None, None, "eu-west-1", None)],
        "review_id string, user_id string, product_id string, region string, "
        "policy_result struct<decision:string,reasons:array<string>,explanation:string>",
    ).withColumn("analysis", F.lit(None).cast(AUDIT_EVENT["analysis_results"].dataType))
    time = F.lit("2024-01-01 10:20:30").cast("timestamp")
    a, b = audit_records(df, event_time=time).orderBy("review_id").collect()
    assert a["audit_id"].startswith("audit-20240101-102030-") and len(a["audit_id"]) == 30
    assert a["event_type"] == b["event_type"] == "POLICY_DECISION"
    assert (b["review_id"], b["user_id"], b["region"]) == ("unknown", "unknown", "eu-west-1")
    assert a["region"] == "us-east-1" and a["processing_duration_ms"] == 0
    assert a["policy_decision"]["approved"] is False
    assert a["policy_decision"]["policy_violations"] == ["X"]
    assert b["policy_decision"] is None
    assert a["ttl"] == 1704104430 + 365 * 86400
    rows = audit_records(df, event_time=time)
    assert rows.select(approved(F.col("policy_decision"))).collect() == [(False,), (True,)]
    late = F.lit("2024-12-31 10:20:30").cast("timestamp")
    assert expire_audit(rows, late).count() == 0
    assert expire_audit(rows, time).count() == 2


def test_violations_are_read_once(spark, tmp_path, sf):
    from checks import fixtures as X

    src = str(tmp_path / "audit")
    X.audit_log(spark, sf).write.parquet(src)
    period = ("2024-01-01T00:00:00Z", "2025-12-31T23:59:59Z")
    report = reports.build_report(spark.read.parquet(src), "policy_violations", *period)
    assert plan_of(report).count(f"[file:{src}]") == 0
    assert '"product_id" : null' in report.first()["report_json"]
