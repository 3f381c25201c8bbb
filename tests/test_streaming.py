"""A stream's result is the batch operator's result over the same rows."""

from datetime import datetime, timedelta

from checks import fixtures as X
from reviewgate.operators import lookups, metrics
from reviewgate.operators.routing import responses
from reviewgate.operators.scoring import mock_scorer
from reviewgate.operators.validation import split, validate_api
from reviewgate.sources import reviews as review_source
from reviewgate.plans import moderation as P
from reviewgate.streaming import moderation as M
from reviewgate.streaming import statistics as W

NOW = datetime(2024, 5, 1)


decide_mock = M.scoring_decider(mock_scorer, "run", NOW)


def write_submissions(spark, sf, path, files):
    rows = X.submissions(spark, sf).drop("timestamp", "language", "k")
    rows.repartition(files).write.mode("append").json(path)


def test_moderation_in_many_batches_equals_batch(spark, sf, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_submissions(spark, sf, src, 4)
    for _ in range(2):  # the second start finds nothing new
        M.start_moderation(
            review_source.stream_json(spark, src, max_files=1),
            out,
            str(tmp_path / "checkpoint"),
            decide_mock,
            NOW,
        ).awaitTermination()
    good, bad = split(validate_api(review_source.read_json(spark, src)))
    want = responses(decide_mock(good)).drop("processing_metadata")
    got = spark.read.parquet(f"{out}/responses").drop("run", "processing_metadata")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(f"{out}/dead_letters").count() == bad.count() > 0
    audit = spark.read.parquet(f"{out}/audit")
    assert audit.count() == want.count()
    assert audit.select("run").distinct().count() == 4
    assert audit.select("audit_id").distinct().count() == want.count()


def test_a_repeated_batch_leaves_one_copy(spark, sf, tmp_path):
    out = str(tmp_path / "out")
    src = str(tmp_path / "in")
    write_submissions(spark, sf, src, 1)
    batch = review_source.read_json(spark, src)
    for _ in range(2):
        M.write_batch(batch, 5, out, decide_mock, NOW)
    n = split(validate_api(batch))[0].count()
    for name in ("decisions", "responses", "audit"):
        assert spark.read.parquet(f"{out}/{name}").count() == n


def test_a_failed_audit_does_not_stop_the_flow(spark, sf, tmp_path, monkeypatch):
    def broken(*args, **kwargs):
        raise OSError("log store is down")

    monkeypatch.setattr(P, "append_audit", broken)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_submissions(spark, sf, src, 1)
    M.write_batch(review_source.read_json(spark, src), 0, out, decide_mock, NOW)
    answered = spark.read.parquet(f"{out}/responses").count()
    assert answered == spark.read.parquet(f"{out}/audit_dead_letters").count() > 0


def audit_files(spark, sf, path):
    """The audit log in time order, one file per slice of time."""
    log = X.audit_log(spark, sf)
    log.repartitionByRange(3, "timestamp").write.parquet(path)
    return spark.read.parquet(path)


def test_a_failed_audit_does_not_stop_the_batch_job(spark, sf, tmp_path, monkeypatch):
    def broken(*args, **kwargs):
        raise OSError("log store is down")

    monkeypatch.setattr(P, "append_audit", broken)
    out = str(tmp_path / "out")
    rows = X.submissions(spark, sf).drop("timestamp", "language", "k")
    done = P.run_moderation(rows, mock_scorer, out, run_id="r", entered_at=NOW)
    assert done["audit"] is None
    answered = done["responses"].count()
    assert answered == spark.read.parquet(f"{out}/audit_dead_letters").count() > 0


def test_running_statistics_equal_batch_on_all_windows(spark, sf, tmp_path):
    src, out = str(tmp_path / "audit"), str(tmp_path / "out")
    log = audit_files(spark, sf, src)
    stream = spark.readStream.schema(log.schema).parquet(src)
    for _ in range(2):  # the second start finds nothing new
        W.start_audit_statistics(
            stream, out, str(tmp_path / "cp"), "30 minutes"
        ).awaitTermination()
    want = W.windowed_statistics(log, "30 minutes")
    got = W.read_statistics(spark, out)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_redelivery(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [
        ("a", datetime(2024, 1, 1, 0, 0), 1), ("a", datetime(2024, 1, 1, 0, 5), 2),
        ("b", datetime(2024, 1, 1, 0, 1), 1),
    ]
    schema = "review_id string, timestamp timestamp, version int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    once = M.without_redelivery(spark.readStream.schema(schema).parquet(src))
    W.append_stream(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["review_id"] for r in got) == ["a", "b"]
    last = lookups.latest_per_key(spark.read.parquet(src), "review_id", "timestamp").collect()
    assert {(r["review_id"], r["version"]) for r in last} == {("a", 2), ("b", 1)}


def calls(spark, rows):
    return spark.createDataFrame(
        [(f, datetime(2024, 1, 1) + timedelta(minutes=m), e, d) for f, m, e, d in rows],
        "function string, ts timestamp, is_error boolean, duration_ms long",
    )


def test_alarms_need_consecutive_windows(spark):
    def errors(function, window, n):
        return [(function, 5 * window + 1, True, 10)] * n

    rows = (
        errors("review-auditor", 0, 5)
        + errors("review-auditor", 1, 4)  # under the threshold
        + errors("review-auditor", 2, 6)
        + errors("review-auditor", 3, 5)  # alarm: windows 2 and 3
        + errors("review-auditor", 5, 7)  # window 4 is empty, which does not breach
        + errors("audit-logger", 0, 10)
        + errors("audit-logger", 1, 10)
        + errors("audit-logger", 2, 11)  # alarm: three in a row
        + [("review-auditor", 60, False, 300000), ("review-auditor", 65, False, 240000)]
    )
    values = metrics.metric_values(metrics.function_metrics(calls(spark, rows)))
    got = {
        (r["alarm"], r["alarm_window"].minute + 60 * r["alarm_window"].hour, r["value"])
        for r in metrics.alarms(values).collect()
    }
    workflow = {w: n for w, n in ((0, 15), (1, 14), (2, 17), (3, 5), (5, 7))}
    assert got == {
        ("review-auditor-errors", 15, 5.0),
        ("audit-logger-errors", 10, 11.0),
        ("review-auditor-duration", 65, 240000.0),
    } | {
        ("workflow-failures", 5 * w, float(n))
        for w, n in workflow.items()
        if w - 1 in workflow
    }
