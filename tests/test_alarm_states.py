"""Alarm states of a stream equal those found in the closed windows afterwards."""

import random
from datetime import datetime, timedelta

import pytest

from reviewgate.operators import metrics as M
from reviewgate.streaming.alarms import start_alarm_states

SCHEMA = "function string, ts timestamp, is_error boolean, duration_ms long"
START = datetime(2024, 1, 1)
RULES = [
    ("errors", "f", "errors", 2.0, 2),
    ("slow", "f", "mean_duration_ms", 100.0, 1),
    ("other", "g", "errors", 1.0, 3),
    ("workflow", "workflow", "errors", 3.0, 2),
    ("busy", "g", "invocations", 4.0, 1),
]


def run(spark, tmp_path, batches):
    """Each batch is a file that is one micro-batch; a last call closes all windows."""
    folder = tmp_path / "in"
    folder.mkdir()
    end = max(r[1] for rows in batches for r in rows) + timedelta(days=1)
    query = None
    for i, rows in enumerate([*batches, [("end", end, False, 0)], [("end", end, False, 0)]]):
        path = str(folder / f"b{i}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    query = start_alarm_states(
        calls, str(tmp_path / "out"), str(tmp_path / "check"), rules=RULES, delay="10 minutes"
    )
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r.alarm, r.alarm_window, r.state_before, r.state) for r in out)


def wanted(spark, rows):
    calls = spark.createDataFrame(rows, SCHEMA)
    found = M.alarms(M.metric_values(M.function_metrics(calls)), rules=RULES)
    return sorted(map(tuple, M.alarm_transitions(found).collect()))


def drawn(draw, minutes):
    out = []
    for minute in range(0, minutes):
        if 60 <= minute < 80 or draw.random() < 0.3:
            continue
        for _ in range(draw.randint(1, 3)):
            at = START + timedelta(minutes=minute, seconds=draw.randint(0, 59))
            out.append((draw.choice("ffg"), at, draw.random() < 0.55, draw.randint(50, 150)))
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_changes_equal_those_of_the_closed_windows(spark, tmp_path):
    """Rows come out of order, up to the watermark's delay, in several batches."""
    draw = random.Random(5)
    rows = sorted(drawn(draw, 150), key=lambda r: r[1] + timedelta(minutes=draw.randint(0, 4)))
    size = len(rows) // 4 + 1
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    want = wanted(spark, rows)
    assert run(spark, tmp_path, batches) == want
    assert {x[3] for x in want} == {"OK", "ALARM"} and len({x[0] for x in want}) >= 4


def test_windows_without_calls_end_an_alarm(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    slow = lambda m: ("f", at(m), False, 500)
    # Too late for its window, which is closed: it changes nothing.
    batches = [[slow(1), slow(7)], [("g", at(60), False, 1)], [("f", at(2), False, 0), slow(61)]]
    got = run(spark, tmp_path, batches)
    assert [x for x in got if x[0] == "slow"] == [
        ("slow", at(0), "OK", "ALARM"), ("slow", at(10), "ALARM", "OK"),
        ("slow", at(60), "OK", "ALARM"), ("slow", at(65), "ALARM", "OK"),
    ]


def test_transitions_of_nothing(spark):
    none = M.alarms(M.metric_values(M.function_metrics(spark.createDataFrame([], SCHEMA))), rules=RULES)
    assert M.alarm_transitions(none).collect() == []
