"""Malformed lines reach the dead letters as they came, in batch and in a stream."""

from datetime import datetime

from reviewgate.operators.scoring import mock_scorer
from reviewgate.plans.moderation import run_moderation
from reviewgate.sources import reviews, tables
from reviewgate.streaming.moderation import scoring_decider, start_json_moderation

AT = datetime(2024, 1, 1)
GOOD = (
    '{"review_id": "r%d", "product_id": "p", "user_id": "u", "content": "A review long enough", '
    '"rating": 4, "region": "us-east-1", "product_category": "books", "compliance_mode": "mild"}'
)
BAD = {
    '{"review_id": "x", ': "MALFORMED_JSON",
    "no json": "MALFORMED_JSON",
    '{"review_id": "y"} and more': "MALFORMED_JSON",
    '[{"review_id": "z"}]': "NOT_AN_OBJECT",
    "5": "NOT_AN_OBJECT",
    '"text"': "NOT_AN_OBJECT",
    "null": "NOT_AN_OBJECT",
}


def written(folder, n):
    folder.mkdir()
    lines = [GOOD % i for i in range(n)]
    (folder / "a.json").write_text("\n".join([*lines[::2], "", *BAD, "   "]) + "\n")
    (folder / "b.json").write_text("\n".join(lines[1::2]) + "\n")
    return str(folder)


def test_lines_are_split(spark, tmp_path):
    good, bad = reviews.read_json_lines(spark, written(tmp_path / "in", 5))
    assert {r.review_id for r in good.collect()} == {f"r{i}" for i in range(5)}
    assert {r.line: r.error for r in bad.collect()} == BAD
    assert {r.source_file.rsplit("/", 1)[1] for r in bad.collect()} == {"a.json"}
    assert good.count() + bad.count() == 5 + len(BAD)


def check_letters(spark, out):
    dead = tables.read_dead_letters(spark, f"{out}/dead_letters").collect()
    lines = {r.row: r.errors for r in dead if r.source_file}
    assert lines == {x: [e] for x, e in BAD.items()}
    assert {r.ttl for r in dead} == {int((AT - datetime(1970, 1, 1)).total_seconds()) + 14 * 86400}


def test_batch_job_keeps_them(spark, tmp_path):
    good, bad = reviews.read_json_lines(spark, written(tmp_path / "in", 3))
    out = str(tmp_path / "out")
    done = run_moderation(good, mock_scorer, out, run_id="1", entered_at=AT, corrupt=bad)
    assert done["responses"].count() == 3
    check_letters(spark, out)


def test_stream_keeps_them(spark, tmp_path):
    lines = reviews.stream_json_lines(spark, written(tmp_path / "in", 3))
    out = str(tmp_path / "out")
    decide = scoring_decider(mock_scorer, "run-1", AT)
    for _ in range(2):
        start_json_moderation(
            lines, out, str(tmp_path / "check"), decide, received_at=AT
        ).awaitTermination()
    assert spark.read.parquet(f"{out}/responses").count() == 3
    check_letters(spark, out)
