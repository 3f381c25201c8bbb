"""Reviews are judged by the limits in force at their own time."""

from datetime import datetime, timedelta

from checks import fixtures as X
from checks.queries import POLICY_VERSIONS
from reviewgate.operators.policy import (
    PolicySet,
    content_policy,
    threshold_policy,
    unknown_modes,
)
from reviewgate.operators.policy_history import UPDATES, PolicyHistory, policy_update
from reviewgate.operators.scoring import mock_scorer
from reviewgate.plans.moderation import decide, prepare_input
from reviewgate.sources.tables import read_policy_history, write_policy_update
from reviewgate.streaming import moderation as M
from tests.conftest import plan_of

START = datetime.fromisoformat(X.START)


def at(minute):
    return START + timedelta(minutes=minute)


def scored(spark, sf):
    return X.analysis_of(X.with_gaps(X.reviews(spark, sf)))


def no_updates(spark):
    return spark.createDataFrame([], UPDATES)


def same(a, b):
    assert a.count() == b.count() > 0
    a = a.select(*b.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def shown(rows):
    return rows.selectExpr(
        "review_id", "policy_result.decision", "policy_result.reasons", "policy_result.explanation"
    )


def test_without_updates_as_the_first_set(spark, sf):
    rows = scored(spark, sf)
    history = PolicyHistory(no_updates(spark))
    same(shown(content_policy(rows, policies=history)), shown(content_policy(rows)))
    same(shown(threshold_policy(rows, policies=history)), shown(threshold_policy(rows)))
    columns = ["review_id", "compliance_mode", "policy_error"]
    same(unknown_modes(rows, history).select(columns), unknown_modes(rows).select(columns))
    assert sorted(content_policy(rows, policies=history).columns) == sorted(
        content_policy(rows).columns
    )


def test_each_period_as_its_own_set(spark, sf):
    """Equal to folding the updates on the driver, whatever order they were registered in."""
    rows = scored(spark, sf)
    updates, sets, now = no_updates(spark), [], PolicySet()
    for minute, update in POLICY_VERSIONS.items():
        now = now.updated(update)
        sets.append((minute // 4, now))
        updates = policy_update(spark, update, at(minute // 4), f"u{minute}").union(updates)
    history = PolicyHistory(updates)
    borders = [0, *[m for m, _ in sets], 10**9]
    for judge in (content_policy, threshold_policy):
        got = shown(judge(rows, policies=history))
        for i, policies in enumerate([PolicySet(), *[p for _, p in sets]]):
            part = rows.filter(f"k >= {borders[i]} and k < {borders[i + 1]}")
            want = shown(judge(part, policies=policies))
            same(got.join(part.select("review_id"), "review_id", "left_semi"), want)


def test_cases(spark):
    def moments(history, *times):
        rows = spark.createDataFrame(
            [(i, "standard", t, 1) for i, t in enumerate(times)],
            "i int, compliance_mode string, timestamp timestamp, _from int",
        )
        found = history.with_modes(rows.withColumnRenamed("_from", "own")).orderBy("i")
        return [r.toxicity_limit for r in found.collect()]

    def update(limit, day, name):
        return policy_update(
            spark, {"toxicity": {"standard": limit}}, datetime(2024, 5, day), name
        )

    history = PolicyHistory(
        update(1.0, 3, "b").union(update(2.0, 3, "a")).union(update(9.0, 7, "c"))
    )
    got = moments(
        history,
        datetime(2020, 1, 1),
        datetime(2024, 5, 2, 23, 59, 59),
        datetime(2024, 5, 3),  # of equal times the last id holds
        datetime(2024, 5, 6, 23, 59),
        datetime(2024, 5, 7),
        datetime(2030, 1, 1),
        None,  # no time: the newest
    )
    assert got == [5.0, 5.0, 1.0, 1.0, 9.0, 9.0, 9.0]
    lenient = {a: {"lenient": 9.0} for a in ("toxicity", "bias", "hallucination")}
    history = PolicyHistory(policy_update(spark, lenient, datetime(2024, 5, 3), "x"))
    rows = spark.createDataFrame(
        [(1, "lenient", datetime(2024, 5, 2)), (2, "lenient", datetime(2024, 5, 4)),
         (3, None, datetime(2024, 5, 4))],
        "i int, compliance_mode string, timestamp timestamp",
    )
    assert sorted(r.i for r in unknown_modes(rows, history).collect()) == [1, 3]


def test_an_update_registered_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "policies")
    assert read_policy_history(spark, path).updates.count() == 0
    for limit in (1.0, 2.0):
        write_policy_update(spark, path, {"bias": {"strict": limit}}, at(5), "u1")
    assert [r.limits for r in read_policy_history(spark, path).updates.collect()] == [
        {"threshold": 2.0}
    ]


def test_a_long_history_is_met_by_day(spark, sf):
    """A join on key and day, so a review meets the changes of its day only."""
    updates = no_updates(spark)
    for day in range(6):
        update = {"toxicity": {"standard": float(day)}}
        updates = updates.union(policy_update(spark, update, at(1440 * day), f"u{day}"))
    rows = scored(spark, sf)
    plan = plan_of(threshold_policy(rows, policies=PolicyHistory(updates)))
    assert "_bin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_stream_takes_up_updates(spark, sf, tmp_path):
    """Two starts with an update between: the same decisions as one batch that knows both."""
    src, out, path = (str(tmp_path / x) for x in ("in", "out", "policies"))
    rows = X.with_responses(X.reviews(spark, sf))
    stored = rows.schema

    def decide_rows(batch):
        prepared = prepare_input(batch, batch["timestamp"], "run", ["raw_response"])
        return decide(prepared, policies=read_policy_history(batch.sparkSession, path))

    update = {a: {m: 0.5 for m in ("mild", "standard", "strict")} for a in ("toxicity", "bias")}
    for part in ("k < 80", "k >= 80"):
        rows.filter(part).write.mode("append").parquet(src)
        M.start_moderation(
            spark.readStream.schema(stored).parquet(src), out, str(tmp_path / "c"), decide_rows
        ).awaitTermination()
        write_policy_update(spark, path, update, at(80), "u1")

    def decisions(frame):
        return frame.selectExpr("review_id", "policy_result.decision", "policy_result.reasons")

    got = decisions(spark.read.parquet(f"{out}/decisions"))
    good = spark.read.parquet(src).join(got.select("review_id"), "review_id", "left_semi")
    same(got, decisions(decide_rows(good)))
    plain = decide(prepare_input(good, good["timestamp"], "run", ["raw_response"]))
    assert got.exceptAll(decisions(plain)).count() > 0


def test_a_scoring_stream_asks_for_the_policies_each_time(spark, sf, tmp_path):
    asked = []

    def current(session):
        asked.append(session)
        return read_policy_history(session, str(tmp_path / "none"))

    rows = X.submissions(spark, sf)
    decide_rows = M.scoring_decider(mock_scorer, "run", START, policies=current)
    plain = M.scoring_decider(mock_scorer, "run", START)
    good = rows.limit(20)
    want = plain(good).select("review_id", "policy_result.decision")
    assert decide_rows(good).select("review_id", "policy_result.decision").count() == want.count()
    decide_rows(good)
    assert len(asked) == 2
