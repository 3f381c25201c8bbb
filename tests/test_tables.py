"""Stored forms, sinks, keyed tables and lookups."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from reviewgate.operators import items, lookups
from reviewgate.sources import reviews as review_source
from reviewgate.sources import tables

START = datetime(2024, 1, 1)


def skewed(spark, n=6000):
    """A third of the rows belong to one product."""
    k = F.col("id")
    return spark.range(n, numPartitions=7).select(
        k,
        F.when(k % 3 == 0, F.lit("hot"))
        .when(k % 50 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("p"), (k % 37).cast("string")))
        .alias("product_id"),
        F.concat(F.lit("r"), k.cast("string")).alias("review_id"),
        # Many equal times, so that the tie-break matters.
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64(k), F.lit(50))).alias(
            "timestamp"
        ),
    )


@pytest.mark.parametrize("n", [1, 4, 100])
@pytest.mark.parametrize("salts, share", [(1, None), (5, None), (5, 0.1), (5, 0.0), (5, 0.9)])
def test_top_n_matches_brute_force(spark, n, salts, share):
    df = skewed(spark)
    order = [F.desc("timestamp"), F.asc("review_id")]
    hot = None if share is None else lookups.hot_keys(df, ["product_id"], share)
    if share == 0.1:
        assert [r["product_id"] for r in hot.collect()] == ["hot"]
    got = lookups.top_n_per_key(df, ["product_id"], order, n, salts, hot).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r["product_id"], []).append(r)
    want = set()
    for key, rows in groups.items():
        rows.sort(key=lambda r: (-r["timestamp"].timestamp(), r["review_id"]))
        want |= {(key, r["review_id"], i + 1) for i, r in enumerate(rows[:n])}
    assert {(r["product_id"], r["review_id"], r["rank"]) for r in got} == want


def test_an_absent_key_may_be_hot(spark):
    df = skewed(spark).withColumn(
        "product_id", F.when(F.col("product_id") != "hot", F.col("product_id"))
    )
    hot = lookups.hot_keys(df, ["product_id"], 0.1)
    assert [r["product_id"] for r in hot.collect()] == [None]
    got = lookups.latest_n_per_key(df, "product_id", 7, hot=hot)
    whole = lookups.latest_n_per_key(df, "product_id", 7)
    assert got.exceptAll(whole).count() == whole.exceptAll(got).count() == 0
    assert got.filter("product_id IS NULL").count() == 7


def test_top_n_limits_before_the_shuffle(spark):
    plan = plan_of(lookups.latest_n_per_key(skewed(spark), "product_id", 5))
    tree = plan[: plan.index("\n\n\n")]
    # One partial limit below each of the two shuffles.
    assert tree.count("WindowGroupLimit") == 4
    assert tree.count("Exchange") == 2


def test_lookup_is_a_top_k_without_full_sort(spark):
    plan = plan_of(lookups.reviews_by_product(skewed(spark), "hot", 10))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_put_by_key_last_wins_and_leaves_other_buckets(spark, tmp_path):
    path = str(tmp_path / "reviews")
    schema = "review_id string, status string, version int"
    first = spark.createDataFrame(
        [(f"r{i}", "PENDING", 1) for i in range(200)] + [("r0", "OLD", 0)], schema
    )
    tables.put_by_key(path, first, "review_id", "version", buckets=16)
    # The count is the table's: a later put may ask for another or for none.
    inner = os.path.join(path, "buckets=16")
    before = {
        d: {f: os.stat(os.path.join(inner, d, f)).st_mtime_ns for f in os.listdir(os.path.join(inner, d))}
        for d in os.listdir(inner)
        if d.startswith("bucket=")
    }
    second = spark.createDataFrame(
        [("r3", "APPROVED", 2), ("r3", "REJECTED", 3), ("r4", "LATE", 0), ("new", "PENDING", 1)],
        schema,
    )
    tables.put_by_key(path, second, "review_id", "version", buckets=8)
    assert os.listdir(path).count("buckets=8") == 0
    got = {r["review_id"]: r["status"] for r in spark.read.parquet(path).collect()}
    assert len(got) == spark.read.parquet(path).count() == 201
    assert (got["r3"], got["r4"], got["r0"], got["new"]) == (
        "REJECTED", "PENDING", "PENDING", "PENDING",
    )
    after = {
        d: {f: os.stat(os.path.join(inner, d, f)).st_mtime_ns for f in os.listdir(os.path.join(inner, d))}
        for d in before
    }
    assert sum(before[d] != after[d] for d in before) <= 3
    tables.put_by_key(path, second, "review_id", "version")
    assert spark.read.parquet(path).count() == 201


def test_puts_of_other_columns_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.put_by_key(
        path,
        spark.createDataFrame(
            [("a", 5, "old", "kept"), ("b", 5, "old", "kept"), ("c", None, "old", "kept")],
            "id string, v int, status string, note string",
        ),
        "id",
        "v",
    )
    updates = [("a", 5, "same", 1), ("b", 4, "late", 2), ("c", 1, "new", 3), ("d", None, "x", 4)]
    new = spark.createDataFrame(updates, "id string, v int, status string, extra int")
    tables.put_by_key(path, new, "id", "v")
    got = {r["id"]: (r["v"], r["status"], r["note"], r["extra"])
           for r in tables.read_by_key(spark, path).collect()}
    assert got == {
        "a": (5, "same", "kept", 1),
        "b": (5, "old", "kept", None),
        "c": (1, "new", "kept", 3),
        "d": (None, "x", None, 4),
    }


def test_puts_leave_no_scratch(spark, tmp_path):
    from reviewgate.session import scratch_root

    def copies():
        folder = os.path.join(scratch_root(spark).removeprefix("file://"), "reviewgate")
        names = os.listdir(folder) if os.path.isdir(folder) else []
        return {x for x in names if x.startswith(("upsert-", "unexpired-"))}

    before = copies()
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    for _ in range(2):
        tables.put_by_key(str(tmp_path / "t"), rows, "id", "v")
    assert copies() == before


def test_expired_days_are_dropped(spark, tmp_path):
    path = str(tmp_path / "log")
    day = 86400
    rows = spark.range(40).select(
        F.col("id"),
        F.when(F.col("id") % 10 != 7, F.col("id") * 3600 * 6 + day).alias("ttl"),
        F.date_add(F.lit("1970-01-01"), (F.col("id") / 4).cast("int")).alias("event_date"),
    )
    tables.append_audit(rows, path, "1")
    kept = {r["id"] for r in rows.collect() if r["ttl"] is None or r["ttl"] > 6 * day + 3600}
    untouched = os.listdir(f"{path}/event_date=1970-01-09/run=1")
    tables.drop_expired(spark, path, F.timestamp_seconds(F.lit(6 * day + 3600)))
    assert {r["id"] for r in tables.read_audit(spark, path).collect()} == kept
    assert not os.path.exists(f"{path}/event_date=1970-01-01/run=1")
    assert os.listdir(f"{path}/event_date=1970-01-09/run=1") == untouched


def test_json_keeps_microseconds(spark):
    moment = datetime(2024, 1, 2, 3, 4, 5, 123456)
    df = spark.createDataFrame([(moment,)], "timestamp timestamp")
    assert "05.123456" in items.to_json_text(df).first()[0]
    assert items.from_json_text(items.to_json_text(df), df.schema).first()[0] == moment


def test_access_path_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "by-product")
    tables.write_access_path(skewed(spark), path, "product_id", buckets=8)
    rows = tables.read_access_path(spark, path, "product_id", "hot")
    assert rows.count() == 2000
    plan = plan_of(rows)
    assert "PartitionFilters: [isnotnull(bucket" in plan
    folder = {os.path.dirname(f) for f in rows.inputFiles()}
    files = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in files and folder


def test_write_audit_is_partitioned_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "audit")
    df = skewed(spark).withColumn("event_date", F.to_date("timestamp"))
    for _ in range(2):
        tables.append_audit(df, path, "7")
    log = tables.read_audit(spark, path)
    assert log.count() == 6000
    days = [d for d in os.listdir(path) if d.startswith("event_date=")]
    assert days == ["event_date=2024-01-01"]
    assert os.listdir(f"{path}/{days[0]}") == ["run=7"]
    plan = plan_of(log.filter(F.col("event_date") == "2024-01-02"))
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "RebalancePartitions" in df.hint("rebalance", "event_date")._jdf.queryExecution().optimizedPlan().toString()


def test_update_status(spark):
    reviews = spark.createDataFrame(
        [("a", "PENDING", ["x"]), ("b", "PENDING", ["x"]), ("c", "PENDING", ["x"])],
        "review_id string, status string, processing_errors array<string>",
    )
    updates = spark.createDataFrame(
        [("a", "REJECTED", ["bad"]), ("b", "APPROVED", [])],
        "review_id string, status string, processing_errors array<string>",
    )
    # The last one given counts, whatever its name.
    earlier = spark.createDataFrame([("a", "SUMMARIZED", ["no"])], updates.schema)
    updates = earlier.union(updates)
    got = lookups.update_status(reviews, updates).orderBy("review_id").collect()
    assert [(r["status"], r["processing_errors"]) for r in got] == [
        ("REJECTED", ["bad"]), ("APPROVED", ["x"]), ("PENDING", ["x"]),
    ]


def test_review_items(spark):
    schema = (
        "review_id string, product_id string, user_id string, content string, rating int, "
        "timestamp timestamp, region string, product_category string, status string, "
        "processing_errors array<string>, source_ip string, user_agent string, language string"
    )
    t = datetime(2024, 1, 2, 3, 4, 5, 678)
    df = spark.createDataFrame(
        [("r1", "p", "u", "c", 5, t, "us-east-1", "books", "PENDING", [], "", None, ""),
         ("r2", "p", "u", "c", 5, START, "mars", "toys", "DONE", ["e"], "1.2.3.4", "app", "de")],
        schema,
    )
    a, b = items.review_to_item(df).orderBy("review_id").collect()
    assert (a["timestamp"], a["language"], a["processing_errors"], a["source_ip"]) == (
        t.isoformat(), "en", None, None,
    )
    assert (b["timestamp"], b["language"], b["processing_errors"]) == (
        START.isoformat(), "de", ["e"],
    )
    a, b = items.item_to_review(items.review_to_item(df)).orderBy("review_id").collect()
    assert (a["timestamp"], a["processing_errors"], a["item_errors"]) == (t, [], [])
    assert b["item_errors"] == ["region", "status"]


def test_nested_numbers_become_exact_and_back(spark):
    df = spark.createDataFrame(
        [(1, 0.1, {"a": 0.7}, [(2.675, "x")]), (2, None, None, [])],
        "id int, d double, m map<string,double>, s array<struct<v:double,t:string>>",
    )
    exact = items.floats_to_decimals(df)
    row = exact.first()
    assert str(row["d"].normalize()) == "0.1" and str(row["s"][0]["v"].normalize()) == "2.675"
    assert row["m"]["a"].normalize().as_tuple().digits == (7,)
    back = items.decimals_to_floats(exact)
    assert back.schema == df.schema
    assert back.collect() == df.collect()


def test_json_submissions_batch_and_defaults(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(
        [('{"api_request_id": "q1", "product_id": "p", "rating": "4", "content": "line\\nbreak"}',),
         ('{"review_id": "r2", "product_id": "", "rating": 5}',), ('{"product_id": "p"}',)],
        "value string",
    ).write.text(path)
    got = {r["review_id"]: r for r in review_source.read_json(spark, path).collect()}
    assert got["q1"]["content"] == "line\nbreak"
    assert got["r2"]["product_id"] is None and got["r2"]["rating"] == "5"
    assert len(got) == 3


def test_dead_letters_and_batch_counts(spark, tmp_path):
    events = spark.createDataFrame(
        [("a", "r", "u", "p", "ANALYSIS", "us-east-1", 5, START.date()),
         ("b", "", "u", "p", "ANALYSIS", "us-east-1", 5, START.date()),
         ("c", "r", "u", "p", "LOGIN", "us-east-1", -5, START.date())],
        "audit_id string, review_id string, user_id string, product_id string, "
        "event_type string, region string, processing_duration_ms int, event_date date",
    )
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    counts = tables.put_audit_batch(
        events, str(tmp_path / "audit"), str(tmp_path / "dead"), "1", now
    ).first()
    assert tuple(counts) == (1, 2)
    assert [r["audit_id"] for r in tables.read_audit(spark, str(tmp_path / "audit")).collect()] == ["a"]
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert {tuple(r["errors"]) for r in dead} == {
        ("review_id",), ("event_type", "processing_duration_ms"),
    }
    two_weeks = int((START + timedelta(days=14) - datetime(1970, 1, 1)).total_seconds())
    assert {r["ttl"] for r in dead} == {two_weeks}


def test_hot_and_other_keys_share_one_scan(spark, tmp_path):
    src = str(tmp_path / "rows")
    skewed(spark).write.parquet(src)
    df = spark.read.parquet(src)
    hot = lookups.hot_keys(df, ["product_id"], 0.1)
    out = lookups.latest_n_per_key(df, "product_id", 5, hot=hot)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final
