"""Growing keyed tables, own column names and reruns of stored logs."""

import os
from collections import Counter

from pyspark.sql import functions as F

from conftest import plan_of
from reviewgate.sources import tables


def keyed(spark, first, n, version=1):
    return spark.range(first, first + n).select(
        F.concat(F.lit("r"), F.col("id")).alias("review_id"),
        F.lit(version).alias("version"),
        F.col("id").alias("k"),
    )


def test_a_table_grows_by_splitting_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda rows: tables.put_by_key(path, rows, "review_id", "version", 2, 50)
    put(keyed(spark, 0, 1))
    assert len(tables.live_buckets(spark, path)) == 1
    put(keyed(spark, 0, 300))
    put(keyed(spark, 200, 1800))
    # A put that touches few buckets, with newer and older versions.
    put(keyed(spark, 5, 3, version=2).unionByName(keyed(spark, 900, 2, version=0)))
    rows = tables.read_by_key(spark, path)
    got = {r.review_id: (r.version, r.k) for r in rows.collect()}
    assert rows.columns == ["review_id", "version", "k"]
    assert rows.count() == len(got) == 2000
    assert got == {f"r{i}": (2 if 5 <= i < 8 else 1, i) for i in range(2000)}
    sizes = Counter(
        (r.buckets, r.bucket) for r in tables._read_stored(spark, path).collect()
    )
    assert max(sizes.values()) <= 100 and len(sizes) >= 20
    for i in (0, 6, 901, 1999):
        found = tables.lookup_by_key(spark, path, "review_id", f"r{i}")
        assert [r.k for r in found.collect()] == [i]
        filters = plan_of(found).split("PartitionFilters: ")[1].split("\n")[0]
        assert "buckets" in filters and "bucket#" in filters
    assert tables.lookup_by_key(spark, path, "review_id", "none").count() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.put_by_key(path, keyed(spark, 0, 2000), "review_id", "version", 2, 50)
    files = lambda: {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet") and "bucket=" in d
    }
    before = files()
    tables.put_by_key(path, keyed(spark, 7, 1, 2), "review_id", "version", bucket_rows=50)
    after = files()
    changed = {os.path.dirname(x) for x in before.keys() ^ after.keys()}
    assert len(changed) == 1 and len(before) > 20


def test_many_small_buckets_are_dealt_out_by_number(spark, tmp_path):
    """Few bytes in many files: written by several tasks, and not listed by a task per folder."""
    path = str(tmp_path / "t")
    put = lambda rows: tables.put_by_key(path, rows, "review_id", "version", 1, 5)
    put(keyed(spark, 0, 1))
    for version in (1, 2):
        put(keyed(spark, 0, 1500, version))
        files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
        assert len(files) == len(tables.live_buckets(spark, path)) > 256
        tasks = Counter(f.split("-")[1] for f in files)
        assert len(tasks) >= 4 and max(tasks.values()) <= 3 * tables.TASK_BUCKETS
    jobs = spark.sparkContext
    jobs.setJobGroup("listing", "listing")
    try:
        rows = tables.read_by_key(spark, path)
    finally:
        jobs.setLocalProperty("spark.jobGroup.id", None)
    status = jobs.statusTracker()
    stages = [
        i for job in status.getJobIdsForGroup("listing") for i in status.getJobInfo(job).stageIds
    ]
    assert stages and max(status.getStageInfo(i).numTasks for i in stages) <= 128
    assert sorted(map(tuple, rows.collect())) == sorted((f"r{i}", 2, i) for i in range(1500))


def test_what_is_left_of_a_split_bucket_is_ignored(spark, tmp_path):
    """A put that dies after writing the parts and before dropping the old folder."""
    import shutil

    path = str(tmp_path / "t")
    tables.put_by_key(path, keyed(spark, 0, 80), "review_id", "version", 1, 50)
    old = tmp_path / "old"
    shutil.copytree(f"{path}/buckets=1", old)
    tables.put_by_key(path, keyed(spark, 80, 100), "review_id", "version", bucket_rows=50)
    assert not os.path.exists(f"{path}/buckets=1/bucket=0")
    shutil.copytree(old, f"{path}/buckets=1", dirs_exist_ok=True)
    assert tables.read_by_key(spark, path).count() == 180
    tables.put_by_key(path, keyed(spark, 0, 5, 2), "review_id", "version", bucket_rows=50)
    assert tables.read_by_key(spark, path).count() == 180
    assert tables.lookup_by_key(spark, path, "review_id", "r1").collect()[0].version == 2


def test_own_columns_named_like_folders_survive(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 1, "mine", 5, "x"), ("b", 1, "ours", 6, "y")],
        "review_id string, version int, bucket string, buckets int, own_bucket string",
    )
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.put_by_key(path, rows, "review_id", "version")
    back = tables.read_by_key(spark, path)
    assert back.columns == rows.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    copy = str(tmp_path / "copy")
    tables.write_access_path(rows, copy, "bucket", "version", buckets=4)
    found = tables.read_access_path(spark, copy, "bucket", "mine")
    assert [tuple(r) for r in found.select(*rows.columns).collect()] == [("a", 1, "mine", 5, "x")]
    log = str(tmp_path / "log")
    events = rows.select("review_id", F.lit("own").alias("run"), F.to_date(F.lit("2024-01-01")).alias("event_date"))
    written = tables.append_audit(events, log, "1")
    assert {r.run for r in written.collect()} == {"own"} and written.columns == events.columns
    assert {r.run for r in tables.read_audit(spark, log).collect()} == {"own"}


def test_a_rerun_after_expiry_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    day = 86400
    rows = spark.range(24).select(
        F.col("id"), (F.col("id") * 3600 + day).alias("ttl"), F.to_date(F.lit("1970-01-01")).alias("event_date")
    )
    tables.append_audit(rows, path, "007")
    tables.append_audit(rows.withColumn("id", F.col("id") + 100), path, "8")
    moment = F.timestamp_seconds(F.lit(day + 5 * 3600))
    assert len(tables.drop_expired(spark, path, moment)) == 1
    log = tables.read_audit(spark, path)
    assert log.count() == 36 and {r.run for r in log.collect()} == {"007", "8"}
    tables.append_audit(rows, path, "007")
    assert tables.read_audit(spark, path).filter("run = '007'").count() == 24
    assert tables.read_audit(spark, path).count() == 24 + 18


def test_rows_that_stay_are_written_before_others_go(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame(
        [(1, 10, "1970-01-01"), (2, 99, "1970-01-01"), (3, 10, "1970-01-02")],
        "id int, ttl long, event_date string",
    ).withColumn("event_date", F.to_date("event_date"))
    tables.append_audit(rows, path, "1")

    def lost(spark, target):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(tables, "discard", lost)
    try:
        tables.drop_expired(spark, path, F.timestamp_seconds(F.lit(50)))
    except RuntimeError:
        pass
    assert {r.id for r in tables.read_audit(spark, path).collect()} >= {2}
    monkeypatch.undo()
    tables.drop_expired(spark, path, F.timestamp_seconds(F.lit(50)))
    assert {r.id for r in tables.read_audit(spark, path).collect()} == {2}
