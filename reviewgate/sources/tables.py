"""Sinks and stored tables.

Every write goes to a folder named by its run or batch id and overwrites that
folder, so a repeated run or micro-batch leaves one copy of its rows.

Names of folder levels (``run``, ``buckets``, ``bucket``) are free for a caller's columns: such a
column is stored with ``own_`` before its name and gets its name back when it is read.
"""

from __future__ import annotations

import math
import re
import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.constants import DEAD_LETTER_RETENTION_DAYS
from reviewgate.operators.lookups import latest_per_key
from reviewgate.operators.policy import PolicySet
from reviewgate.operators.policy_history import UPDATES, PolicyHistory, policy_update
from reviewgate.operators.validation import validate_audit
from reviewgate.session import discard, materialise, scratch_path

c = F.col
#: Times in JSON with all their digits.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Rows of a bucket of a keyed table; a touched bucket of more than twice as many is split.
BUCKET_ROWS = 100_000
#: Buckets that are named one by one in a filter; more are joined.
LISTED_BUCKETS = 4096
#: Small buckets that one task writes at most.
TASK_BUCKETS = 64
AUDIT_LAYOUT, KEYED_LAYOUT = ("run",), ("buckets", "bucket")


def _folder(path: str, run_id: str | int) -> str:
    return f"{path}/run={run_id}"


def _stored_names(df: DataFrame, layout: tuple[str, ...]) -> DataFrame:
    """Columns that are named like a folder level, out of its way."""
    taken = re.compile(rf"(own_)*({'|'.join(layout)})")
    return df.toDF(*[f"own_{x}" if taken.fullmatch(x) else x for x in df.columns])


def _own_names(df: DataFrame, layout: tuple[str, ...]) -> DataFrame:
    """The caller's names again; a folder level that would clash goes."""
    taken = re.compile(rf"own_(own_)*({'|'.join(layout)})")
    own = {x: x.removeprefix("own_") for x in df.columns if taken.fullmatch(x)}
    rows = df.drop(*[x for x in own.values() if x in layout])
    return rows.toDF(*[own.get(x, x) for x in rows.columns])


def write_rows(df: DataFrame, path: str, run_id: str | int) -> DataFrame:
    """Write one run's rows and return what was written."""
    target = _folder(path, run_id)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def append_audit(df: DataFrame, path: str, run_id: str | int) -> DataFrame:
    """Append one run's audit rows, by day and below it by run.

    A repeated run replaces its own folders; a filter on the day lists that day only.
    ``rebalance`` gathers a day's rows into files of even size and splits a day
    that holds most of them; without it each task would write a file per day.
    """
    rows = _stored_names(df, AUDIT_LAYOUT).withColumn("run", F.lit(str(run_id)))
    rows.hint("rebalance", "event_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("event_date", "run").parquet(path)
    written = df.sparkSession.read.schema(rows.schema).parquet(path)
    own = _own_names(written.filter(c("run") == str(run_id)), AUDIT_LAYOUT)
    return own.select(*df.columns)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """A stored log. A run's id is text, whatever it looks like: ``007`` is not 7."""
    return _own_names(_read_log(spark, path), AUDIT_LAYOUT)


def _read_log(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path).schema
    schema = T.StructType(
        [T.StructField("run", T.StringType()) if f.name == "run" else f for f in found]
    )
    return spark.read.schema(schema).parquet(path)


def write_policy_update(
    spark: SparkSession, path: str, updates: dict, effective_at: datetime, update_id: str
) -> DataFrame:
    """Register a policy update; the same id again replaces it."""
    return write_rows(policy_update(spark, updates, effective_at, update_id), path, update_id)


def read_policy_history(
    spark: SparkSession, path: str, first: PolicySet | None = None, time: str = "timestamp"
) -> PolicyHistory:
    """The policy set ``first`` with the updates registered so far, if there are any."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        updates = spark.read.schema(UPDATES).parquet(path)
    else:
        updates = spark.createDataFrame([], UPDATES)
    return PolicyHistory(updates, first or PolicySet(), time)


def put_audit_batch(
    events: DataFrame, path: str, dead_letters: str, run_id: str | int, now: Column
) -> DataFrame:
    """Store the valid events, set the others aside, return both counts."""
    checked = materialise(validate_audit(events), "audit-batch")
    append_audit(checked.filter(F.size("errors") == 0).drop("errors"), path, run_id)
    write_dead_letters(checked.filter(F.size("errors") > 0), dead_letters, run_id, now)
    return checked.agg(
        F.count_if(F.size("errors") == 0).alias("events_processed"),
        F.count_if(F.size("errors") > 0).alias("events_failed"),
    )


def write_dead_letters(
    bad: DataFrame, path: str, run_id: str | int, received_at: Column
) -> DataFrame:
    """Keep rejected rows as JSON text with their errors and an expiry time."""
    rows = bad.select(
        F.to_json(
            F.struct(*[x for x in bad.columns if x != "errors"]), JSON_TIMES
        ).alias("row"),
        "errors",
        received_at.alias("received_at"),
        (F.unix_timestamp(received_at) + DEAD_LETTER_RETENTION_DAYS * 86400).alias("ttl"),
    )
    return write_rows(rows, path, run_id)


def write_corrupt_lines(
    bad: DataFrame, path: str, run_id: str | int, received_at: Column
) -> DataFrame:
    """Keep malformed lines beside a run's other dead letters, as they came, with the reason,
    the file they stood in and an expiry time."""
    rows = bad.select(
        c("line").alias("row"),
        F.array("error").alias("errors"),
        received_at.alias("received_at"),
        (F.unix_timestamp(received_at) + DEAD_LETTER_RETENTION_DAYS * 86400).alias("ttl"),
        "source_file",
    )
    return write_rows(rows, path, f"{run_id}-lines")


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Refused rows and malformed lines of all runs."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def upsert(
    current: DataFrame | None, updates: DataFrame, key: str, version: str
) -> DataFrame:
    """Current rows with the updates put over them, one row per key.

    Of several updates of a key the highest version counts. It replaces the current
    row unless that has a higher version; an equal or missing version is replaced.
    Columns that only the current rows have keep their values, columns that only the
    updates have are NULL in rows without an update.
    """
    tie = [f.name for f in updates.schema if not _holds_map(f.dataType)]
    last = latest_per_key(
        updates.withColumn("_tie", F.xxhash64(*tie)), key, version, ["_tie"]
    ).drop("_tie")
    if current is None:
        return last
    old = current.select(F.struct(*current.columns).alias("_old"))
    new = last.select(F.struct(*last.columns).alias("_new"))
    both = old.join(new, c(f"_old.{key}").eqNullSafe(c(f"_new.{key}")), "full_outer")
    older = c(f"_old.{version}") > c(f"_new.{version}")
    put = c("_new").isNotNull() & ~F.coalesce(older, F.lit(False))
    columns = []
    for name in [*current.columns, *[x for x in last.columns if x not in current.columns]]:
        before = c(f"_old.{name}") if name in current.columns else F.lit(None)
        after = c(f"_new.{name}") if name in last.columns else before
        columns.append(F.when(put, after).otherwise(before).alias(name))
    return both.select(*columns)


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def put_by_key(
    path: str,
    updates: DataFrame,
    key: str,
    version: str,
    buckets: int | None = None,
    bucket_rows: int | None = None,
) -> None:
    """Upsert into a stored table, rewriting only the buckets that change.

    The table is laid out by a hash of its key. The number of buckets is set when the
    table is made, by its size if not given, and kept in its folders' names; later
    puts read it there. The buckets the updates touch are read, merged and replaced; all
    others are neither read nor written. A touched bucket that has grown beyond twice
    ``bucket_rows`` is split: bucket ``b`` of ``n`` becomes ``b`` and ``b + n`` of ``2 n``, or
    more of them at once. So buckets of several sizes lie side by side, each key in one.

    The merged rows are written to the scratch folder before the buckets they replace are
    dropped, so they exist in full at any moment, whatever is lost; after that the scratch
    copy goes. A split bucket's folder goes last; readers ignore it once its parts are there.
    """
    spark = updates.sparkSession
    most = bucket_rows or BUCKET_ROWS
    stored, left = _bucket_folders(spark, path)
    rows = _stored_names(updates, KEYED_LAYOUT)
    key, version = [f"own_{x}" if x in KEYED_LAYOUT else x for x in (key, version)]
    if not stored:
        count = buckets or max(64, -(-updates.count() // most))
        rows = rows.withColumns({"buckets": F.lit(count), "bucket": _bucket(c(key), count)})
        first = upsert(None, rows, key, version)
        split = []
        if buckets:
            first = materialise(first, "put-first")
            split = _split_buckets(first, most)
        _write_buckets(_grown(first, key, split), path, count + _parts(split), most)
        return
    placed = materialise(_placed(spark, rows, key, stored), "put-placed")
    touched = placed.select("buckets", "bucket").distinct()
    current = _read_stored(spark, path, left)
    changed = touched.count()
    if len(stored) <= LISTED_BUCKETS or changed <= LISTED_BUCKETS:
        current = current.filter(_listed([tuple(r) for r in touched.collect()]))
    else:
        current = current.join(touched, ["buckets", "bucket"], "left_semi")
    scratch = scratch_path(spark, "upsert")
    merged = materialise(upsert(current, placed, key, version), "upsert", scratch)
    split = _split_buckets(merged, most)
    _write_buckets(_grown(merged, key, split), path, changed + _parts(split), most)
    for count, bucket, _ in split:
        discard(spark, f"{path}/buckets={count}/bucket={bucket}")
    discard(spark, scratch)


def _listed(places: list[tuple[int, int]]) -> Column:
    """Whether a row lies in one of these buckets; prunes folders."""
    out = F.lit(False)
    for count in {n for n, _ in places}:
        own = [b for n, b in places if n == count]
        out = out | ((c("buckets") == count) & c("bucket").isin(own))
    return out


def _placed(
    spark: SparkSession, rows: DataFrame, key: str, stored: list[tuple[int, int]]
) -> DataFrame:
    """Rows with the bucket their key belongs to: the finest that there is, or, where no row
    has come yet, one of the count the table was made with."""
    counts = sorted({n for n, _ in stored}, reverse=True)
    at = [_bucket(c(key), n) for n in counts]
    if len(counts) == 1:
        return rows.withColumns({"buckets": F.lit(counts[0]), "bucket": at[0]})
    there = spark.createDataFrame(stored, "_n int, _b int")
    if len(stored) <= LISTED_BUCKETS:
        there = F.broadcast(there)
    fine, place = F.lit(counts[-1]), at[-1]
    for i, (n, own) in enumerate(zip(counts, at)):
        found = there.filter(c("_n") == n).select(c("_b").alias(f"_b{i}"))
        rows = rows.join(found, own == c(f"_b{i}"), "left")
    for i, (n, own) in reversed(list(enumerate(zip(counts, at)))):
        here = c(f"_b{i}").isNotNull()
        fine, place = F.when(here, n).otherwise(fine), F.when(here, own).otherwise(place)
    placed = rows.withColumns({"buckets": fine, "bucket": place})
    return placed.drop(*[f"_b{i}" for i in range(len(counts))])


def _split_buckets(rows: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """Buckets that have grown too large, and the count that brings them to size."""
    large = rows.groupBy("buckets", "bucket").count().filter(c("count") > 2 * most)
    return [
        (r["buckets"], r["bucket"], r["buckets"] << math.ceil(math.log2(r["count"] / most)))
        for r in large.collect()
    ]


def _parts(split: list[tuple[int, int, int]]) -> int:
    return sum(finer // count for count, _, finer in split)


def _grown(rows: DataFrame, key: str, split: list[tuple[int, int, int]]) -> DataFrame:
    """Rows with the buckets they go to once the large ones are split."""
    if not split:
        return rows
    table = rows.sparkSession.createDataFrame(split, "buckets int, bucket int, _finer int")
    if len(split) <= LISTED_BUCKETS:
        table = F.broadcast(table)
    marked = rows.join(table, ["buckets", "bucket"], "left")
    finer = F.coalesce("_finer", "buckets")
    return marked.withColumns(
        {"buckets": finer, "bucket": F.pmod(F.xxhash64(c(key)), finer).cast("int")}
    ).drop("_finer")


def live_buckets(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The buckets of a stored table: (count, number)."""
    return _bucket_folders(spark, path)[0]


def _bucket_folders(spark: SparkSession, path: str) -> tuple[list, set]:
    """Live buckets and those that were split, from the folders' names. A bucket of which
    finer parts exist was split; what is left of it does not count."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return [], set()
    # Listed by tasks where there are many, and no rows are read.
    names = spark.read.schema("buckets int, bucket int").parquet(path).inputFiles()
    places = {
        (int(m[1]), int(m[2]))
        for x in names
        if (m := re.search(r"/buckets=(\d+)/bucket=(\d+)/[^/]*$", x))
    }
    counts = sorted({n for n, _ in places})
    coarser = {
        (n, b % n) for m, b in places for n in counts if n < m and m % n == 0
    }
    return sorted(places - coarser), places & coarser


def _read_stored(spark: SparkSession, path: str, split: set | None = None) -> DataFrame:
    """The live buckets with the columns of the layout; ``split`` if their folders are known."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    split = _bucket_folders(spark, path)[1] if split is None else split
    # Left only by a put that was lost at its end, and as many as it split.
    return rows.filter(~_listed(list(split))) if split else rows


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with all columns that any put has given it."""
    rows = _read_stored(spark, path).drop(*KEYED_LAYOUT)
    return _own_names(rows, KEYED_LAYOUT)


def lookup_by_key(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The row of one key: reads the one bucket it lies in."""
    places, split = _bucket_folders(spark, path)
    stored = f"own_{key}" if key in KEYED_LAYOUT else key
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    mine = F.lit(value).cast(rows.schema[stored].dataType)
    near = F.lit(False)
    for n in {n for n, _ in places}:
        near = near | ((c("buckets") == n) & (c("bucket") == _bucket(mine, n)))
    found = rows.filter(near & (c(stored) == mine))
    if split:
        found = found.filter(~_listed(list(split)))
    return _own_names(found.drop(*KEYED_LAYOUT), KEYED_LAYOUT)


def _write_buckets(rows: DataFrame, path: str, count: int, most: int) -> None:
    """Replace these buckets, ``count`` at most, of about ``most`` rows each.

    ``rebalance`` deals out by bytes. Opening a file takes longer than filling it with a small
    bucket, so small ones are dealt out by their number.
    """
    each = min(TASK_BUCKETS, BUCKET_ROWS // most)
    if each > 1:
        rows = rows.repartition(-(-count // each), "buckets", "bucket")
    else:
        rows = rows.hint("rebalance", "bucket")
    rows.write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("buckets", "bucket").parquet(path)


def write_access_path(
    df: DataFrame, path: str, key: str, time: str = "timestamp", buckets: int = 256
) -> None:
    """Store a copy of a table for lookups by ``key``, newest first.

    Takes the place of a secondary index: a lookup reads the one bucket folder
    its key hashes to, and within it only the row groups whose range holds the
    key. A bucket with a hot key is split over several files by ``rebalance``.
    """
    rows = _stored_names(df, KEYED_LAYOUT)
    key, time = [f"own_{x}" if x in KEYED_LAYOUT else x for x in (key, time)]
    rows.withColumns(
        {"buckets": F.lit(buckets), "bucket": _bucket(F.col(key), buckets)}
    ).hint("rebalance", "bucket").sortWithinPartitions(
        "buckets", "bucket", key, F.desc(time)
    ).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def read_access_path(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Rows of one key. The bucket is a constant, so other folders are pruned."""
    rows = spark.read.parquet(path)
    places = live_buckets(spark, path)
    buckets = places[0][0] if places else 1
    stored = f"own_{key}" if key in KEYED_LAYOUT else key
    found = rows.filter(
        (c("bucket") == _bucket(F.lit(value), buckets)) & (c(stored) == value)
    )
    return _own_names(found.drop("buckets", "bucket"), KEYED_LAYOUT)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_report(report: DataFrame, root: str) -> DataFrame:
    """Write a built report as ``reports/{type}/{id}.json`` and describe it.

    The report row is written first: its id and time are then fixed for both
    the file and the description.
    """
    started = time.monotonic()
    row = materialise(report, "report")
    head = row.select(
        "report_id", "report_type", "report_size_bytes", "records_processed"
    ).first()
    location = f"{root}/reports/{head['report_type']}/{head['report_id']}.json"
    row.select("report_json").write.mode("overwrite").text(location)
    elapsed = int((time.monotonic() - started) * 1000)
    return row.drop("report_json").withColumns(
        {"report_url": F.lit(location), "generation_time_ms": F.lit(elapsed)}
    )


def rewrite_unexpired(audit: DataFrame, target: str, now: Column) -> DataFrame:
    """Write the rows that have not expired as a new copy of the log."""
    from reviewgate.operators.audit import expire_audit

    kept = expire_audit(audit, now)
    kept.hint("rebalance", "event_date").write.mode("overwrite").partitionBy(
        "event_date"
    ).parquet(target)
    return audit.sparkSession.read.schema(kept.schema).parquet(target)


def drop_expired(spark: SparkSession, path: str, now: Column) -> list:
    """Remove expired rows from a stored log, run by run of each day; the days that changed.

    Only the expiry column is read to find the folders. A folder of which every row has
    expired is dropped; one of which some have is replaced by its other rows, under the same
    day and run, so a repeated run still replaces its own; all others are left alone. The
    rows that stay are written before anything is dropped.
    """
    from reviewgate.operators.audit import expire_audit

    log = _read_log(spark, path)
    gone = c("ttl") <= F.unix_timestamp(now)
    # One row per folder of the log, which the driver lists to read it.
    folders = (
        log.groupBy("event_date", "run")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("gone"))
        .filter("gone > 0")
        .collect()
    )
    mixed = [(r["event_date"], r["run"]) for r in folders if r["gone"] < r["n"]]
    if mixed:
        scratch = scratch_path(spark, "unexpired")
        where = F.lit(False)
        for day in {d for d, _ in mixed}:
            runs = [r for d, r in mixed if d == day]
            where = where | (c("event_date").eqNullSafe(F.lit(day)) & c("run").isin(runs))
        kept = materialise(expire_audit(log.filter(where), now), "unexpired", scratch)
        kept.hint("rebalance", "event_date").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("event_date", "run").parquet(path)
        discard(spark, scratch)
    for row in folders:
        if row["gone"] == row["n"]:
            discard(spark, f"{path}/event_date={row['event_date']}/run={row['run']}")
    return sorted({r["event_date"] for r in folders})
