"""Keyed lookups over the stored tables, newest first, and keyed updates."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewgate.session import materialise

c = F.col


def newest(df: DataFrame, time: str, tie: str, limit: int) -> DataFrame:
    """Newest rows first; every task keeps only its own ``limit`` best rows."""
    return df.orderBy(F.desc(time), F.asc(tie)).limit(limit)


# --- audit events -----------------------------------------------------------
def audit_event(df: DataFrame, audit_id: str, timestamp: datetime) -> DataFrame:
    found = df.filter((c("audit_id") == audit_id) & (c("timestamp") == F.lit(timestamp)))
    if "event_date" in df.columns:
        found = found.filter(c("event_date") == F.to_date(F.lit(timestamp)))
    return found


def audit_by_review(df: DataFrame, review_id: str, limit: int = 50) -> DataFrame:
    return newest(df.filter(c("review_id") == review_id), "timestamp", "audit_id", limit)


def audit_by_user(df: DataFrame, user_id: str, limit: int = 100) -> DataFrame:
    return newest(df.filter(c("user_id") == user_id), "timestamp", "audit_id", limit)


def audit_by_product(df: DataFrame, product_id: str, limit: int = 100) -> DataFrame:
    return newest(df.filter(c("product_id") == product_id), "timestamp", "audit_id", limit)


def audit_by_type(df: DataFrame, event_type: str, limit: int = 100) -> DataFrame:
    return newest(df.filter(c("event_type") == event_type), "timestamp", "audit_id", limit)


# --- reviews ----------------------------------------------------------------
def review_by_id(df: DataFrame, review_id: str) -> DataFrame:
    return df.filter(c("review_id") == review_id)


def reviews_by_product(df: DataFrame, product_id: str, limit: int = 100) -> DataFrame:
    return newest(df.filter(c("product_id") == product_id), "timestamp", "review_id", limit)


def reviews_by_user(df: DataFrame, user_id: str, limit: int = 50) -> DataFrame:
    return newest(df.filter(c("user_id") == user_id), "timestamp", "review_id", limit)


def reviews_by_status(df: DataFrame, status: str, limit: int = 100) -> DataFrame:
    return newest(df.filter(c("status") == status), "timestamp", "review_id", limit)


# --- summaries --------------------------------------------------------------
def summary_by_id(df: DataFrame, summary_id: str) -> DataFrame:
    return df.filter(c("summary_id") == summary_id)


def summaries_by_product(df: DataFrame, product_id: str, limit: int = 10) -> DataFrame:
    return newest(
        df.filter(c("product_id") == product_id), "generated_at", "summary_id", limit
    )


# --- all keys at once -------------------------------------------------------
def hot_keys(df: DataFrame, keys: list[str], share: float = 1e-4) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, as a written table.

    There are at most ``1 / share`` of them, whatever the size of ``df``, so the
    result may be broadcast. Only the key columns are read.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limit = df.count() * share
    return materialise(counts.filter(c("_rows") > F.lit(limit)).select(*keys), "hot-keys")


def _ranked(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(c("rank") <= n)


def _sliced(rows: DataFrame, keys: list[str], order: list[Column], n: int, salts: int):
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return _ranked(salted, [*keys, "_salt"], order, n).drop("rank", "_salt")


def top_n_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    salts: int = 16,
    hot: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` rows of every key in the given order, with their ``rank``.

    Each map task cuts its rows to ``n`` per key before the shuffle (the plan's
    partial WindowGroupLimit). What is left of one hot key is still ``n`` rows
    per map task, so it is first reduced in ``salts`` slices and only then
    ranked as a whole. With ``hot`` (see ``hot_keys``) only those keys are cut
    into slices and take the extra shuffle; both kinds share one scan and one first
    shuffle. Without it all keys take it. An absent key is a key like any other.
    """
    if salts <= 1 or n <= 1:
        return _ranked(df, keys, order, n)
    if hot is None:
        return _ranked(_sliced(df, keys, order, n, salts), keys, order, n)
    named = hot.select(*[c(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))
    few = F.broadcast(named)
    same = reduce(and_, [c(k).eqNullSafe(c(f"_hot_{k}")) for k in keys])
    sliced = F.when(c("_hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    marked = df.join(few, same, "left").withColumn("_salt", sliced)
    first = _ranked(marked, [*keys, "_salt"], order, n).drop(
        "_salt", *[f"_hot_{k}" for k in keys]
    )
    cold = first.filter(c("_hot").isNull()).drop("_hot")
    crowded = first.filter(c("_hot")).drop("_hot", "rank")
    return cold.unionByName(_ranked(crowded, keys, order, n))


def latest_n_per_key(
    df: DataFrame,
    key: str,
    n: int,
    time: str = "timestamp",
    tie: str = "review_id",
    hot: DataFrame | None = None,
) -> DataFrame:
    return top_n_per_key(df, [key], [F.desc(time), F.asc(tie)], n, hot=hot)


def latest_per_key(
    df: DataFrame, key: str, version: str, tie: list[str] | None = None
) -> DataFrame:
    """The last written row of every key."""
    order = [F.desc(version)] + [F.desc(x) for x in tie or []]
    return top_n_per_key(df, [key], order, 1).drop("rank")


def update_status(
    reviews: DataFrame, updates: DataFrame, version: str | None = None
) -> DataFrame:
    """Set the status of the listed reviews, and their errors when some are given.

    ``updates`` has ``review_id, status, processing_errors``. Of several updates of one
    id the one with the highest ``version`` counts, without a version the last of the table.
    """
    update = F.struct("status", "processing_errors")
    order = F.struct(*([version] if version else []), "_at")
    given = (
        updates.withColumn("_at", F.monotonically_increasing_id())
        .groupBy("review_id")
        .agg(F.max_by(update, order).alias("_update"))
        .select(
            "review_id",
            c("_update.status").alias("_status"),
            c("_update.processing_errors").alias("_errors"),
        )
    )
    return (
        reviews.join(given, "review_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "processing_errors": F.when(F.size("_errors") > 0, c("_errors")).otherwise(
                    c("processing_errors")
                ),
            }
        )
        .drop("_status", "_errors")
    )


def join_stages(reviews: DataFrame, analyses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Put separately stored stages of a review back on one row.

    The stages are keyed tables (one row per review id, as ``put_by_key`` keeps
    them). A review without a stored stage keeps its row, with NULL there.
    """
    return reviews.join(analyses, "review_id", "left").join(decisions, "review_id", "left")
