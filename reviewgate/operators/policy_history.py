"""Policies by time: every review is judged by the limits in force at its own time.

A policy update is stored as rows, one per entry it replaces, with the time from which it
holds. All updates together give a timeline per policy key, and reviews meet it in an as-of
join: both sides carry the day, so a review is compared with the few changes of that day, not
with the whole history. Nothing of the history comes to the driver but its first and last day
and its size.

Cases: of updates with the same time the last ``update_id`` holds; an update may be registered
late, only its time counts; a repeated update id replaces its rows; a review without a time is
judged by the newest limits; a key without limits at that time is as one the policies lack.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewgate import constants as K
from reviewgate.operators.policy import MAX_POLICY_ROWS, PolicySet

c = F.col
UPDATES = """effective_at timestamp, update_id string, policy_type string, policy_key string,
    limits map<string,double>"""
THRESHOLD = "threshold"
#: Limits that were never set hold from here on; the newest hold until there.
BEGINNING, END = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _day(time: Column) -> Column:
    return F.unix_date(time.cast("date"))


def _entries(spark: SparkSession, policies: dict) -> DataFrame:
    """Entries of a policy set or of an update, one row each."""
    rows = [
        (kind, key, value if isinstance(value, dict) else {THRESHOLD: value})
        for kind, entries in policies.items()
        for key, value in entries.items()
    ]
    numbers = pa.map_(pa.string(), pa.float64())
    return spark.createDataFrame(
        pa.table(
            {
                "policy_type": pa.array([kind for kind, _, _ in rows], pa.string()),
                "policy_key": pa.array([key for _, key, _ in rows], pa.string()),
                "limits": pa.array(
                    [
                        [(name, None if x is None else float(x)) for name, x in limits.items()]
                        for _, _, limits in rows
                    ],
                    numbers,
                ),
            }
        )
    )


def policy_update(
    spark: SparkSession, updates: dict, effective_at: datetime | Column, update_id: str
) -> DataFrame:
    """The rows of one update (``PolicySet.updated``) that holds from ``effective_at`` on."""
    at = effective_at
    if isinstance(at, datetime):
        at = F.lit(at.isoformat(sep=" ")).cast("timestamp")
    return _entries(spark, updates).select(
        at.alias("effective_at"),
        F.lit(update_id).alias("update_id"),
        "policy_type",
        "policy_key",
        "limits",
    )


@dataclass(frozen=True)
class PolicyHistory:
    """A first policy set and the updates to it; takes the place of a ``PolicySet``."""

    updates: DataFrame
    first: PolicySet = field(default_factory=PolicySet)
    #: The reviews' column that says which limits were in force.
    time: str = "timestamp"

    def _changes(self, kinds: list[str]) -> DataFrame:
        """Entries of some policy types with the time from which each holds."""
        spark = self.updates.sparkSession
        first = _entries(spark, self.first.policies).select(
            _time(BEGINNING).alias("_from"), F.lit("").alias("update_id"), "*"
        )
        later = self.updates.filter(c("effective_at").isNotNull()).select(
            c("effective_at").alias("_from"), "update_id", "policy_type", "policy_key", "limits"
        )
        return first.unionByName(later).filter(c("policy_type").isin(kinds))

    def _timeline(self, kinds: list[str], limits: dict[str, Column]) -> DataFrame:
        """Per key and time span ``[_from, _to)`` the limits, the last given of each type."""
        last = Window.partitionBy("policy_key").orderBy("_from", "update_id", "policy_type")
        rows = self._changes(kinds).select("*", *[x.alias(n) for n, x in limits.items()])
        if len(kinds) > 1:
            # Each type sets one limit; the others stay as they were.
            rows = rows.withColumns({n: F.last(n, ignorenulls=True).over(last) for n in limits})
        rows = rows.withColumn("_to", F.lead("_from", 1).over(last))
        rows = rows.withColumn("_to", F.coalesce("_to", _time(END)))
        return rows.filter("_from < _to").select(
            c("policy_key").alias("_key"), "_from", "_to", *limits
        )

    @cached_property
    def _span(self) -> tuple[int, int, int]:
        """First and last day of a change, and more rows than a timeline dealt over its days has."""
        day = _day(c("effective_at"))
        low, high, n = self.updates.agg(F.min(day), F.max(day), F.count(F.lit(1))).first()
        low, high = (0, 0) if low is None else (low, high)
        entries = n + sum(len(x) for x in self.first.policies.values())
        return low, high, entries * (high - low + 2)

    def _as_of(self, df: DataFrame, key: Column, timeline: DataFrame) -> DataFrame:
        """Add the limits of ``key`` at each row's time."""
        low, high, most = self._span

        def bin_of(time: Column) -> Column:
            return F.greatest(F.lit(low), F.least(F.lit(high), _day(time)))

        days = timeline.withColumn(
            "_bin", F.explode(F.sequence(bin_of(c("_from")), bin_of(c("_to"))))
        )
        if most <= MAX_POLICY_ROWS:
            days = F.broadcast(days)
        rows = df.withColumns(
            {"_at": F.coalesce(self.time, _time(END) - F.expr("interval 1 second"))}
        ).withColumns({"_asked": key, "_day": bin_of(c("_at"))})
        on = (
            (c("_asked") == c("_key"))
            & (c("_day") == c("_bin"))
            & (c("_at") >= c("_from"))
            & (c("_at") < c("_to"))
        )
        helpers = ["_at", "_asked", "_day", "_key", "_bin", "_from", "_to"]
        return rows.join(days, on, "left").drop(*helpers)

    def _mode_timeline(self) -> DataFrame:
        limits = {
            f"{a}_limit": F.when(c("policy_type") == a, c("limits")[THRESHOLD]) for a in K.ASPECTS
        }
        return self._timeline(list(K.ASPECTS), limits)

    def with_modes(self, df: DataFrame) -> DataFrame:
        return self._as_of(df, c("compliance_mode"), self._mode_timeline())

    def with_standard(self, df: DataFrame) -> DataFrame:
        names = {f"{a}_limit": f"_standard_{a}" for a in K.ASPECTS}
        timeline = self._mode_timeline().filter(c("_key") == "standard")
        return self._as_of(df, F.lit("standard"), timeline.withColumnsRenamed(names))

    def with_regions(self, df: DataFrame) -> DataFrame:
        names = ["max_toxicity", "max_bias"]
        limits = {f"region_{n}": c("limits")[n] for n in names}
        return self._as_of(df, c("region"), self._timeline(["regional_compliance"], limits))

    def with_categories(self, df: DataFrame) -> DataFrame:
        limits = {f"category_max_{a}": c("limits")[f"max_{a}"] for a in K.ASPECTS}
        timeline = self._timeline(["category_restrictions"], limits)
        return self._as_of(df, c("product_category"), timeline)
