"""Alarm states over arriving calls: OK or ALARM, and when they change.

Windows of calls close when the watermark passes them, late rows up to then included. Each
closed window goes to the alarms that watch its source. An alarm keeps its last window and how
many windows in a row were breached; a timer at the end of the following window notices
windows without calls, which do not breach. What comes out are the changes of state, equal to
those that ``metrics.alarm_transitions`` finds in the closed windows afterwards.

The state is a few numbers per alarm. Before it the calls are summed per function and window,
so a busy function reaches its alarm as one row per window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from reviewgate.constants import ALARM_RULES
from reviewgate.operators.metrics import MAX_RULES

# Executors need not have this package installed: ship this module by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

c = F.col
OK, ALARM = "OK", "ALARM"
TRANSITIONS = "alarm string, alarm_window timestamp, state_before string, state string, value double"
STATE = "last long, breached int, raised boolean, periods int, seconds long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _time(seconds: int) -> datetime:
    return EPOCH + timedelta(seconds=seconds)


def _change(alarm: str, window: int, raised: bool, value: float | None = None) -> Row:
    before, after = (OK, ALARM) if raised else (ALARM, OK)
    return Row(
        alarm=alarm, alarm_window=_time(window), state_before=before, state=after, value=value
    )


class AlarmStates(StatefulProcessor):
    """One alarm: windows in a row that breached its threshold."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alarm", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed: dict[int, float] = {}
        threshold = periods = seconds = None
        for row in rows:
            threshold, periods, seconds = row.threshold, row.periods, row.seconds
            if row.value is not None:
                closed[row.window_start] = closed.get(row.window_start, 0.0) + row.value
        if not closed:
            return
        last, breached, raised = None, 0, False
        if self.state.exists():
            last, breached, raised, *_ = self.state.get()
            self.handle.deleteTimer((last + 2 * seconds) * 1000)
        for window in sorted(closed):
            if last is not None and window > last + seconds:
                # Windows without calls lie between.
                if raised:
                    yield _change(key[0], last + seconds, False)
                breached, raised = 0, False
            breached = breached + 1 if closed[window] >= threshold else 0
            now = breached >= periods
            if now != raised:
                yield _change(key[0], window, now, closed[window])
            last, raised = window, now
        self.state.update((last, breached, raised, periods, seconds))
        self.handle.registerTimer((last + 2 * seconds) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The window after the last one has ended without calls."""
        last, _, raised, periods, seconds = self.state.get()
        if expiredTimerInfo.getExpiryTimeInMs() != (last + 2 * seconds) * 1000:
            return
        if raised:
            yield _change(key[0], last + seconds, False)
        self.state.update((last, 0, False, periods, seconds))

    def close(self) -> None:
        pass


def _values(calls: DataFrame, window: str, delay: str) -> DataFrame:
    """Closed windows in long form; a function's errors count for the workflow, too."""
    sums = (
        calls.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("window"), "function")
        .agg(
            F.count(F.lit(1)).alias("invocations"),
            F.count_if(c("is_error")).alias("errors"),
            F.avg("duration_ms").alias("mean_duration_ms"),
        )
    )
    value = lambda source, metric, x: F.struct(
        source.alias("source"), F.lit(metric).alias("metric"), x.cast("double").alias("value")
    )
    own = [value(c("function"), x, c(x)) for x in ("invocations", "errors", "mean_duration_ms")]
    own.append(value(F.lit("workflow"), "errors", c("errors")))
    return sums.select(
        F.window_time("window").alias("at"),
        F.unix_timestamp("window.start").alias("window_start"),
        (F.unix_timestamp("window.end") - F.unix_timestamp("window.start")).alias("seconds"),
        F.inline(F.array(*own)),
    )


def alarm_changes(
    calls: DataFrame,
    window: str = "5 minutes",
    delay: str = "10 minutes",
    rules: list[tuple[str, str, str, float, int]] | None = None,
) -> DataFrame:
    """Changes of state of all alarms over a stream of calls."""
    rules = ALARM_RULES if rules is None else rules
    names, sources, metrics, thresholds, periods = zip(*rules)
    table = calls.sparkSession.createDataFrame(
        pa.table(
            {
                "alarm": pa.array(names, pa.string()),
                "source": pa.array(sources, pa.string()),
                "metric": pa.array(metrics, pa.string()),
                "threshold": pa.array(thresholds, pa.float64()),
                "periods": pa.array(periods, pa.int32()),
            }
        )
    )
    hinted = F.broadcast(table) if len(rules) <= MAX_RULES else table
    watched = _values(calls, window, delay).join(hinted, ["source", "metric"])
    return watched.groupBy("alarm").transformWithState(
        statefulProcessor=AlarmStates(),
        outputStructType=TRANSITIONS,
        outputMode="Append",
        timeMode="EventTime",
    )


@contextmanager
def _rocksdb(spark: SparkSession):
    """Keyed state with timers needs this state store; it is fixed when a query starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def start_alarm_states(
    calls: DataFrame,
    out: str,
    checkpoint: str,
    window: str = "5 minutes",
    delay: str = "10 minutes",
    rules: list[tuple[str, str, str, float, int]] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the changes of alarm states to a parquet folder, by default of everything
    there is; with ``trigger`` as long as the query runs."""
    with _rocksdb(calls.sparkSession):
        return (
            alarm_changes(calls, window, delay, rules)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
