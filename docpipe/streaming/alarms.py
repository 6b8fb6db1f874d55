"""Five-minute alarms over metric events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.sources import versions

# Alarm period and thresholds.
PERIOD, _SECONDS = "5 minutes", 300
MAX_FAILURES = 0
MAX_UNKNOWN_RATE = 0.2


def alarm_windows(events: DataFrame, at: str = "ts", lateness: str | None = "10 minutes") -> DataFrame:
    """Windows with their failure sum, unknown-type rate and alarms.

    ``events`` has ``failed`` and ``unknown`` as 0/1 (null: not measured). A
    period without data has no row (``with_calendar`` adds them). The same
    expression serves a batch (``lateness`` None) and a stream in append mode.
    """
    timed = events if lateness is None else events.withWatermark(at, lateness)
    windows = timed.groupBy(F.window(at, PERIOD).alias("_w")).agg(
        F.sum("failed").cast("bigint").alias("failures"), F.avg("unknown").alias("unknown_rate")
    )
    return windows.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        "failures", "unknown_rate",
        F.coalesce(F.col("failures") > MAX_FAILURES, F.lit(False)).alias("failures_alarm"),
        F.coalesce(F.col("unknown_rate") > MAX_UNKNOWN_RATE, F.lit(False)).alias("unknown_rate_alarm"),
    )


def calendar(first: Column, last: Column) -> Column:
    """Starts of the periods from that of ``first`` to that of ``last``."""
    period = F.expr(f"INTERVAL {PERIOD}")
    begin = F.timestamp_seconds(F.floor(F.unix_timestamp(first) / _SECONDS) * _SECONDS)
    return F.sequence(begin, F.timestamp_seconds(F.floor(F.unix_timestamp(last) / _SECONDS) * _SECONDS), period)


def with_calendar(windows: DataFrame, first: dt.datetime | None = None, last: dt.datetime | None = None) -> DataFrame:
    """Every period between the first and the last one, those without data as OK with no failures.

    ``first`` and ``last`` default to the windows' own. The calendar has one row a period and is made on the executors.
    """
    span = windows.agg(
        F.coalesce(F.lit(first).cast("timestamp"), F.min("window_start")).alias("first"),
        F.coalesce(F.lit(last).cast("timestamp"), F.max("window_start")).alias("last"),
    ).filter(F.col("first").isNotNull())
    periods = span.select(F.explode(calendar(F.col("first"), F.col("last"))).alias("window_start"))
    met = periods.join(windows.drop("window_end"), "window_start", "left")
    return met.select(
        "window_start", (F.col("window_start") + F.expr(f"INTERVAL {PERIOD}")).alias("window_end"),
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), "unknown_rate",
        F.coalesce("failures_alarm", F.lit(False)).alias("failures_alarm"),
        F.coalesce("unknown_rate_alarm", F.lit(False)).alias("unknown_rate_alarm"),
    )


def alarm_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for ``alarm_windows`` in update mode: every window as far as it is known.

    Each micro-batch writes the windows it changed below its epoch; ``latest_windows`` takes the newest state of each. So
    the last windows are there as soon as their events are, without waiting for a watermark that a stream without
    further events never passes, and a replay replaces itself.
    """

    def work(windows: DataFrame, epoch: int) -> None:
        versions.put(windows, path, epoch, ["window_start"])

    return work


def latest_windows(spark: SparkSession, path: str) -> DataFrame | None:
    rows = versions.read_current(spark, path, ["window_start"])
    return None if rows is None else rows.drop("epoch", versions.BUCKET)


def raised(windows: DataFrame) -> DataFrame:
    return windows.filter(F.col("failures_alarm") | F.col("unknown_rate_alarm"))
