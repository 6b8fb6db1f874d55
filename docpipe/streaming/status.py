"""Invoice status over micro-batches: forward only, with a time limit and a state that expires."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.operators.status import STATUS_ORDER, forward_status
from docpipe.sources import versions
from docpipe.streaming.sink import replace_batch

TERMINAL = tuple(s for s, step in STATUS_ORDER.items() if step == max(STATUS_ORDER.values()))
TIMED_OUT = "Failed"
STUCK_AFTER, KEEP_FOR = "1 day", "7 days"
KEY = ["invoice_id"]


def _older(than: str, now: Column) -> Column:
    return F.col("updated_at") < now - F.expr(f"INTERVAL {than}")


def status_batches(
    live_path: str, changes_path: str, order: list[str], stuck_after: str = STUCK_AFTER, keep_for: str = KEEP_FOR,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: status events to changes, by a live table that stays small.

    ``live_path`` gets, per epoch, the whole live state after it: every invoice that is not finished, and finished ones for
    ``keep_for`` so that late events cannot reopen them. Time is the latest event seen so far. An invoice without an event
    for ``stuck_after`` fails by itself (``timed_out``). A batch reads the state of the epoch before only, so its cost
    follows the open invoices and not the history. ``changes_path`` gets the rows that changed. Both are replaced per
    epoch, so a replay gives the same rows.

    ``order`` names columns of the events that order them, ``updated_at`` (a timestamp) first.
    """
    columns = ["invoice_id", "status", *order]

    def work(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        events = batch.select(*columns).withColumn("timed_out", F.lit(False))
        past = live_state(spark, live_path, epoch)
        known = events if past is None else past.select(*columns, "timed_out").unionByName(events)
        clock = known.agg(F.max("updated_at")) if past is None else known.select("updated_at").union(past.select("seen_until")).agg(F.max("updated_at"))
        now = F.lit(clock.first()[0])
        best = forward_status(known, KEY, order)
        stuck = ~F.col("status").isin(*TERMINAL) & _older(stuck_after, now)
        after = best.select(
            "invoice_id", F.when(stuck, F.lit(TIMED_OUT)).otherwise(F.col("status")).alias("status"), *order,
            (F.col("timed_out") | stuck).alias("timed_out"), now.alias("seen_until"),
        ).persist()
        kept = after.filter(~(F.col("status").isin(*TERMINAL) & _older(keep_for, now)))
        changed = after.drop("seen_until")
        if past is not None:
            same = past.select(F.col("invoice_id").alias("_id"), F.struct("status", *order, "timed_out").alias("_was"))
            changed = changed.join(
                same, (F.col("invoice_id") == F.col("_id")) & F.struct("status", *order, "timed_out").eqNullSafe(F.col("_was")), "left_anti"
            )
        replace_batch(changed, changes_path, epoch)
        replace_batch(kept, live_path, epoch)
        after.unpersist()

    return work


def live_state(spark: SparkSession, live_path: str, before: int | None = None) -> DataFrame | None:
    """The live table after the last epoch (before the given one)."""
    epochs = [e for e in versions.deliveries(spark, live_path) if before is None or e < before]
    return spark.read.parquet(f"{live_path}/epoch={epochs[-1]}") if epochs else None


def last_changes(spark: SparkSession, changes_path: str) -> DataFrame | None:
    """Every invoice's last change."""
    return versions.read_current(spark, changes_path, KEY)
