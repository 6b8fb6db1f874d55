"""Continuous ingest: arrivals, once each, validated, built into silver, routed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.operators.matching import DOCUMENT_KEY, not_yet_processed
from docpipe.operators.status import forward_status
from docpipe.operators.validation import validate_arrivals
from docpipe.plans.silver import outcome
from docpipe.sources import versions
from docpipe.streaming.sink import replace_batch

# Message retention, and failed deliveries before a message is set aside.
RETENTION = "1 day"
MAX_DELIVERIES = 3


def once_each(arrivals: DataFrame, key: list[str], arrived: str = "arrived_at") -> DataFrame:
    """Drop re-deliveries within the retention time.

    ``arrived`` must be the time of arrival, not a date inside the document:
    late rows are dropped, and arrival time is never late.
    """
    return arrivals.withWatermark(arrived, RETENTION).dropDuplicatesWithinWatermark(key)


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(folder) else None


def ingest_batches(
    build_silver: Callable[[DataFrame], DataFrame], silver_path: str, rejected_arrivals_path: str,
    done_path: str | None = None, buckets: int = versions.BUCKETS, compact_every: int = 32,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: arrivals to silver, invalid arrivals aside.

    Documents that already have a valid output from an *earlier* micro-batch are
    skipped, so a re-delivery after the retention time is harmless too; the
    batch's own epoch is left out of that check so that a replay rewrites it.
    They are known by a key table in buckets (``done_path``, by default beside
    silver), of which a batch reads the buckets of its own documents; silver
    itself is never read. Both are written per epoch, silver first.
    """
    done_path = done_path or f"{silver_path.rstrip('/')}-done"

    def work(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch and epoch % compact_every == 0:
            versions.compact(spark, done_path, DOCUMENT_KEY, buckets=buckets, upto=epoch - 1)
        checked = validate_arrivals(batch).persist()
        replace_batch(checked.filter(~F.col("valid")), rejected_arrivals_path, epoch)
        todo = checked.filter("valid").drop("valid", "errors")
        asked = todo.select(*DOCUMENT_KEY).distinct()
        done = versions.read_current(spark, done_path, DOCUMENT_KEY, before=epoch, keys=asked, buckets=buckets)
        if done is not None:
            todo = not_yet_processed(todo, done)
        silver = build_silver(todo).withColumn("outcome", outcome())
        replace_batch(silver, silver_path, epoch, "outcome")
        written = table_or_none(spark, f"{silver_path}/epoch={epoch}/outcome=valid")
        if written is not None:
            versions.put(written.select(*DOCUMENT_KEY), done_path, epoch, DOCUMENT_KEY, buckets)
        checked.unpersist()

    return work


def retry_ledger(
    ledger_path: str, letters_path: str, key: list[str], order: list[str], limit: int = MAX_DELIVERIES,
    buckets: int = versions.BUCKETS, compact_every: int = 32,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: failed deliveries counted over micro-batches, each message set aside once.

    The ledger keeps a message's failures so far and its last error (by ``order``, the first of it the time). A batch
    reads the buckets of its own messages, adds its failures, and sets aside those that reach ``limit`` with this
    batch. Ledger and letters are written per epoch from earlier epochs, so a replay sets the same messages aside.
    """
    last = F.max_by("error", F.struct(*order))

    def work(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch and epoch % compact_every == 0:
            versions.compact(spark, ledger_path, key, buckets=buckets, upto=epoch - 1)
        new = batch.filter("failed").groupBy(*key).agg(
            F.count(F.lit(1)).alias("added"), last.alias("error"), F.max(F.struct(*order)).alias("_at")
        ).select(*key, "added", "error", *[F.col(f"_at.{c}").alias(c) for c in order]).persist()
        past = versions.read_current(spark, ledger_path, key, before=epoch, keys=new.select(*key), buckets=buckets)
        if past is None:
            counted = new.select(*key, F.lit(0).cast("bigint").alias("before"), F.col("added").alias("failures"), "error", *order)
        else:
            known = past.select(*key, F.col("failures").alias("_f"), F.col("error").alias("_e"), F.struct(*order).alias("_o"))
            at = F.struct(*order)
            newer = F.col("_o").isNull() | (at > F.col("_o"))
            counted = new.join(known, key, "left").select(
                *key, F.coalesce("_f", F.lit(0)).alias("before"), (F.col("added") + F.coalesce("_f", F.lit(0))).alias("failures"),
                F.when(newer, F.col("error")).otherwise(F.col("_e")).alias("error"),
                *[F.when(newer, F.col(c)).otherwise(F.col(f"_o.{c}")).alias(c) for c in order],
            )
        counted = counted.persist()
        reached = counted.filter((F.col("before") < limit) & (F.col("failures") >= limit))
        replace_batch(reached.select(*key, "failures", F.col("error").alias("last_error")), letters_path, epoch)
        versions.put(counted.drop("before"), ledger_path, epoch, key, buckets)
        counted.unpersist(), new.unpersist()

    return work


def dead_letters(deliveries: DataFrame, key: list[str], order: list[str], limit: int = MAX_DELIVERIES) -> DataFrame:
    """Messages whose failed deliveries reached the limit, with the last error.

    ``deliveries`` has ``failed`` and ``error``. Works on a batch and, in update
    or complete mode, on a stream.
    """
    failed = deliveries.filter("failed").groupBy(*key).agg(
        F.count(F.lit(1)).alias("failures"), F.max_by("error", F.struct(*order)).alias("last_error")
    )
    return failed.filter(F.col("failures") >= limit)


def status_updates(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Forward-only status per invoice as a streaming aggregate (update or complete mode)."""
    return forward_status(events, key, order)
