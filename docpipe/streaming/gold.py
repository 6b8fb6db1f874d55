"""Gold consolidation as soon as documents are accepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.operators.duplicates import IDENTITY, mark_against_history, mark_duplicates
from docpipe.operators.quality import gold_eligible
from docpipe.plans.gold import STORAGE_ORDER, gold_columns, key_index, with_identity
from docpipe.session import written
from docpipe.sources import versions
from docpipe.streaming.sink import replace_batch

KINDS = ("document_fingerprint", "business_key")
COMPACT_EVERY = 32  # micro-batches


def keyed_index(documents: DataFrame, order: list[str]) -> DataFrame:
    """The key index with one row per document and key, so that either key finds its bucket."""
    rows = key_index(documents, order)
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KINDS])
    return rows.withColumn("_k", F.explode(keys)).filter(F.col("_k.key").isNotNull()).select("_k.kind", "_k.key", *rows.columns)


def gold_batches(
    gold_path: str, index_path: str, order: list[str] | None = None, buckets: int = versions.BUCKETS, compact_every: int = COMPACT_EVERY
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: silver micro-batches to marked gold rows.

    Earlier micro-batches are known through a stored key index in buckets. A batch reads the buckets of its own keys and
    takes on only rows that share a key with it, so neither grows with history beyond those buckets. Only epochs before
    this one count as history, and both tables are replaced per epoch, so a replay gives the same rows. Gold goes
    first: a batch that stops between the writes is replayed as a whole. Every ``compact_every`` epochs the finished
    ones are merged, so the files of a bucket stay few.
    """
    order = order or STORAGE_ORDER
    full = ["kind", "key", *IDENTITY]

    def work(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch and epoch % compact_every == 0:
            versions.compact(spark, index_path, full, by=["kind", "key"], buckets=buckets, upto=epoch - 1)
        current = with_identity(batch.filter(gold_eligible())).persist()
        entries = keyed_index(current, order)
        past = versions.read_current(
            spark, index_path, full, before=epoch, keys=entries.select("kind", "key").distinct(), buckets=buckets
        )
        if past is None:
            marked = mark_duplicates(current, order)
        else:
            # Read four times by the marking; as a plan it would be made, with all its joins, as often.
            history = written(past.select(*key_index(current, order).columns).distinct(), "batch-history")
            marked = mark_against_history(current, history, order)
        replace_batch(gold_columns(marked, [c for c in order if c not in STORAGE_ORDER]), gold_path, epoch)
        versions.put(entries, index_path, epoch, ["kind", "key"], buckets)
        current.unpersist()

    return work
