"""Batch consolidation: completeness, gold rows of complete batches, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.operators.duplicates import mark_batches
from docpipe.operators.matching import DOCUMENT_KEY, batch_outcomes, normalize_expected
from docpipe.operators.metrics import share
from docpipe.operators.quality import gold_eligible
from docpipe.plans.gold import STORAGE_ORDER, gold_columns, key_index, with_identity
from docpipe.session import written


def completeness(matched: DataFrame) -> DataFrame:
    """One row per batch of ``match_expected``: counts and its verdict.

    A list with an unusable entry is refused as a whole (``invalid``), before anything is missing from it.
    """
    usable = F.col("problem").isNull()
    missing = F.count_if(usable & F.col("outcome").isNull())
    refused = F.count_if(~usable)
    return matched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("expected_count"),
        F.count_if(F.col("outcome") == "valid").alias("valid_count"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_count"),
        F.count_if(F.col("outcome") == "failed").alias("failed_count"),
        missing.alias("missing_count"),
        refused.alias("invalid_count"),
        F.when(refused > 0, F.lit("invalid")).when(missing > 0, F.lit("incomplete")).otherwise(F.lit("completed")).alias("status"),
        # A batch names its runs in its manifest, so this list is the result itself.
        F.array_sort(F.collect_set(F.when(usable, F.col("run_id")))).alias("run_ids"),
    )


def missing_documents(matched: DataFrame) -> DataFrame:
    """Usable entries without an outcome yet."""
    return matched.filter(F.col("problem").isNull() & F.col("outcome").isNull()).drop("outcome", "problem")


def refused_entries(matched: DataFrame) -> DataFrame:
    """Entries for which their batch is refused, with the reason."""
    return matched.filter(F.col("problem").isNotNull()).drop("outcome")


def match_expected(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every entry of the lists with its outcome, or with the ``problem`` that makes it unusable."""
    entries = normalize_expected(expected)
    return batch_outcomes(entries.filter(F.col("problem").isNull()), outcomes).unionByName(
        entries.filter(F.col("problem").isNotNull()).withColumn("outcome", F.lit(None).cast("string"))
    )


def batch_documents(matched: DataFrame, summary: DataFrame, silver: DataFrame) -> DataFrame:
    """Valid silver documents of complete batches, with their ``batch_id``."""
    complete = summary.filter(F.col("status") == "completed").select("batch_id")
    wanted = (
        matched.filter(F.col("outcome") == "valid").join(complete, "batch_id", "left_semi")
        .select("batch_id", *DOCUMENT_KEY)
    )
    return silver.join(wanted, DOCUMENT_KEY)


def consolidate_batches(
    expected: DataFrame, outcomes: DataFrame, silver: DataFrame, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(gold rows with ``batch_id``, one summary row per batch). Other than complete batches give no gold rows.

    Every batch is marked against all valid documents of ``silver`` but its own, then against itself. The matched list,
    the chosen documents and the key index are written between the steps, because the steps read them several times.
    """
    order = order or STORAGE_ORDER
    matched = written(match_expected(expected, outcomes), "matched")
    summary = completeness(matched)
    eligible = silver.filter(gold_eligible())
    index = written(key_index(with_identity(eligible), order), "key-index")
    documents = written(with_identity(batch_documents(matched, summary, eligible)), "batch-documents")
    return gold_columns(mark_batches(documents, index, order), ["batch_id"]), summary


def manifests(
    gold: DataFrame, summary: DataFrame, created_at: str,
    gold_prefix: str = "gold/documents", manifest_prefix: str = "gold/manifests",
) -> DataFrame:
    """Manifests of complete batches; both sides hold one row per batch."""
    n = F.count(F.lit(1))
    measured = gold.groupBy("batch_id").agg(
        n.alias("gold_row_count"),
        F.count_if("is_duplicate").alias("duplicate_count"),
        (n - F.count("document_date")).alias("missing_date_count"),
        (n - F.count("total_amount")).alias("missing_amount_count"),
        F.count_if("enrichment_invoked").alias("enrichment_invoked_count"),
    )
    joined = summary.filter(F.col("status") == "completed").join(measured, "batch_id", "left")
    counts = ["gold_row_count", "duplicate_count", "missing_date_count", "missing_amount_count",
              "enrichment_invoked_count"]
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    rows = F.col("gold_row_count")
    return filled.select(
        "status", "batch_id", "expected_count", "valid_count", "rejected_count", "failed_count", *counts,
        share(rows - F.col("missing_date_count"), rows).alias("date_completion_rate"),
        share(rows - F.col("missing_amount_count"), rows).alias("amount_completion_rate"),
        "run_ids",
        F.expr("cast(array() as array<string>)").alias("missing_documents"),
        F.lit(created_at).alias("created_at"),
        F.concat(F.lit(gold_prefix.strip("/") + "/batch_id="), "batch_id").alias("parquet_key"),
        F.concat(F.lit(manifest_prefix.strip("/") + "/batch_id="), "batch_id").alias("manifest_key"),
    )
