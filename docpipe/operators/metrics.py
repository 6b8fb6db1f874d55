"""Run, document and statement metrics. Each report is one pass with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Completion rate per measured column.
RATE_NAMES = {
    "total_amount": "amount_completion_rate",
    "document_date": "date_completion_rate",
    "vendor_name": "vendor_completion_rate",
    "currency": "currency_completion_rate",
}


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _rates(columns=tuple(RATE_NAMES)) -> list[Column]:
    n = F.count(F.lit(1))
    return [share(F.count(c), n).alias(RATE_NAMES[c]) for c in columns]


def _unknown_rate() -> Column:
    return share(F.count_if(F.col("document_type") == "unknown"), F.count(F.lit(1))).alias(
        "unknown_document_type_rate"
    )


def completion_metrics(gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, four completion rates and the unknown-type rate; zeros when empty."""
    return gold.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *_rates(), _unknown_rate())


def preview_metrics(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count(F.lit(1)).alias("rows"), *_rates(("vendor_name", "document_date", "total_amount"))
    )


def silver_completion(silver: DataFrame) -> DataFrame:
    return silver.agg(F.count(F.lit(1)).alias("rows"), *_rates())


def type_counts(documents: DataFrame) -> DataFrame:
    """Documents per type; null is a type of its own."""
    return documents.groupBy("document_type").agg(F.count(F.lit(1)).alias("documents"))


def flag_counts(documents: DataFrame) -> DataFrame:
    return (
        documents.select(F.explode("quality_flags").alias("flag"))
        .groupBy("flag").agg(F.count(F.lit(1)).alias("documents"))
    )


def run_metrics(outcomes: DataFrame) -> DataFrame:
    """Per run: outcome counts, success rate, seconds per document, documents per minute.

    ``outcomes`` has run_id, outcome and duration_seconds. Elapsed time is the
    summed processing time; pass ``elapsed_seconds`` on the rows to override it.
    """
    total = F.count(F.lit(1))
    succeeded = F.count_if(F.col("outcome") == "valid")
    elapsed = F.max("elapsed_seconds") if "elapsed_seconds" in outcomes.columns else F.sum("duration_seconds")
    return outcomes.groupBy("run_id").agg(
        total.alias("total"),
        succeeded.alias("succeeded"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        share(succeeded, total).alias("success_rate"),
        elapsed.alias("elapsed_seconds"),
        F.avg("duration_seconds").alias("avg_doc_seconds"),
        F.min("duration_seconds").alias("min_doc_seconds"),
        F.max("duration_seconds").alias("max_doc_seconds"),
        share(succeeded * 60.0, elapsed).alias("docs_per_minute"),
    )


def extraction_metrics(extractions: DataFrame) -> DataFrame:
    """Per run: extraction successes, failures, rate and documents per second."""
    total = F.count(F.lit(1))
    succeeded = F.count_if(F.col("status") == "success")
    elapsed = F.sum("duration_seconds")
    return extractions.groupBy("run_id").agg(
        total.alias("total"), succeeded.alias("succeeded"), (total - succeeded).alias("failed"),
        share(succeeded, total).alias("success_rate"), elapsed.alias("elapsed_seconds"),
        share(succeeded.cast("double"), elapsed).alias("docs_per_second"),
    )


def run_summary(silver: DataFrame) -> DataFrame:
    """Per run: received, processed, accepted, rejected, failed and the quality of its gold rows.

    One grouped pass: gold rows of a run are its accepted documents, so their
    rates are conditional counts over the same rows.
    """
    accepted = F.col("outcome") == "valid"
    n_accepted = F.count_if(accepted)
    n_rejected = F.count_if(F.col("outcome") == "rejected")
    return silver.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("documents_received"),
        (n_accepted + n_rejected).alias("documents_processed"),
        n_accepted.alias("documents_accepted"),
        n_rejected.alias("documents_rejected"),
        F.count_if(F.col("outcome") == "failed").alias("documents_failed"),
        F.sum("duration_seconds").alias("elapsed_seconds_total"),
        *[
            share(F.count_if(accepted & F.col(c).isNotNull()), n_accepted).alias(name)
            for c, name in RATE_NAMES.items()
        ],
        share(F.count_if(accepted & (F.col("document_type") == "unknown")), n_accepted).alias(
            "unknown_document_type_rate"
        ),
        F.count_if((F.col("outcome") == "rejected") & F.col("rejection_reason").isNull()).alias(
            "rejected_without_reason"
        ),
        F.count_if(accepted & (F.col("document_id").isNull() | F.col("source_s3_key").isNull()
                               | F.col("source_file_name").isNull() | F.col("document_type").isNull())).alias(
            "critical_errors_in_gold"
        ),
        F.lit(0.0).alias("estimated_textract_cost"),
        F.lit(0.0).alias("estimated_bedrock_cost"),
        F.lit(0.0).alias("estimated_total_cost"),
    )


# Acceptance checks as (measure, comparison, limit).
ACCEPTANCE = {
    "documents_processed_rate": (">=", 0.95),
    "technical_failure_rate": ("<=", 0.05),
    "vendor_completion_rate": (">=", 0.85),
    "date_completion_rate": (">=", 0.85),
    "amount_completion_rate": (">=", 0.90),
    "unknown_document_type_rate": ("<=", 0.20),
    "rejected_without_reason": ("<=", 0.0),
    "critical_errors_in_gold": ("<=", 0.0),
}


def acceptance_gate(summary: DataFrame, limits=ACCEPTANCE) -> DataFrame:
    """One row per run and check: measured value, limit and verdict."""
    received = F.col("documents_received")
    measured = summary.withColumns(
        {
            "documents_processed_rate": share(F.col("documents_processed"), received),
            "technical_failure_rate": share(F.col("documents_failed"), received),
        }
    )
    checks = []
    for name, (comparison, limit) in limits.items():
        value = F.col(name).cast("double")
        passed = value >= limit if comparison == ">=" else value <= limit
        checks.append(
            F.struct(
                F.lit(name).alias("check"), value.alias("value"), F.lit(comparison).alias("comparison"),
                F.lit(float(limit)).alias("limit"), passed.alias("passed"),
            )
        )
    return measured.select("run_id", F.inline(F.array(*checks)))


def document_metrics(documents: DataFrame) -> DataFrame:
    """Long form ``(run_id, document_id, metric_name, value, unit)`` of per-document counts."""
    status = F.col("processing_status")
    present = {
        "DocumentsProcessed": F.lit(True),
        "DocumentsAccepted": status == "accepted",
        "DocumentsRejected": status == "rejected",
        "DocumentsFailed": status == "failed",
        "VendorFieldPresent": F.coalesce(F.col("vendor_name"), F.lit("")) != "",
        "DateFieldPresent": F.coalesce(F.col("document_date"), F.lit("")) != "",
        "AmountFieldPresent": F.col("total_amount").isNotNull(),
        "UnknownDocumentType": F.col("document_type") == "unknown",
    }
    names = F.array_except(
        F.array(*[F.when(test, F.lit(name)) for name, test in present.items()]),
        F.array(F.lit(None).cast("string")),
    )
    return documents.select(
        "run_id", "document_id", F.explode(names).alias("metric_name"),
        F.lit(1.0).alias("value"), F.lit("Count").alias("unit"),
    )


def metric_rollup(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run_id", "metric_name").agg(F.sum("value").alias("value"))


METRIC_NAMES = (
    "DocumentsProcessed", "DocumentsAccepted", "DocumentsRejected", "DocumentsFailed",
    "VendorFieldPresent", "DateFieldPresent", "AmountFieldPresent", "UnknownDocumentType",
)


def metric_table(metrics: DataFrame) -> DataFrame:
    """Wide form: one column per metric (the list of metrics is fixed, so no extra pass)."""
    return metrics.groupBy("run_id").pivot("metric_name", list(METRIC_NAMES)).agg(F.sum("value"))


def statement_telemetry(log: DataFrame, budget_ms: int = 10_000) -> DataFrame:
    """Statements per status: count, mean and longest time, scanned volume, against the budget."""
    mean = F.avg("execution_time_ms")
    return log.groupBy("status").agg(
        F.count(F.lit(1)).alias("statements"), mean.alias("mean_ms"),
        F.max("execution_time_ms").alias("max_ms"), F.sum("scan_mb").alias("scan_mb"),
        (mean <= budget_ms).alias("within_budget"),
    )
