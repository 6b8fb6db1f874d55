"""The named questions asked of gold, and the bounded-result helper."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ROWS, MAX_ROWS = 100, 1000


def bounded(df: DataFrame, rows: int = DEFAULT_ROWS) -> DataFrame:
    """A result for reading: 100 rows unless asked otherwise, never more than 1000."""
    if rows > MAX_ROWS:
        raise ValueError(f"at most {MAX_ROWS} rows")
    return df.limit(rows)


def documents_per_vendor(gold: DataFrame) -> DataFrame:
    return gold.groupBy("vendor_name").agg(F.count("document_id").alias("documents"))


def latest_batch_per_vendor(gold: DataFrame) -> DataFrame:
    """Accepted documents per vendor in the latest batch, found by one aggregate.

    For a table of the catalog, ``catalog.latest_batch`` finds it in the partition names instead.
    """
    latest = gold.agg(F.max("batch_id")).scalar()
    rows = gold.filter((F.col("batch_id") == latest) & (F.col("processing_status") == "accepted"))
    return rows.groupBy("vendor_name").agg(F.count("document_id").alias("documents"))


def vendor_spend(gold: DataFrame, vendor: str, first: str, last: str) -> DataFrame:
    """Spend and invoice count with one vendor between two ISO dates, both included."""
    rows = gold.filter(
        (F.lower("vendor_name") == vendor.lower()) & F.col("document_date").between(first, last)
    )
    return rows.agg(F.sum("total_amount").alias("total"), F.count("document_id").alias("invoices"))


def total_spend(summary: DataFrame, per_currency: bool = False) -> DataFrame:
    keys = ["currency"] if per_currency else []
    return summary.groupBy(*keys).agg(F.sum("total_amount").alias("total_spend"))


def top_suppliers(summary: DataFrame, n: int = 5, month: str | None = None) -> DataFrame:
    """Largest suppliers by amount, names breaking ties; ``month`` as ``YYYY-MM``."""
    rows = summary if month is None else summary.filter(F.col("invoice_date").startswith(month))
    totals = rows.groupBy("supplier_name").agg(F.sum("total_amount").alias("total_amount"))
    return totals.orderBy(F.desc_nulls_last("total_amount"), F.asc_nulls_last("supplier_name")).limit(n)


def processed_in_last(summary: DataFrame, unit: str, as_of: dt.date) -> DataFrame:
    """Invoices processed in the calendar month or week before ``as_of``."""
    this = F.date_trunc(unit, F.lit(as_of).cast("timestamp"))
    back = F.expr("INTERVAL 1 MONTH") if unit == "month" else F.expr("INTERVAL 7 DAYS")
    # Processing times are ISO text, so the bounds compare as text and can be pushed down.
    pattern = "yyyy-MM-dd"
    inside = (F.col("processing_date") >= F.date_format(this - back, pattern)) & (
        F.col("processing_date") < F.date_format(this, pattern)
    )
    return summary.filter(inside).agg(F.count("invoice_id").alias("invoices"))


def invoices_with_status(latest: DataFrame, status: str = "Failed") -> DataFrame:
    return latest.filter(F.col("status") == status)


def invoice_count(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("invoice_id").alias("invoices"))


def total_by_supplier(summary: DataFrame) -> DataFrame:
    return summary.groupBy("supplier_name").agg(
        F.sum("total_amount").alias("total_amount"), F.count("invoice_id").alias("invoices")
    )


def invoices_by_currency(summary: DataFrame) -> DataFrame:
    return summary.groupBy("currency").agg(F.count("invoice_id").alias("invoices"))
