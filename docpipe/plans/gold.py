"""The gold table: eligible documents, duplicate marks, fixed columns, semantic views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe import schemas
from docpipe.functions.flags import append_flags, flag
from docpipe.functions.identity import business_key, fingerprint, payload_fingerprint
from docpipe.operators.duplicates import mark_against_history, mark_duplicates
from docpipe.operators.once import evaluate_once
from docpipe.operators.quality import gold_eligible
from docpipe.operators.skew import join_unique

# Documents have no arrival number of their own; storage keys order them.
STORAGE_ORDER = ["run_id", "source_s3_key", "document_id"]


def with_identity(documents: DataFrame, raw_text: str | None = None) -> DataFrame:
    """Add fingerprint and business key; an existing fingerprint is kept.

    Silver dates are ISO text and amounts are doubles, so both enter as they are.
    """
    vendor, total, money = F.col("vendor_name"), F.col("total_amount"), F.col("currency")
    on = F.nullif(F.col("document_date"), F.lit(""))
    number = F.col("invoice_number") if "invoice_number" in documents.columns else None
    existing = F.col("document_fingerprint")
    fallback = payload_fingerprint(vendor, on, total, money, F.col("source_file_name"))
    text = F.col(raw_text) if raw_text else None
    kept = [c for c in documents.columns if c not in ("document_fingerprint", "business_key")]
    named = {
        "document_fingerprint": fingerprint(existing, text, fallback),
        "business_key": business_key(vendor, on, total, money, number),
    }
    return evaluate_once(documents, kept, named).select(*dict.fromkeys([*documents.columns, *named]))


def gold_columns(marked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Check dates again, flag missing critical fields, project to the 25 columns.

    Flags added here leave score and status as they are.
    """
    normal = F.col("document_date").try_cast("date").cast("string")
    given = F.coalesce(F.col("document_date"), F.lit("")) != ""
    flags = append_flags(
        F.col("quality_flags"),
        flag(given & normal.isNull(), "invalid_document_date"),
        *[
            flag(F.coalesce(F.col(c), F.lit("")) == "", f"missing_{c}")
            for c in ("document_id", "source_s3_key", "source_file_name", "document_type")
        ],
    )
    changed = {"document_date": normal, "quality_flags": flags}
    return marked.select(
        *(keep or []), *[changed[c].alias(c) if c in changed else F.col(c) for c in schemas.GOLD_COLUMNS]
    )


def build_gold(
    silver: DataFrame, history: DataFrame | None = None,
    order: list[str] | None = None, raw_text: str | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Gold rows of ``silver``, marked against ``history`` and one another.

    The table is read three times: twice for the narrow key columns, once whole.
    Pass a written table, not the silver stage's own plan (``session.written``).
    """
    order = order or STORAGE_ORDER
    eligible = silver.filter(gold_eligible())
    current = with_identity(eligible, raw_text)
    if history is None:
        marked = mark_duplicates(current, order, population=eligible)
    else:
        past = with_identity(history.filter(gold_eligible()), raw_text)
        marked = mark_against_history(current, past, order)
    return gold_columns(marked, keep)


def consolidate_run(
    silver: DataFrame, run_id: str, order: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Gold rows of one run, with all other runs in the same table as its history.

    The run is part of a record's identity, so "history without the current
    identities, then current" is the table itself with a flag: one scan, no
    anti-join and no union.
    """
    eligible = silver.filter(gold_eligible())
    flagged = with_identity(eligible).withColumn("_current", F.coalesce(F.col("run_id") == run_id, F.lit(False)))
    return gold_columns(mark_duplicates(flagged, order or STORAGE_ORDER, "_current", eligible), keep)


def key_index(gold: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The narrow table later batches are marked against, instead of all history."""
    return gold.select(
        *dict.fromkeys(["run_id", "document_id", "source_s3_key", "document_fingerprint", "business_key",
                        *(order or [])])
    )


def relevant_history(index: DataFrame, current: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Index rows that share a fingerprint or a business key with the current batch.

    Only these can change a mark. A key that fills much of the index is looked
    up by broadcast, all others by key, so no task gets a whole hot key.
    """
    kept = index
    for key in ("document_fingerprint", "business_key"):
        seen = (
            current.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"_in_{key}"))
        )
        kept = join_unique(kept, seen, key, order or STORAGE_ORDER)
    shared = F.col("_in_document_fingerprint").isNotNull() | F.col("_in_business_key").isNotNull()
    return kept.filter(shared).select(*index.columns)


def invoice_summary(gold: DataFrame, typed: bool = False) -> DataFrame:
    """The nine business-named columns. ``typed`` casts date, amount and time."""
    casts = {"invoice_date": "date", "total_amount": "decimal(18,2)", "processing_date": "timestamp"}
    columns = []
    for name, source in schemas.INVOICE_SUMMARY.items():
        value = F.col(source) if source else F.lit(None).cast("decimal(18,2)")
        if typed and name in casts:
            value = value.try_cast(casts[name])
        columns.append(value.alias(name))
    return gold.select(*columns)


def invoice_summary_dedup(gold: DataFrame) -> DataFrame:
    """The semantic view without duplicates, for totals that must not count twice."""
    return invoice_summary(gold.filter(~F.coalesce(F.col("is_duplicate"), F.lit(False))))


def register_views(gold: DataFrame) -> None:
    """Make the gold table and its views known to SQL, under their contract names."""
    contract = gold.withColumnsRenamed(schemas.CONTRACT_NAMES)
    contract.createOrReplaceTempView("gold_documents")
    invoice_summary(gold).createOrReplaceTempView("gold_invoice_summary")
    invoice_summary_dedup(gold).createOrReplaceTempView("gold_invoice_summary_dedup")
