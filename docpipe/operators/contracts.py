"""Contract conformance and the older flat contract."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe import schemas
from docpipe.functions.flags import append_flags, collect_flags, flag
from docpipe.functions.keys import stem
from docpipe.functions.text import clean_string, document_type
from docpipe.functions.values import amount, date
from docpipe.streaming.sink import replace_batch


@dataclass(frozen=True)
class Contract:
    name: str
    schema: T.StructType
    required: tuple[str, ...]
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)


_STRATEGIES = ("exact_fingerprint", "business_key", "none")

# Required fields and allowed values of the written contracts.
BRONZE_CONTRACT = Contract(
    "bronze_evidence", schemas.BRONZE_EVIDENCE,
    ("run_id", "document_id", "source_s3_key", "source_file_name", "textract_response",
     "extraction_engine", "extraction_timestamp", "status"),
    {
        "extraction_engine": ("textract_analyze_expense", "local_tesseract_baseline"),
        "status": ("success", "failed"),
    },
)
SILVER_CONTRACT = Contract(
    "silver_document", schemas.SILVER,
    ("run_id", "document_id", "source_s3_key", "source_file_name", "document_type", "extraction_engine",
     "quality_status", "quality_score", "quality_flags", "processing_status", "created_at"),
    {
        "document_type": ("invoice", "receipt", "contribution", "credit_note", "unknown"),
        "processing_status": ("received", "extracted", "normalized", "accepted", "rejected", "failed"),
        "quality_status": ("accepted", "rejected", "warning"),
        "duplicate_strategy": _STRATEGIES,
    },
)
GOLD_CONTRACT = Contract(
    "gold_documents", schemas.GOLD,
    ("run_id", "document_id", "source_s3_key", "source_file_name", "document_type", "processing_status",
     "quality_status", "quality_flags", "document_fingerprint", "business_key", "is_duplicate",
     "duplicate_strategy", "duplicate_confidence", "created_at"),
    {"duplicate_strategy": _STRATEGIES},
)


def conformance_report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per check with the number of violating rows (one aggregate over the data).

    Missing, mistyped and undeclared columns are known from the schema alone and
    count every row.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in contract.schema.fields}
    n = F.count(F.lit(1))
    checks: list[tuple[str, str, object]] = []
    for name in contract.required:
        checks.append(("required", name, F.count_if(F.col(name).isNull()) if name in have else n))
    for name, allowed in contract.enums.items():
        if name in have:
            checks.append(
                ("enum", name, F.count_if(F.col(name).isNotNull() & ~F.col(name).cast("string").isin(*allowed)))
            )
    for name, kind in want.items():
        if name in have:
            same = have[name].simpleString() == kind.simpleString()
            checks.append(("type", name, F.lit(0).cast("bigint") if same else n))
    for name in have:
        if name not in want:
            checks.append(("undeclared", name, n))
    counted = df.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
    rows = [
        F.struct(
            F.lit(contract.name).alias("contract"), F.lit(kind).alias("check"), F.lit(name).alias("column"),
            F.col(f"c{i}").cast("bigint").alias("violations"),
        )
        for i, (kind, name, _) in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*rows)))


def violations(df: DataFrame, contract: Contract) -> Column:
    """What a row breaks, as ``kind:column`` texts in the contract's order; empty if nothing.

    A missing or mistyped column is a violation of every row, as is one the contract does not declare.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    found = []
    for name in contract.required:
        found.append(flag(F.col(name).isNull() if name in have else F.lit(True), f"required:{name}"))
    for name, allowed in contract.enums.items():
        if name in have:
            found.append(flag(F.col(name).isNotNull() & ~F.col(name).cast("string").isin(*allowed), f"enum:{name}"))
    for f in contract.schema.fields:
        if f.name in have and have[f.name].simpleString() != f.dataType.simpleString():
            found.append(flag(F.lit(True), f"type:{f.name}"))
    found += [flag(F.lit(True), f"undeclared:{name}") for name in have if name not in contract.schema.fieldNames()]
    return collect_flags(*found)


def with_violations(df: DataFrame, contract: Contract) -> DataFrame:
    return df.withColumn("violations", violations(df, contract))


def enforce(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, in its columns; rows that break it, with ``violations``)."""
    judged = with_violations(df, contract)
    kept = [c for c in contract.schema.fieldNames() if c in df.columns]
    return judged.filter(F.size("violations") == 0).select(*kept), judged.filter(F.size("violations") > 0)


def write_enforced(df: DataFrame, contract: Contract, path: str, quarantine: str, delivery: int) -> None:
    """Write rows that keep the contract to ``path``; the others, with what they break, only to ``quarantine``.

    The rows are judged in one pass each for the two tables; both are replaced by the same delivery again.
    """
    good, bad = enforce(df, contract)
    replace_batch(bad, quarantine, delivery)
    replace_batch(good, path, delivery)


def legacy_contract(extracted: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """The older 32-field record: its own flags, its own currency rule, nulls elsewhere.

    ``as_of`` is what two-digit years are read from, as in the silver stage.

    Needs source_file, raw_text_path, text, vendor_name, document_date,
    total_amount (texts) and ``flags``.
    """
    staged = extracted.select(
        "source_file", "raw_text_path", "text", "flags",
        F.col("document_date").alias("_date_raw"), F.col("total_amount").alias("_amount_raw"),
        amount(F.col("total_amount")).alias("_amount"),
        (date(F.col("document_date"), as_of) if as_of else date(F.col("document_date"))).alias("_date"),
        clean_string(F.col("vendor_name")).alias("_vendor"),
        document_type(F.col("text")).alias("_type"),
    )
    total, on, vendor, kind = F.col("_amount"), F.col("_date"), F.col("_vendor"), F.col("_type")

    def given(name: str):
        return F.coalesce(F.col(name), F.lit("")) != ""

    flags = append_flags(
        F.col("flags"),
        flag(given("_amount_raw") & total.isNull(), "invalid_total_amount"),
        flag(given("_date_raw") & on.isNull(), "invalid_document_date"),
        flag(total.isNull(), "missing_total_amount"),
        flag(on.isNull(), "missing_document_date"),
        flag(vendor.isNull(), "missing_vendor_or_requester"),
        flag(kind == "unknown", "unknown_document_type"),
    )
    known = {
        "source_file": F.col("source_file"),
        "document_id": stem(F.col("source_file")),
        "document_type": kind,
        "document_date": on,
        "vendor_or_requester": vendor,
        "total_amount": total,
        "amount": total,
        "currency": F.when(F.col("text").contains("$") | total.isNotNull(), F.lit("USD")),
        "raw_text_path": F.col("raw_text_path"),
        "ocr_confidence_flags": flags,
    }
    return staged.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.legacy_fields()]
    )
