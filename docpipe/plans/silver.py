"""Silver documents from extracted text or from evidence candidates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe import schemas
from docpipe.functions.flags import append_flags, flag, has_any, no_flags
from docpipe.functions.keys import storage_key
from docpipe.functions.text import clean_string, document_type
from docpipe.functions.values import amount, currency, date
from docpipe.operators.matching import candidates_from_evidence
from docpipe.operators.once import evaluate_once
from docpipe.operators.quality import (
    BLOCKING_FLAGS,
    DEFAULT_RULES,
    QualityRules,
    apply_quality_rules,
)


# Engine names recorded in the documents.
TEXT_ENGINE, TEXT_NORMALIZER = "local_tesseract", "local_ollama"
EVIDENCE_ENGINE, ENRICHED, PLAIN, BATCH_NORMALIZER = (
    "textract_analyze_expense", "bedrock", "textract_only", "glue_normalize",
)


def template_defaults() -> dict[str, Column]:
    """Defaults of the canonical document; every other field starts as null."""
    return {
        "document_type": F.lit("unknown"),
        "enrichment_invoked": F.lit(False),
        "enrichment_completed_fields": no_flags(),
        "processing_status": F.lit("normalized"),
        "quality_status": F.lit("accepted"),
        "quality_score": F.lit(1.0),
        "quality_flags": no_flags(),
        "is_duplicate": F.lit(False),
        "duplicate_strategy": F.lit("none"),
        "duplicate_confidence": F.lit(0.0),
    }


def conform(df: DataFrame, given: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Project onto the silver layout: given columns, template defaults, nulls."""
    defaults = template_defaults()
    columns = [
        given.get(f.name, defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in schemas.SILVER.fields
    ]
    return df.select(*(keep or []), *columns)


def _build(
    staged: DataFrame, given: dict[str, Column], as_of: dt.date, rules: QualityRules, keep: list[str]
) -> DataFrame:
    """Shared tail: failed rows fall back to the template, then the rules run.

    A failed document is the same projection with its extracted values masked,
    not a separate branch of the plan.
    """
    failed = F.col("_failed")
    masked = {
        "document_type": F.when(failed, F.lit("unknown")).otherwise(given["document_type"]),
        "processing_status": F.when(failed, F.lit("failed")).otherwise(F.lit("normalized")),
    }
    for name in ("vendor_name", "document_date", "total_amount", "currency", "document_type_confidence",
                 "vendor_confidence", "document_date_confidence", "total_amount_confidence", "currency_confidence"):
        if name in given:
            masked[name] = F.when(~failed, given[name])
    return apply_quality_rules(conform(staged, {**given, **masked}, keep), as_of, rules)


def silver_from_text(
    extracted: DataFrame, as_of: dt.date, rules: QualityRules = DEFAULT_RULES,
    model_id: str | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Silver documents from text extraction.

    Needs run_id, document_id, source_s3_key, source_file_name, raw_text_path,
    raw_text, created_at and the extracted texts vendor_name, document_date,
    total_amount, currency, with ``flags``. Rows whose flags block, or name a
    technical failure, become failed documents. ``keep`` passes columns through.
    """
    keep = keep or []
    ids = ["run_id", "document_id", "source_s3_key", "source_file_name", "raw_text_path", "created_at"]
    vendor = F.col("vendor_name")
    if "vendor_or_requester" in extracted.columns:
        vendor = F.coalesce(F.nullif(vendor, F.lit("")), F.col("vendor_or_requester"))
    staged = evaluate_once(
        extracted,
        list(dict.fromkeys([*keep, *ids])),
        {
            "_failed": has_any(F.col("flags"), (*BLOCKING_FLAGS, *rules.technical_flags)),
            "_flags_in": F.col("flags"),
            "_type": document_type(F.col("raw_text")),
            "_vendor": clean_string(vendor),
            "_date": date(F.col("document_date"), as_of),
            "_amount": amount(F.col("total_amount")),
            "_text": F.col("raw_text"),
            "_currency": F.col("currency"),
        },
    )
    given = {
        **{name: F.col(name) for name in ids},
        "document_type": F.col("_type"),
        "vendor_name": F.col("_vendor"),
        "document_date": F.col("_date"),
        "total_amount": F.col("_amount"),
        "currency": currency(F.col("_text"), F.col("_currency"), F.col("_amount")),
        "extraction_engine": F.lit(TEXT_ENGINE),
        "normalization_engine": F.lit(TEXT_NORMALIZER),
        "llm_model_id": F.lit(model_id),
        # This path reports a missing date ahead of the rules.
        "quality_flags": append_flags(
            F.col("_flags_in"), flag(F.col("_date").isNull() & ~F.col("_failed"), "missing_document_date")
        ),
    }
    return _build(staged, given, as_of, rules, keep)


def silver_from_candidates(
    candidates: DataFrame, as_of: dt.date, rules: QualityRules = DEFAULT_RULES,
    normalization_engine: str | None = None, model_id: str | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Silver documents from evidence candidates, enriched or not.

    ``failed`` (optional) marks documents whose extraction failed.
    """
    keep = keep or []
    ids = ["run_id", "document_id", "source_s3_key", "source_file_name", "created_at"]
    have = set(candidates.columns)
    failed = F.col("failed") if "failed" in have else F.lit(False)
    scores = ["document_type_confidence", "vendor_confidence", "document_date_confidence",
              "total_amount_confidence", "currency_confidence"]
    invoked = F.col("enrichment_invoked") if "enrichment_invoked" in have else F.lit(False)
    completed = F.col("enrichment_completed_fields") if "enrichment_completed_fields" in have else no_flags()
    engine = (
        F.lit(normalization_engine) if normalization_engine
        else F.when(invoked, F.lit(ENRICHED)).otherwise(F.lit(PLAIN))
    )
    staged = evaluate_once(
        candidates,
        list(dict.fromkeys([*keep, *ids, *scores])),
        {
            "_failed": failed, "_invoked": invoked, "_completed": completed, "_engine": engine,
            "_flags_in": F.coalesce("quality_flags", no_flags()),
            "_type": F.coalesce(F.nullif(F.col("document_type"), F.lit("")), F.lit("unknown")),
            "_vendor": clean_string(F.col("vendor_name")),
            "_date": date(F.col("document_date"), as_of),
            "_amount": amount(F.col("total_amount")),
            "_text": F.col("raw_text"),
            "_currency": F.col("currency"),
        },
    )
    given = {
        **{name: F.col(name) for name in (*ids, *scores)},
        "document_type": F.col("_type"),
        "vendor_name": F.col("_vendor"),
        "document_date": F.col("_date"),
        "total_amount": F.col("_amount"),
        "currency": currency(F.col("_text"), F.col("_currency"), F.col("_amount")),
        "extraction_engine": F.lit(EVIDENCE_ENGINE),
        "normalization_engine": F.col("_engine"),
        "llm_model_id": F.lit(model_id),
        "enrichment_invoked": F.col("_invoked"),
        "enrichment_completed_fields": F.col("_completed"),
        "quality_flags": F.col("_flags_in"),
    }
    return _build(staged, given, as_of, rules, keep)


def normalize_evidence_batch(
    evidence: DataFrame, run_id: str, created_at: str, as_of: dt.date, rules: QualityRules = DEFAULT_RULES
) -> DataFrame:
    """A whole bronze evidence table to silver in one run, without enrichment."""
    candidates = candidates_from_evidence(evidence).withColumns(
        {"run_id": F.lit(run_id), "created_at": F.lit(created_at)}
    )
    return silver_from_candidates(candidates, as_of, rules, normalization_engine=BATCH_NORMALIZER)


def outcome() -> Column:
    """Where a silver document goes: failed, rejected, else valid."""
    status = F.col("processing_status")
    return F.when(status.isin("failed", "rejected"), status).otherwise(F.lit("valid"))


def route(silver: DataFrame, valid: str = "silver/valid", rejected: str = "silver/rejected", errors: str = "errors") -> DataFrame:
    """Add ``outcome`` and the storage key the document is kept under."""
    file_name = F.concat(F.col("document_id"), F.lit(".json"))
    failed_root = errors.strip("/") + "/silver_failed"
    prefix = (
        F.when(F.col("outcome") == "failed", F.lit(failed_root))
        .when(F.col("outcome") == "rejected", F.lit(rejected))
        .otherwise(F.lit(valid))
    )
    return silver.withColumn("outcome", outcome()).withColumn(
        "output_key", storage_key(prefix, F.col("run_id"), file_name)
    )
