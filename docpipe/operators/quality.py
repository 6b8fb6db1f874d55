"""The ordered quality rules: flags, status, reason and score of a silver document."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.functions.flags import append_flags, flag, has_any, no_flags
from docpipe.functions.text import strip
from docpipe.operators.once import evaluate_once

TECHNICAL_FAILURE = "technical_processing_failure"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the rules (fixed values of the rule book, overridable per job)."""

    required_fields: tuple[str, ...] = (
        "run_id", "document_id", "source_s3_key", "source_file_name", "extraction_engine", "created_at",
    )
    at_least_one: tuple[str, ...] = ("vendor_name", "document_date", "total_amount")
    min_year: int = 1970
    min_amount: float = 0.0
    max_amount: float = 1_000_000.0
    currencies: tuple[str, ...] = ("PEN", "USD", "EUR")
    vendor_min_length: int = 2
    document_types: tuple[str, ...] = ("invoice", "receipt", "contribution", "credit_note", "unknown")
    max_unknown_rate: float = 0.20
    technical_flags: tuple[str, ...] = (
        "invalid_json_response", "empty_llm_response", "ollama_request_failed",
        "textract_request_failed", "bedrock_request_failed",
    )


DEFAULT_RULES = QualityRules()

# Flags that stop the text path before any rule runs.
BLOCKING_FLAGS = ("invalid_json_response", "empty_llm_response", "ollama_request_failed")


def has_blocking_flags(flags: Column) -> Column:
    return has_any(flags, BLOCKING_FLAGS)


def gold_eligible() -> Column:
    """Accepted documents, with or without warnings; absent states count as accepted."""
    processing = F.coalesce(F.col("processing_status"), F.lit("accepted"))
    quality = F.coalesce(F.col("quality_status"), F.lit("accepted"))
    return (processing == "accepted") & quality.isin("accepted", "warning")


def needs_enrichment() -> Column:
    """Unknown type, or no vendor, date or currency; a missing amount alone does not count."""
    return (
        F.coalesce(F.col("document_type") == "unknown", F.lit(False))
        | F.col("vendor_name").isNull()
        | F.col("document_date").isNull()
        | F.col("currency").isNull()
    )


def _present(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string") != "", F.lit(False))


def quality_score(flag_count: Column, rejected: Column) -> Column:
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(flag_count, F.lit(8)) * F.lit(0.1))
    return F.when(rejected, F.least(score, F.lit(0.4))).otherwise(score)


def apply_quality_rules(
    documents: DataFrame, as_of: dt.date, rules: QualityRules = DEFAULT_RULES
) -> DataFrame:
    """Evaluate every rule on every document; ``as_of`` stands for today.

    Two projections: the first evaluates each rule once as a boolean column, the
    second derives flags, reason, status and score from those booleans.
    """
    vendor = strip(F.col("vendor_name"))
    on = F.col("document_date").try_cast("date")
    total = F.col("total_amount")
    currency = F.col("currency")
    kind = F.coalesce(F.nullif(F.col("document_type"), F.lit("")), F.lit("unknown"))
    has_date = _present("document_date")

    one_present = _present(rules.at_least_one[0])
    for name in rules.at_least_one[1:]:
        one_present = one_present | _present(name)

    judged = evaluate_once(
        documents,
        documents.columns,
        {
            "_technical": F.coalesce(F.col("processing_status") == "failed", F.lit(False))
            | has_any(F.col("quality_flags"), rules.technical_flags),
            **{f"_no_{name}": ~_present(name) for name in rules.required_fields},
            "_empty": ~one_present,
            "_no_date": ~has_date,
            "_bad_date": has_date
            & ((F.year(on) < rules.min_year) | (F.year(on) > as_of.year) | (on > F.lit(as_of))),
            "_bad_amount": F.coalesce((total < rules.min_amount) | (total > rules.max_amount), F.lit(False)),
            "_bad_currency": F.coalesce((currency != "") & ~currency.isin(*rules.currencies), F.lit(False)),
            "_short_vendor": F.coalesce(F.length(vendor) < rules.vendor_min_length, F.lit(False)),
            "_bad_vendor": F.coalesce(
                (F.length(vendor) >= rules.vendor_min_length) & vendor.rlike(r"^\p{Nd}+$"), F.lit(False)
            ),
            "_bad_type": ~kind.isin(*rules.document_types),
            "_unknown_type": kind == "unknown",
        },
    )
    missing_required = F.lit(False)
    for name in rules.required_fields:
        missing_required = missing_required | F.col(f"_no_{name}")

    flags = append_flags(
        F.col("quality_flags"),
        *[flag(F.col(f"_no_{name}"), f"missing_{name}") for name in rules.required_fields],
        flag(F.col("_empty"), "minimum_acceptance_not_met"),
        flag(F.col("_bad_date"), "invalid_document_date"),
        flag(F.col("_no_date"), "missing_document_date"),
        flag(F.col("_bad_amount"), "amount_outlier"),
        flag(total.isNull(), "missing_total_amount"),
        flag(total.isNotNull() & currency.isNull(), "currency_missing"),
        flag(F.col("_bad_currency"), "invalid_currency"),
        flag(F.col("vendor_name").isNull(), "vendor_missing"),
        flag(F.col("_short_vendor"), "vendor_too_short"),
        flag(F.col("_bad_vendor"), "invalid_vendor"),
        flag(F.col("_bad_type"), "invalid_document_type"),
        flag(F.col("_unknown_type"), "unknown_document_type"),
    )
    # Later rules override earlier reasons; two rules only fill an empty reason.
    reason = F.coalesce(
        F.when(F.col("_bad_vendor"), F.lit("vendor_name_not_usable")),
        F.when(F.col("_bad_currency"), F.lit("currency_not_allowed")),
        F.when(F.col("_bad_amount"), F.lit("total_amount_exceeds_allowed_threshold")),
        F.when(F.col("_bad_date"), F.lit("document_date_out_of_allowed_range")),
        F.when(missing_required, F.lit("missing_required_fields")),
        F.col("rejection_reason"),
        F.when(F.col("_empty"), F.lit("minimum_acceptance_not_met")),
        F.when(F.col("_bad_type"), F.lit("invalid_document_type")),
    )
    rejected = (
        missing_required | F.col("_empty") | F.col("_bad_date") | F.col("_bad_amount")
        | F.col("_bad_currency") | F.col("_bad_vendor") | F.col("_bad_type")
    )
    technical = F.col("_technical")
    ruled = judged.withColumns(
        {
            "_rejected": rejected,
            "_flags": F.when(technical, F.coalesce(F.col("quality_flags"), no_flags())).otherwise(flags),
            "_reason": F.when(technical, F.lit(TECHNICAL_FAILURE)).when(rejected, reason),
        }
    )
    refused = F.col("_rejected")
    results = {
        "processing_status": F.when(technical, "failed").when(refused, "rejected").otherwise("accepted"),
        "quality_status": F.when(technical | refused, "rejected")
        .when(F.size("_flags") > 0, "warning")
        .otherwise("accepted"),
        "quality_score": F.when(technical, F.lit(0.0)).otherwise(quality_score(F.size("_flags"), refused)),
        "quality_flags": F.col("_flags"),
        "rejection_reason": F.col("_reason"),
        "reason_code": F.col("_reason"),
        "vendor_or_requester": F.col("vendor_name"),
        "source_file": F.col("source_file_name"),
        "ocr_confidence_flags": F.col("_flags"),
    }
    names = list(dict.fromkeys([*documents.columns, *results]))
    return ruled.select(*[results[n].alias(n) if n in results else F.col(n) for n in names])
