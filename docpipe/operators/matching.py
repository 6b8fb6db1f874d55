"""Joins between documents, their outcomes, their evidence and their enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.functions.flags import append_flags, collect_flags, flag, no_flags
from docpipe.functions.keys import base_name, document_id
from docpipe.functions.responses import (
    confidence_name,
    evidence_candidate,
    evidence_detections,
    json_number_text,
    parse_confidences,
    parse_enrichment,
    parse_evidence,
    strip_fence,
)
from docpipe.operators.quality import needs_enrichment
from docpipe.operators.once import evaluate_once

DOCUMENT_KEY = ["run_id", "document_id"]
CANDIDATE_FIELDS = ("document_type", "vendor_name", "document_date", "total_amount", "currency")
MEASURED_FIELDS = ("vendor_name", "document_date", "total_amount", "currency")

# Fixed values.
EXTRACTION_FAILED = "textract_request_failed"
ENRICHMENT_FAILED = "bedrock_request_failed"

OUTCOME_PRIORITY = ("valid", "rejected", "failed")


def not_yet_processed(arrivals: DataFrame, valid_silver: DataFrame) -> DataFrame:
    """Arrivals without a valid silver output (idempotent re-delivery)."""
    return arrivals.join(valid_silver.select(*DOCUMENT_KEY), DOCUMENT_KEY, "left_anti")


def already_processed(arrivals: DataFrame, valid_silver: DataFrame) -> DataFrame:
    return arrivals.join(valid_silver.select(*DOCUMENT_KEY), DOCUMENT_KEY, "left_semi")


def normalize_expected(expected: DataFrame) -> DataFrame:
    """Fill file name and document id from the key; ``problem`` marks unusable entries."""
    key = F.coalesce(F.col("source_s3_key"), F.lit(""))
    name = F.coalesce(F.nullif(F.col("source_file_name"), F.lit("")), base_name(key))
    document = F.coalesce(F.nullif(F.col("document_id"), F.lit("")), document_id(name, key))
    run = F.coalesce(F.col("run_id"), F.lit(""))
    return expected.select(
        "batch_id", run.alias("run_id"), document.alias("document_id"), key.alias("source_s3_key"),
        name.alias("source_file_name"),
        F.when(run == "", F.lit("missing_run_id")).when(document == "", F.lit("missing_document_id")).alias("problem"),
    )


def batch_outcomes(expected: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Expected documents with their terminal outcome: valid, else rejected, else failed.

    ``outcome`` is null while a document has none. Outcomes are reduced to one row a document first, so a list joins
    a unique side.
    """
    priority = F.array_position(F.array(*[F.lit(o) for o in OUTCOME_PRIORITY]), F.col("outcome"))
    terminal = outcomes.groupBy(*DOCUMENT_KEY).agg(F.min(priority).alias("_priority"))
    names = F.array(*[F.lit(o) for o in OUTCOME_PRIORITY])
    return expected.join(terminal, DOCUMENT_KEY, "left").select(
        *expected.columns, F.when(F.col("_priority") > 0, F.get(names, (F.col("_priority") - 1).cast("int"))).alias("outcome")
    )


def candidates_from_evidence(evidence: DataFrame, response: str = "textract_response") -> DataFrame:
    """Candidate columns next to the evidence columns; each response is parsed once."""
    parsed = evidence.withColumn("_parsed", parse_evidence(F.col(response)))
    detected = evaluate_once(parsed, evidence.columns, evidence_detections(F.col("_parsed")))
    return detected.select(*evidence.columns, *[c.alias(n) for n, c in evidence_candidate().items()])


CANDIDATE_COLUMNS = [
    "document_type", "document_type_confidence",
    *[c for f in MEASURED_FIELDS for c in (f, confidence_name(f))],
    "raw_text", "quality_flags",
]


def one_per_document(rows: DataFrame, payload: list[str], latest: str | None = None) -> DataFrame:
    """One row per document key: the one with the greatest ``latest``, then the greatest payload."""
    order = [*([latest] if latest else []), *payload]
    chosen = rows.groupBy(*DOCUMENT_KEY).agg(F.max(F.struct(*order)).alias("_row"))
    return chosen.select(*DOCUMENT_KEY, *[F.col(f"_row.{c}").alias(c) for c in payload])


def reuse_candidates(requests: DataFrame, evidence: DataFrame, latest: str | None = None) -> DataFrame:
    """Requests with their own candidate, or the one re-extracted from stored evidence.

    ``requests`` may carry a ``candidate`` struct of ``CANDIDATE_COLUMNS``. Only
    requests without one use the stored evidence; where that is a failure, or
    absent, the request gets the extraction failure flag and ``failed`` is true. Of
    repeated evidence the greatest by ``latest`` (then by value) counts.
    """
    open_requests = requests.filter(F.col("candidate").isNull()).select(*DOCUMENT_KEY).distinct()
    wanted = one_per_document(evidence, ["status", "textract_response"], latest).join(open_requests, DOCUMENT_KEY, "left_semi")
    stored = candidates_from_evidence(wanted).select(*DOCUMENT_KEY, "status", F.struct(*CANDIDATE_COLUMNS).alias("_stored"))
    joined = requests.join(stored, DOCUMENT_KEY, "left")
    failed = F.col("candidate").isNull() & (F.coalesce(F.col("status"), F.lit("failed")) == "failed")
    source = F.when(F.col("candidate").isNotNull(), F.col("candidate")).when(~failed, F.col("_stored"))
    kept = [c for c in requests.columns if c != "candidate"]
    chosen = joined.select(*kept, failed.alias("failed"), source.alias("_source"))
    fields = [F.col(f"_source.{c}").alias(c) for c in CANDIDATE_COLUMNS if c != "quality_flags"]
    flags = F.when(F.col("failed"), F.array(F.lit(EXTRACTION_FAILED))).otherwise(
        F.coalesce(F.col("_source.quality_flags"), no_flags())
    )
    return chosen.select(*kept, "failed", *fields, flags.alias("quality_flags"))


def missing_fields():
    return collect_flags(
        *[flag(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", f) for f in sorted(MEASURED_FIELDS)]
    )


def merge_enrichment(
    candidates: DataFrame, responses: DataFrame, enabled: bool = True, prefer_existing: bool = False,
    latest: str | None = None,
) -> DataFrame:
    """Overlay enrichment responses on the candidates that need them.

    ``responses`` has run_id, document_id, ``enrichment`` (response text) and is
    null or absent where the call failed. A key the response returned replaces
    the candidate's value even when it returned null (``prefer_existing`` keeps a
    value that is there); an absent key changes nothing. Failed calls keep the
    candidate and add a technical flag. Of repeated responses the greatest by
    ``latest`` (then by text) counts, so documents are never multiplied.
    ``candidates`` are read twice, those that need enrichment and the others:
    pass a stored table.
    """
    invoked = F.coalesce(needs_enrichment() & F.lit(enabled), F.lit(False))
    untouched = candidates.filter(~invoked).select(
        "*", F.lit(False).alias("enrichment_invoked"), no_flags().alias("enrichment_completed_fields")
    )
    # Only invoked documents meet a response; the others, texts and all, are not moved.
    asking = candidates.filter(invoked).withColumns({"enrichment_invoked": F.lit(True), "_before": missing_fields()})
    asked = asking.select(*DOCUMENT_KEY).distinct()
    wanted = one_per_document(responses.join(asked, DOCUMENT_KEY, "left_semi"), ["enrichment"], latest)
    staged = asking.join(wanted, DOCUMENT_KEY, "left")
    # Each response is parsed once: a map keeps the returned keys, explicit nulls among them.
    body = strip_fence(F.col("enrichment"))
    kept = [*candidates.columns, "enrichment_invoked", "_before"]
    parsed = evaluate_once(staged.withColumn("_body", body), kept, {
        "_body": F.col("_body"),
        "_got": F.when(F.col("_body").rlike(r"\}\s*$"), parse_enrichment(F.col("_body"))),
    })
    scored = evaluate_once(parsed, parsed.columns, {
        "_scores": parse_confidences(F.try_element_at("_got", F.lit("confidence_summary"))),
        "_use": F.col("_got").isNotNull(),
        "_failed": F.col("_got").isNull(),
    })
    merged = {}
    for field in CANDIDATE_FIELDS:
        value = F.try_element_at("_got", F.lit(field))
        if field == "total_amount":
            value = json_number_text(F.col("_body"), field, value)
        returned = F.col("_use") & F.map_contains_key("_got", field)
        if prefer_existing:
            returned = returned & (F.coalesce(F.col(field).cast("string"), F.lit("")) == "")
        merged[field] = F.when(F.coalesce(returned, F.lit(False)), value).otherwise(F.col(field))
        score = confidence_name(field)
        given = F.coalesce(F.map_contains_key("_scores", field), F.lit(False))
        merged[score] = F.when(given, F.try_element_at("_scores", F.lit(field))).otherwise(F.col(score))
    merged["quality_flags"] = append_flags(F.col("quality_flags"), flag(F.col("_failed"), ENRICHMENT_FAILED))
    overlaid = scored.withColumns(merged)
    completed = F.when(F.col("_use"), F.array_sort(F.array_except("_before", missing_fields()))).otherwise(no_flags())
    done = overlaid.withColumn("enrichment_completed_fields", completed).select(
        *candidates.columns, "enrichment_invoked", "enrichment_completed_fields"
    )
    return untouched.unionByName(done)


def best_attempts(attempts: DataFrame, key: list[str], attempt: str, blocked: str, payload: list[str]) -> DataFrame:
    """Per key the first attempt that is not blocked, else the last one."""
    row = F.struct(*payload)
    open_attempt = F.when(~F.col(blocked), F.col(attempt))
    best = attempts.groupBy(*key).agg(
        F.coalesce(F.min_by(F.when(~F.col(blocked), row), open_attempt), F.max_by(row, attempt)).alias("_best"),
        F.count(F.lit(1)).alias("attempts"),
        F.min(open_attempt).isNull().alias("exhausted"),
    )
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in payload], "attempts", "exhausted")


def with_gold_details(status: DataFrame, gold: DataFrame) -> DataFrame:
    """Status rows with supplier, date, amount and currency of completed invoices."""
    # Only documents with a completed status are grouped.
    asked = status.filter(F.col("status") == "Completed").select("run_id", F.col("invoice_id").alias("document_id")).distinct()
    details = gold.join(asked, ["run_id", "document_id"], "left_semi").groupBy("run_id", "document_id").agg(
        F.min_by(F.struct("vendor_name", "document_date", "total_amount", "currency", "created_at"), "source_s3_key").alias("_d")
    )
    joined = status.join(
        details.withColumnRenamed("document_id", "invoice_id"), ["run_id", "invoice_id"], "left"
    )
    done = F.col("status") == "Completed"
    pick = {
        "supplier_name": "vendor_name", "invoice_date": "document_date", "total_amount": "total_amount",
        "currency": "currency", "processing_date": "created_at",
    }
    return joined.select(*status.columns, *[F.when(done, F.col(f"_d.{v}")).alias(k) for k, v in pick.items()])
