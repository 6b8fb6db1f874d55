"""Every registered query: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe import schemas
from docpipe.functions import keys, responses, text, values
from docpipe.functions.sql import register_functions
from docpipe.operators import contracts, duplicates, matching, metrics, quality, ranks, sketches, skew, status, validation
from docpipe.plans import batch, curated, questions, run, sinks
from docpipe.plans import gold as gold_plan
from docpipe.plans import silver as silver_plan
from docpipe.session import scratch_path, written
from docpipe.sources import arrivals, catalog, files
from docpipe.streaming import alarms, ingest
from docpipe.streaming import gold as gold_stream
from docpipe.streaming import status as status_stream
from docpipe.streaming.sink import replace_batch, run_to_end
from workload import inputs
from workload.inputs import AS_OF, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(c: str) -> Column:
    return F.array_join(c, ",")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


# --- normalisers ---------------------------------------------------------------


@query
def amount_normalize(spark, d):
    return inputs.bronze(spark, d).select("seq", values.amount(F.col("amount_raw")).alias("amount"))


@query
def date_normalize(spark, d):
    return inputs.bronze(spark, d).select("seq", values.date(F.col("date_raw"), AS_OF).alias("document_date"))


@query
def date_formats(spark, d):
    """Order dates written in fourteen ways, read back."""
    on = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")

    def fmt(pattern: str) -> Column:
        return F.date_format(on, pattern)

    shapes = [
        fmt("yyyy-MM-dd"), fmt("yyyy/M/d"), F.concat(F.lit("Issued "), fmt("M/d/yyyy"), F.lit(" in Lima")),
        fmt("MM-dd-yy"), fmt("MMM d, yyyy"), F.concat(F.lit("on "), fmt("d MMMM yyyy"), F.lit(" at noon")),
        fmt("MMMM d yyyy"), fmt("dd-MMM-yyyy"), fmt("yyyyMMdd"), F.concat(fmt("yyyy-MM-dd"), F.lit("T10:11:12Z")),
        F.concat(fmt("d"), F.lit("th of "), fmt("MMMM, yyyy")),
        F.lit("02/30/1999"), F.lit("no date, ref 12345"), F.concat(F.lit("31/12/"), fmt("yyyy")),
    ]
    raw = F.element_at(F.array(*shapes), (k % len(shapes)).cast("int") + 1)
    rows = table(spark, d, "orders").select(k.alias("seq"), raw.alias("raw"))
    return rows.select("seq", values.date(F.col("raw"), AS_OF).alias("document_date"))


@query
def vendor_clean(spark, d):
    return inputs.bronze(spark, d).select("seq", text.clean_string(F.col("vendor_raw")).alias("vendor"))


@query
def text_repair(spark, d):
    """Customer names with mis-decoded punctuation put in, repaired."""
    k, name = F.col("c_custkey"), F.col("c_name")
    broken = F.element_at(F.array(*[F.lit(a) for a, _ in text.MOJIBAKE]), (k % 12).cast("int") + 1)
    raw = F.when(k % 13 == 12, F.lit(" \t ")).otherwise(
        F.concat(F.lit(" '"), name, F.lit("  &"), broken, F.lit("\n x\" "))
    )
    return table(spark, d, "customer").select(k.alias("c_custkey"), text.clean_string(raw).alias("repaired"))


@query
def currency_infer(spark, d):
    total = values.amount(F.col("amount_raw"))
    return inputs.bronze(spark, d).select(
        "seq",
        values.currency(F.col("raw_text"), F.col("currency_raw"), total).alias("currency"),
        values.currency(F.col("raw_text"), F.col("currency_raw"), total, strict=True).alias("strict_currency"),
    )


@query
def key_parts(spark, d):
    key = F.col("source_s3_key")
    name = keys.base_name(key)
    return inputs.bronze(spark, d).select(
        "seq", name.alias("file_name"), keys.stem(name).alias("stem"), keys.suffix(name).alias("suffix"),
        keys.run_id_from_key(key).alias("run_id"),
        keys.storage_key("/bronze/json/", keys.run_id_from_key(key), F.concat(keys.stem(name), F.lit(".json"))).alias("bronze_key"),
    )


@query
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", keys.base_name(url).alias("name"), keys.stem(keys.base_name(url)).alias("stem"),
        keys.suffix(keys.base_name(url)).alias("suffix"), keys.run_id_from_key(url).alias("run_id"),
    )


@query
def safe_names(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.lit(" #"), k.cast("string"), F.lit(".v1.pdf"))
    messy = F.when(k % 29 == 1, F.lit(" ._. ")).when(k % 29 == 2, F.lit(None)).otherwise(
        F.concat(F.lit(" ._"), F.col("p_name"), F.lit("@/"), F.col("p_brand"), F.lit("._ "))
    )
    stamp = F.lit(dt.datetime(2000, 12, 31, 10, 20, 30)).cast("timestamp")
    return table(spark, d, "part").select(
        "p_partkey", keys.safe_stem(messy).alias("safe_stem"),
        keys.execution_name(F.lit("run/7"), name, k % 3).alias("execution_name"),
        keys.stamped_run_id(F.col("p_type"), stamp).alias("run_id"),
    )


@query
def collision_names(spark, d):
    rows = inputs.bronze(spark, d).select(
        keys.base_name(F.col("source_s3_key")).alias("file_name"), F.col("source_s3_key").alias("path")
    )
    return ranks.collision_free_names(rows).select("path", "target_name")


@query
def text_clean_lines(spark, d):
    padded = F.concat(F.lit(" \r\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".  \n\t \n ")), F.lit("\n "))
    clean = text.clean_lines(padded)
    return inputs.documents(spark, d).select(
        "doc_id", F.md5(clean.cast("binary")).alias("text_md5"), F.length(clean).cast("bigint").alias("n_chars_clean")
    )


@query
def doc_type_classify(spark, d):
    return inputs.bronze(spark, d).select("seq", text.document_type(F.col("raw_text")).alias("document_type"))


@query
def text_fingerprint(spark, d):
    """Exact duplicates of whole texts: fingerprint, and the first document that holds it."""
    rows = inputs.documents(spark, d).select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("seq"),
        F.sha2("text", 256).alias("document_fingerprint"), F.lit(None).cast("string").alias("business_key"),
    )
    return duplicates.mark_duplicates(rows, ["seq"]).select(
        "document_id", "document_fingerprint", "is_duplicate", "duplicate_of_document_id"
    )


@query
def markdown_round_trip(spark, d):
    """Documents rendered as bronze text (some left bare), then read for their metadata."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".tif"))
    rows = inputs.documents(spark, d).select(
        "doc_id", "text", "n_chars", name.alias("source_file_name"), F.concat(F.lit("data/raw/"), name).alias("source_path")
    )
    markdown = F.when(F.col("n_chars") % 3 == 0, F.col("text")).otherwise(F.col("markdown"))
    default = F.lit("unknown.tif")
    return sinks.bronze_documents(rows).select("doc_id", markdown.alias("markdown")).select(
        "doc_id",
        text.metadata_file_name(F.col("markdown"), default).alias("file_name"),
        text.metadata_path(F.col("markdown"), default).alias("path"),
        F.length("markdown").cast("bigint").alias("n_chars"),
        F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"),
    )


# --- arrivals -----------------------------------------------------------------


@query
def input_validation(spark, d):
    k = F.col("seq")
    rows = inputs.bronze(spark, d).select(
        "seq",
        F.when(k % 37 == 1, F.lit("")).when(k % 37 != 2, F.col("run_id")).alias("run_id"),
        F.when(k % 31 != 3, F.col("source_s3_key")).alias("source_s3_key"),
        F.when(k % 29 == 4, F.lit("given.TIFF")).alias("source_file_name"),
    )
    return validation.validate_arrivals(rows).select("seq", "valid", joined("errors").alias("errors"))


@query
def upload_validation(spark, d):
    return validation.validate_uploads(inputs.uploads(spark, d))


@query
def arrival_unwrap(spark, d):
    return arrivals.decode_arrivals(inputs.envelopes(spark, d), run_prefix="late", default_bucket="lake").select(
        "event_id", "record_index", "bucket_name", "source_s3_key", "source_file_name", "run_id", "message_id",
        "created_at", "execution_id",
    )


@query
def arrival_quarantine(spark, d):
    return arrivals.unreadable_bodies(inputs.envelopes(spark, d)).select("event_id", "message_id", "body", "error")


@query
def raw_listing(spark, d):
    """Supported files among all raw keys, in path order."""
    listing = inputs.bronze(spark, d).select(F.col("source_s3_key").alias("path"), F.length("raw_text").alias("length"))
    return files.supported_files(listing).select("path", F.col("length").cast("bigint"))


# --- silver -------------------------------------------------------------------


@query
def silver_documents(spark, d):
    rows = inputs.silver(spark, d)
    return rows.select(
        "seq", "run_id", "document_id", "source_s3_key", "source_file_name", "raw_text_path", "document_type",
        "vendor_name", "document_date", "total_amount", "currency", "extraction_engine", "enrichment_invoked",
        "processing_status", "quality_status", F.round("quality_score", 4).alias("quality_score"),
        joined("quality_flags").alias("quality_flags"), "rejection_reason", "reason_code", "is_duplicate",
        "duplicate_strategy", "created_at", "vendor_or_requester", "source_file",
        joined("ocr_confidence_flags").alias("ocr_confidence_flags"),
    )


@query
def quality_flags(spark, d):
    return inputs.silver(spark, d).select("seq", joined("quality_flags").alias("flags"))


@query
def rejection_reason(spark, d):
    return inputs.silver(spark, d).groupBy("rejection_reason", "quality_status").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("quality_score"), 4).alias("avg_score")
    )


@query
def outcome_routing(spark, d):
    return silver_plan.route(inputs.silver(spark, d)).select("seq", "outcome", "output_key")


@query
def rerun_outcomes(spark, d):
    """Two deliveries of the same runs: some documents fail first and come again; the rest is delivered once."""
    silver, path = inputs.silver_table(spark, d), scratch_path(spark, "deliveries")
    again = F.col("seq") % 2 == 0
    first = silver.withColumn("processing_status", F.when(again, F.lit("failed")).otherwise(F.col("processing_status")))
    sinks.write_silver(first, path, 1)
    sinks.write_silver(silver.filter(again), path, 2)
    return sinks.current(spark.read.parquet(path)).select("seq", "outcome", F.col("epoch").cast("bigint").alias("delivery"))


@query
def failed_documents(spark, d):
    return inputs.silver_table(spark, d).filter("processing_status = 'failed'").select(
        "seq", "document_type", "vendor_name", "total_amount", "quality_score", "rejection_reason",
        joined("quality_flags").alias("flags"),
    )


@query
def candidate_extract(spark, d):
    return matching.candidates_from_evidence(inputs.evidence(spark, d)).select(
        "seq", "document_type", F.col("document_type_confidence").alias("type_confidence"), "vendor_name",
        "vendor_confidence", "document_date", "total_amount", "total_amount_confidence", "currency", "raw_text",
        joined("quality_flags").alias("flags"),
    )


@query
def evidence_silver(spark, d):
    """The whole evidence table to silver in one run."""
    rows = inputs.evidence(spark, d)
    documents = silver_plan.normalize_evidence_batch(rows, "run-all", "2000-12-31T00:00:00Z", AS_OF)
    return documents.select(
        "source_s3_key", "document_type", "vendor_name", "document_date", "total_amount", "currency",
        "normalization_engine", "processing_status", "rejection_reason", joined("quality_flags").alias("flags"),
    )


@query
def response_parse(spark, d):
    rows = inputs.attempts(spark, d)
    body = rows.withColumn("_body", responses.json_body(F.col("response")))
    parsed = body.withColumn("_p", responses.parse_extraction(F.col("_body")))
    flags = responses.extraction_flags(F.col("response"), F.col("_body"), F.col("_p"))
    good = parsed.withColumn("_flags", flags).withColumn(
        "_ok", ~quality.has_blocking_flags(F.col("_flags"))
    )
    total = values.amount(responses.json_number_text(F.col("_body"), "total_amount", F.col("_p.total_amount")))
    return good.select(
        "attempt", joined("_flags").alias("flags"),
        F.when(F.col("_ok"), F.round(total, 4)).alias("total_amount"),
        F.when(F.col("_ok"), F.col("_p.document_date")).alias("document_date"),
        F.when(F.col("_ok"), F.col("_p.vendor_name")).alias("vendor_name"),
    )


@query
def best_attempt(spark, d):
    rows = inputs.attempts(spark, d).withColumn("_body", responses.json_body(F.col("response")))
    flags = responses.extraction_flags(
        F.col("response"), F.col("_body"), responses.parse_extraction(F.col("_body"))
    )
    marked = rows.withColumn("blocked", quality.has_blocking_flags(flags))
    best = matching.best_attempts(marked, ["document_id"], "attempt", "blocked", ["attempt", "response"])
    return best.select("document_id", "attempt", "response", "attempts", "exhausted")


@query
def enrichment_needed(spark, d):
    rows = inputs.candidates(spark, d)
    return rows.filter(quality.needs_enrichment()).select("seq", joined("quality_flags").alias("flags"))


@query
def enrichment_merge(spark, d):
    merged = matching.merge_enrichment(inputs.candidates(spark, d), inputs.enrichment(spark, d))
    return merged.select(
        "seq", "document_type", "vendor_name", "vendor_confidence", "document_date",
        F.round(values.amount(F.col("total_amount")), 4).alias("total_amount"), "currency", "enrichment_invoked",
        joined("enrichment_completed_fields").alias("completed"), joined("quality_flags").alias("flags"),
    )


@query
def enriched_silver(spark, d):
    merged = matching.merge_enrichment(inputs.candidates(spark, d), inputs.enrichment(spark, d))
    documents = silver_plan.silver_from_candidates(merged, AS_OF, model_id="model-1", keep=["seq"])
    return documents.groupBy("normalization_engine", "processing_status", "rejection_reason").agg(
        F.count(F.lit(1)).alias("documents"), F.count("vendor_name").alias("vendors"),
        F.count("document_date").alias("dates"), F.round(F.sum("total_amount"), 2).alias("total"),
    )


@query
def candidate_reuse(spark, d):
    """Half the requests bring their candidate, the others go back to stored evidence."""
    stored = inputs.evidence(spark, d)
    requests = matching.candidates_from_evidence(stored).select(
        "seq", *matching.DOCUMENT_KEY, "source_s3_key", "source_file_name", "created_at",
        F.when(
            (F.col("seq") % 2 == 0) & (F.col("status") == "success"), F.struct(*matching.CANDIDATE_COLUMNS)
        ).alias("candidate"),
    )
    reused = matching.reuse_candidates(requests, stored)
    return reused.select(
        "seq", "failed", "vendor_name", "document_date", "total_amount", "currency",
        joined("quality_flags").alias("flags"),
    )


@query
def legacy_contract(spark, d):
    rows = inputs.extracted(spark, d)
    mapped = contracts.legacy_contract(
        rows.select(
            F.concat(F.lit("s"), F.col("seq").cast("string"), F.lit(".md")).alias("source_file"), "raw_text_path",
            F.col("raw_text").alias("text"), "vendor_name", "document_date", "total_amount", "flags",
        )
    )
    return mapped.select(
        *[joined(f.name).alias(f.name) if f.name == "ocr_confidence_flags" else F.col(f.name)
          for f in schemas.legacy_fields()]
    )


# --- gold ---------------------------------------------------------------------


@query
def gold_documents(spark, d):
    rows = inputs.build_gold_rows(spark, d)
    return rows.select(
        "seq", "run_id", "document_id", "document_type", "document_date", "vendor_name", "total_amount", "currency",
        "processing_status", "quality_status", joined("quality_flags").alias("quality_flags"), "rejection_reason",
        "created_at", "document_fingerprint", "business_key", "is_duplicate", "duplicate_of_document_id",
        "duplicate_strategy", "duplicate_confidence", "batch_id",
    )


@query
def duplicate_marks(spark, d):
    rows = inputs.build_gold_rows(spark, d)
    return rows.select(
        "seq", "is_duplicate", "duplicate_of_document_id", "duplicate_strategy", "duplicate_confidence"
    )


@query
def gold_incremental(spark, d):
    """One run against an explicit history that also holds the run's own records."""
    silver = inputs.silver_table(spark, d)
    rows = gold_plan.build_gold(
        silver.filter("run_id = 'run-3'"), history=silver, order=["seq"], keep=["seq"]
    )
    return rows.select("seq", "is_duplicate", "duplicate_of_document_id", "duplicate_strategy", "duplicate_confidence")


@query
def gold_run(spark, d):
    rows = gold_plan.consolidate_run(inputs.silver_table(spark, d), "run-3", order=["seq"], keep=["seq"])
    return rows.select("seq", "is_duplicate", "duplicate_of_document_id", "duplicate_strategy", "duplicate_confidence")


@query
def invoice_summary(spark, d):
    return gold_plan.invoice_summary(inputs.gold(spark, d))


@query
def invoice_summary_dedup(spark, d):
    return gold_plan.invoice_summary_dedup(inputs.gold(spark, d))


@query
def invoice_summary_typed(spark, d):
    rows = gold_plan.invoice_summary(inputs.gold(spark, d), typed=True)
    return rows.select(
        "invoice_id", F.col("invoice_date").cast("string"), F.col("total_amount").cast("string"),
        F.date_format("processing_date", "yyyy-MM-dd HH:mm").alias("processing_date"),
    )


@query
def gold_partition_scan(spark, d):
    """The partitioned gold table read whole, batch by batch, with its declared schema."""
    root = scratch_path(spark, "gold-scan")
    sinks.write_gold(inputs.gold(spark, d).select(*schemas.GOLD_COLUMNS, "batch_id"), root)
    return rounded(files.load_gold(spark, root).groupBy("batch_id").agg(
        F.count("document_id").alias("documents"), F.count_if("is_duplicate").alias("duplicates"),
        F.sum("total_amount").alias("total"), F.sum(F.size("quality_flags")).cast("bigint").alias("flags"),
    ), 2)


@query
def silver_json_scan(spark, d):
    """Silver kept as JSON lines, some lines unreadable: rows read and rows set aside."""
    path = scratch_path(spark, "silver-json")
    documents = inputs.silver_table(spark, d)
    line = F.to_json(F.struct(*[c for c in schemas.SILVER.fieldNames() if c != "document_fingerprint"]))
    lines = documents.select(
        F.when(F.col("seq") % 61 == 5, F.lit("{not json")).when(F.col("seq") % 61 == 6, F.lit("[1, 2]"))
        .when(F.col("seq") % 61 == 7, F.lit('{"document_id": "bare", "ocr_confidence_flags": ["low"]}')).otherwise(line).alias("value")
    )
    lines.write.text(path)
    texts = spark.read.text(path).select("value", F.lit("/lake/silver/part-0.json").alias("source_path"))
    good, bad = files.split_silver(texts, dt.datetime(2000, 12, 31))
    tally = good.groupBy("run_id", "processing_status", "quality_status").agg(
        F.count(F.lit(1)).alias("documents"), F.count("vendor_name").alias("vendors"),
        F.sum(F.size("quality_flags")).cast("bigint").alias("flags"),
        F.min("source_file_name").alias("first_file"),
    )
    aside = bad.groupBy(F.lit("quarantine").alias("run_id"), F.col("value").alias("processing_status")).agg(
        F.lit("").alias("quality_status"), F.count(F.lit(1)).alias("documents"), F.lit(0).cast("bigint").alias("vendors"),
        F.lit(0).cast("bigint").alias("flags"), F.lit("").alias("first_file"),
    )
    return tally.unionByName(aside)


@query
def evidence_scan(spark, d):
    """Evidence written per run as JSON, read back with its schema."""
    path = scratch_path(spark, "evidence")
    rows = inputs.evidence(spark, d).withColumns(
        {"textract_job_id": F.lit(None).cast("string")}
    )
    sinks.evidence_records(rows).write.json(path)
    read = files.load_bronze_evidence(spark, path)
    return read.groupBy("run_id", "status").agg(
        F.count(F.lit(1)).alias("documents"), F.count("error_message").alias("errors"),
        F.count_if(F.col("textract_response") == "{}").alias("empty_responses"),
    )


# --- batches ------------------------------------------------------------------


@query
def idempotent_skip(spark, d):
    """Arrivals still to process once valid outputs exist."""
    silver = inputs.silver_table(spark, d)
    valid = silver.filter("outcome = 'valid'")
    return matching.not_yet_processed(inputs.extracted(spark, d), valid).select("seq", "run_id", "document_id")


@query
def already_processed(spark, d):
    silver = inputs.silver_table(spark, d)
    valid = silver.filter("outcome = 'valid'")
    return matching.already_processed(inputs.extracted(spark, d), valid).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("skipped")
    )


def _matched(spark, d) -> DataFrame:
    outcomes = inputs.silver_table(spark, d).select("run_id", "document_id", "outcome")
    return batch.match_expected(inputs.expected(spark, d), outcomes)


@query
def batch_completeness(spark, d):
    return batch.completeness(_matched(spark, d)).withColumn("run_ids", joined("run_ids"))


@query
def batch_missing(spark, d):
    return batch.missing_documents(_matched(spark, d))


@query
def batch_refused(spark, d):
    """Entries that no batch may have; their batches are refused."""
    return batch.refused_entries(_matched(spark, d)).select("batch_id", "source_s3_key", "problem")


@query
def batch_manifest(spark, d):
    """Complete batches consolidated stage by stage, then summed up."""
    silver = inputs.silver_table(spark, d)
    outcomes = silver.select("run_id", "document_id", "outcome")
    rows, summary = batch.consolidate_batches(inputs.expected(spark, d), outcomes, silver, order=["seq"])
    made = batch.manifests(rows, summary, "2000-12-31T00:00:00Z")
    return rounded(made.withColumn("run_ids", joined("run_ids")).drop("missing_documents"))


# --- metrics ------------------------------------------------------------------


@query
def completion_metrics(spark, d):
    return rounded(metrics.completion_metrics(inputs.gold(spark, d)))


@query
def completion_by_run(spark, d):
    return rounded(metrics.completion_metrics(inputs.gold(spark, d), by=["run_id"]))


@query
def preview_metrics(spark, d):
    return rounded(metrics.preview_metrics(inputs.gold(spark, d)))


@query
def silver_completion(spark, d):
    return rounded(metrics.silver_completion(inputs.silver_table(spark, d)))


@query
def type_counts(spark, d):
    return metrics.type_counts(inputs.silver_table(spark, d).withColumn(
        "document_type", F.when(F.col("outcome") != "failed", F.col("document_type"))
    ))


@query
def flag_counts(spark, d):
    return metrics.flag_counts(inputs.silver_table(spark, d))


@query
def silver_run_metrics(spark, d):
    return rounded(metrics.run_metrics(inputs.silver_table(spark, d)))


@query
def bronze_run_metrics(spark, d):
    return rounded(metrics.extraction_metrics(inputs.evidence(spark, d)))


@query
def run_summary(spark, d):
    return rounded(metrics.run_summary(inputs.silver_table(spark, d)))


@query
def acceptance_gate(spark, d):
    return rounded(metrics.acceptance_gate(metrics.run_summary(inputs.silver_table(spark, d))))


_QUANTILES = {"p50": 0.5, "p95": 0.95}


@query
def latency_percentiles(spark, d):
    return rounded(ranks.nearest_rank(inputs.events(spark, d), "value", _QUANTILES))


@query
def latency_by_run(spark, d):
    return rounded(ranks.nearest_rank(inputs.silver_table(spark, d), "duration_seconds", _QUANTILES, ["run_id"]))


@query
def metric_rollup(spark, d):
    return metrics.metric_rollup(metrics.document_metrics(inputs.silver_table(spark, d)))


@query
def metric_table(spark, d):
    return metrics.metric_table(metrics.document_metrics(inputs.silver_table(spark, d)))


@query
def statement_telemetry(spark, d):
    return rounded(metrics.statement_telemetry(inputs.statements(spark, d)))


@query
def contract_report(spark, d):
    documents = inputs.silver_table(spark, d).select(*schemas.SILVER.fieldNames(), "seq")
    return contracts.conformance_report(documents, contracts.SILVER_CONTRACT)


@query
def contract_report_gold(spark, d):
    return contracts.conformance_report(
        inputs.gold(spark, d).select(*schemas.GOLD_COLUMNS), contracts.GOLD_CONTRACT
    )


@query
def contract_report_bronze(spark, d):
    rows = inputs.evidence(spark, d).withColumn("textract_job_id", F.lit(None).cast("string"))
    return contracts.conformance_report(
        rows.select(*schemas.BRONZE_EVIDENCE.fieldNames()), contracts.BRONZE_CONTRACT
    )


@query
def orders_curated(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("order_total"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
    )
    return curated.run_transform(spark, curated.CURATED_ORDERS, {"bronze_orders": orders})


@query
def orders_key_check(spark, d):
    orders = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("order_id"), F.col("l_suppkey").alias("customer_id"),
        F.col("l_extendedprice").alias("order_total"), F.col("l_shipdate").cast("date").cast("string").alias("order_date"),
    )
    result = curated.run_transform(spark, curated.CURATED_ORDERS, {"bronze_orders": orders})
    return curated.key_violations(result, curated.CURATED_ORDERS)


# --- questions ----------------------------------------------------------------


@query
def q_docs_per_vendor(spark, d):
    return questions.documents_per_vendor(inputs.gold(spark, d))


@query
def q_latest_batch_per_vendor(spark, d):
    return questions.latest_batch_per_vendor(inputs.gold(spark, d))


@query
def q_vendor_spend(spark, d):
    return rounded(
        questions.vendor_spend(inputs.gold(spark, d), "CUSTOMER#000000042", "1995-01-01", "2000-06-30"), 2
    )


def _summary(spark, d) -> DataFrame:
    return gold_plan.invoice_summary(inputs.gold(spark, d))


def _dedup(spark, d) -> DataFrame:
    return gold_plan.invoice_summary_dedup(inputs.gold(spark, d))


@query
def q_total_spend(spark, d):
    return rounded(questions.total_spend(_summary(spark, d)), 2)


@query
def q_total_spend_by_currency(spark, d):
    return rounded(questions.total_spend(_dedup(spark, d), per_currency=True), 2)


@query
def q_top_suppliers(spark, d):
    return rounded(questions.top_suppliers(_dedup(spark, d), 5), 2)


@query
def q_top_suppliers_month(spark, d):
    return rounded(questions.top_suppliers(_dedup(spark, d), 10, month="2000-11"), 2)


@query
def q_processed_last_month(spark, d):
    return questions.processed_in_last(_summary(spark, d), "month", AS_OF)


@query
def q_processed_last_week(spark, d):
    return questions.processed_in_last(_summary(spark, d), "week", AS_OF)


@query
def q_failed_invoices(spark, d):
    latest = status.latest_status(inputs.status_events(spark, d), ["invoice_id"], ["updated_at", "sequence"])
    return questions.invoices_with_status(latest).select("invoice_id", "run_id", "status", "updated_at")


@query
def q_invoice_count(spark, d):
    return questions.invoice_count(_summary(spark, d))


@query
def q_total_by_supplier(spark, d):
    """The flagship: spend per supplier, duplicates left out."""
    return rounded(questions.total_by_supplier(_dedup(spark, d)), 2)


@query
def q_by_currency(spark, d):
    return questions.invoices_by_currency(_summary(spark, d))


@query
def q_bounded_rows(spark, d):
    rows = _summary(spark, d).select("invoice_id", "supplier_name", "processing_date").orderBy(
        F.desc("processing_date"), "invoice_id"
    )
    return questions.bounded(rows)


# --- the SQL surface ----------------------------------------------------------


@query
def sql_surface_joins(spark, d):
    gold_plan.register_views(inputs.gold(spark, d))
    table(spark, d, "customer").createOrReplaceTempView("customer")
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("""
        SELECT n.n_name AS nation, count(g.document_id) AS documents, count(DISTINCT c.c_custkey) AS vendors,
               round(sum(g.total_amount), 2) AS total
        FROM nation n
        LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
        LEFT JOIN gold_documents g ON g.vendor_name = c.c_name
        GROUP BY n.n_name
    """)


@query
def sql_surface_right_join(spark, d):
    gold_plan.register_views(inputs.gold(spark, d))
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("""
        SELECT c.c_mktsegment AS segment, count(g.document_id) AS documents, count(*) AS rows_seen
        FROM gold_documents g
        RIGHT JOIN customer c ON g.vendor_name = c.c_name AND g.currency = 'EUR'
        GROUP BY c.c_mktsegment
    """)


@query
def sql_surface_dates(spark, d):
    gold_plan.register_views(inputs.gold(spark, d))
    return spark.sql("""
        SELECT year(to_date(invoice_date)) AS y, month(to_date(invoice_date)) AS m, count(*) AS invoices,
               max(day(to_date(invoice_date))) AS last_day,
               cast(date_trunc('month', max(to_timestamp(invoice_date, 'yyyy-MM-dd'))) AS date) AS month_start
        FROM gold_invoice_summary
        WHERE invoice_date IS NOT NULL AND invoice_date BETWEEN '1995-01-01' AND '2000-12-31'
        GROUP BY year(to_date(invoice_date)), month(to_date(invoice_date))
    """).withColumn("month_start", F.col("month_start").cast("string"))


@query
def sql_surface_case(spark, d):
    gold_plan.register_views(inputs.gold(spark, d))
    return spark.sql("""
        SELECT CASE WHEN total_amount IS NULL THEN 'none' WHEN total_amount < 100000 THEN 'small' ELSE 'large' END AS band,
               upper(coalesce(currency, 'n/a')) AS money, lower(document_type) AS kind, count(*) AS invoices,
               round(min(total_amount), 2) AS low, round(max(total_amount), 2) AS high,
               cast(round(avg(cast(total_amount AS DECIMAL(18,2))), 2) AS DOUBLE) AS mean
        FROM gold_invoice_summary
        WHERE NOT (supplier_name LIKE '%7_' OR currency IN ('PEN')) OR supplier_name IS NULL OR currency IS NULL
        GROUP BY 1, 2, 3
    """)


@query
def sql_surface_having(spark, d):
    gold_plan.register_views(inputs.gold(spark, d))
    return spark.sql("""
        SELECT supplier_name, count(*) AS invoices, count(DISTINCT currency) AS currencies
        FROM gold_invoice_summary
        GROUP BY supplier_name HAVING count(*) > 5
        ORDER BY invoices DESC NULLS LAST, supplier_name ASC NULLS LAST LIMIT 100
    """)


@query
def sql_surface_distinct(spark, d):
    gold_plan.register_views(inputs.gold(spark, d))
    return spark.sql("SELECT DISTINCT document_type, currency, quality_status FROM gold_documents")


@query
def approx_distinct(spark, d):
    """The approximate count next to the exact one: within five standard errors."""
    rows = inputs.gold(spark, d).groupBy("currency").agg(
        F.approx_count_distinct("vendor_name", 0.023).alias("approx"), F.count_distinct("vendor_name").alias("exact")
    )
    return rows.select(
        "currency", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 1 + F.col("exact") * 0.115).alias("close")
    )


# --- status -------------------------------------------------------------------


def _latest(spark, d) -> DataFrame:
    return status.latest_status(inputs.status_events(spark, d), ["invoice_id"], ["updated_at", "sequence"])


@query
def status_latest(spark, d):
    return _latest(spark, d)


@query
def status_forward(spark, d):
    return status.forward_status(inputs.status_events(spark, d), ["run_id", "invoice_id"], ["updated_at", "sequence"])


@query
def status_page(spark, d):
    return status.status_page(_latest(spark, d), status="Completed", limit=20, token="doc-1").select(
        "invoice_id", "status", "updated_at"
    )


@query
def status_next_token(spark, d):
    latest = _latest(spark, d)
    return status.next_token(latest, limit=7)


@query
def status_enriched(spark, d):
    return matching.with_gold_details(_latest(spark, d), inputs.gold(spark, d)).select(
        "invoice_id", "run_id", "status", "supplier_name", "invoice_date", "total_amount", "currency"
    )


@query
def status_derived(spark, d):
    rows = _matched(spark, d).join(
        batch.completeness(_matched(spark, d)).select("batch_id", F.col("status").alias("batch_status")), "batch_id"
    )
    derived = status.status_from_outcome(F.col("outcome"), F.col("batch_status") == "completed")
    return rows.filter(F.col("problem").isNull()).groupBy(derived.alias("status")).agg(F.count(F.lit(1)).alias("documents"))


# --- streaming ----------------------------------------------------------------


def stream_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    layout = table(spark, d, name).schema
    return spark.readStream.schema(layout).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query
def stream_ingest(spark, d):
    """Arrivals delivered once or twice, ingested once, routed to silver by micro-batch."""
    root = scratch_path(spark, "ingest")
    k = F.col("o_orderkey")
    made = inputs.source_keys(k)
    delivered = stream_table(spark, d, "orders").select(
        made["run_id"].alias("run_id"), made["source_s3_key"].alias("source_s3_key"),
        keys.base_name(made["source_s3_key"]).alias("source_file_name"),
        keys.document_id(F.lit(""), made["source_s3_key"]).alias("document_id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total_amount"),
        F.col("o_orderdate").cast("date").cast("string").alias("document_date"),
        F.explode(F.sequence(F.lit(1), F.when(k % 10 == 3, F.lit(2)).otherwise(F.lit(1)))).alias("delivery"),
    ).withColumn("arrived_at", F.current_timestamp()).drop("delivery")
    once = ingest.once_each(delivered, ["run_id", "source_s3_key"])

    def build(rows: DataFrame) -> DataFrame:
        ready = rows.withColumns(
            {
                "raw_text": F.lit("invoice"), "raw_text_path": F.lit(None).cast("string"),
                "vendor_name": F.col("document_id"), "currency": F.lit("USD"),
                "created_at": F.lit("2000-12-31T00:00:00Z"), "flags": F.expr("cast(array() as array<string>)"),
            }
        )
        return silver_plan.silver_from_text(ready, AS_OF)

    run_to_end(once, ingest.ingest_batches(build, f"{root}/silver", f"{root}/rejected"), f"{root}/checkpoint")
    silver = spark.read.parquet(f"{root}/silver").select("run_id", "source_s3_key", "outcome")
    refused = spark.read.parquet(f"{root}/rejected").select(
        "run_id", "source_s3_key", F.array_join("errors", ",").alias("outcome")
    )
    return silver.unionByName(refused)


@query
def stream_gold(spark, d):
    """Silver streamed into gold; each micro-batch is marked against the ones before it."""
    root = scratch_path(spark, "stream-gold")
    layout = inputs.silver_table(spark, d).schema
    stream = spark.readStream.schema(layout).parquet(inputs.silver_path(spark, d))
    run_to_end(stream, gold_stream.gold_batches(f"{root}/gold", f"{root}/index", ["seq"]), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/gold").select(
        "seq", "is_duplicate", "duplicate_of_document_id", "duplicate_strategy"
    )


@query
def stream_status(spark, d):
    """Forward-only status per invoice, kept by a streaming aggregate."""
    root = scratch_path(spark, "stream-status")
    kinds = {"signup": "Uploaded", "view": "Processing", "click": "Consolidating", "purchase": "Completed"}
    name = F.lit("Failed")
    for kind, value in kinds.items():
        name = F.when(F.col("event_type") == kind, F.lit(value)).otherwise(name)
    events = stream_table(spark, d, "events").select(
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("invoice_id"), name.alias("status"),
        F.col("ts").alias("updated_at"), F.col("event_id").alias("sequence"),
    )
    states = ingest.status_updates(events, ["invoice_id"], ["updated_at", "sequence"])
    run_to_end(
        states, lambda rows, epoch: replace_batch(rows, f"{root}/status", epoch), f"{root}/checkpoint", "update"
    )
    log = spark.read.parquet(f"{root}/status").drop("epoch")
    final = status.forward_status(log, ["invoice_id"], ["updated_at", "sequence"])
    return final.select("invoice_id", "status", "sequence")


def _alarm_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("failed"),
        F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", 0.0).alias("unknown"),
    )


@query
def alarm_windows(spark, d):
    rows = alarms.alarm_windows(_alarm_events(inputs.events(spark, d)), lateness=None)
    raised = alarms.raised(rows)
    return rounded(raised.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    ))


@query
def stream_alarms(spark, d):
    """The same windows from a stream; append mode gives those the watermark has closed."""
    root = scratch_path(spark, "alarms")
    windows = alarms.alarm_windows(_alarm_events(stream_table(spark, d, "events")))
    run_to_end(windows, lambda rows, epoch: replace_batch(rows, f"{root}/alarms", epoch), f"{root}/checkpoint")
    closed = spark.read.parquet(f"{root}/alarms").drop("epoch")
    return rounded(closed.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    ))


@query
def dead_letter(spark, d):
    deliveries = inputs.events(spark, d).select(
        F.concat(F.lit("m-"), F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("message_id"),
        (F.col("event_type") == "error").alias("failed"),
        F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error"), "ts", "event_id",
    )
    return ingest.dead_letters(deliveries, ["message_id"], ["ts", "event_id"])


@query
def skewed_lookup(spark, d):
    """Events joined to one row per type: five hot keys, each a fifth of all rows."""
    events = inputs.events(spark, d)
    per_type = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("type_events"))
    wide = skew.join_unique(events, per_type, "event_type", ["event_id"])
    return wide.select("event_id", "event_type", "type_events")


# --- tables over many deliveries, names, contracts, catalog ---------------------


@query
def free_names(spark, d):
    """Names for moved files, none of them held by the folder, another file or another move."""
    moved, folder = inputs.named_files(spark, d)
    return ranks.collision_free_names(moved, taken=folder).select("path", "target_name")


@query
def compacted_outcomes(spark, d):
    """The documents of ``rerun_outcomes``, with a compaction before and after the second delivery and a replay of it."""
    silver, path = inputs.silver_table(spark, d), scratch_path(spark, "compacted")
    again = F.col("seq") % 2 == 0
    first = silver.withColumn("processing_status", F.when(again, F.lit("failed")).otherwise(F.col("processing_status")))
    sinks.write_silver(first, path, 1)
    sinks.compact_silver(spark, path)
    for _ in range(2):
        sinks.write_silver(silver.filter(again), path, 2)
    sinks.compact_silver(spark, path)
    return sinks.read_silver(spark, path).select("seq", "outcome", F.col("epoch").cast("bigint").alias("delivery"))


@query
def status_log(spark, d):
    """The status log in three deliveries, two of them compacted: the last status of every invoice."""
    events, path = inputs.status_events(spark, d), scratch_path(spark, "status-log")
    for n in range(3):
        sinks.write_status(events.filter(F.col("sequence") % 3 == n), path, n + 1)
        if n == 1:
            sinks.compact_status(spark, path)
    # The table keeps the rows of an invoice's last second; the sequence number settles those.
    seconds = sinks.read_status(spark, path).select("invoice_id", "updated_at").distinct()
    return seconds.select("invoice_id", "updated_at")


@query
def bronze_text_scan(spark, d):
    """Text extracts written one file each and read back with their headers."""
    path = scratch_path(spark, "bronze-text")
    name = F.concat(F.lit("scan-"), F.col("s_suppkey").cast("string"), F.lit(".tif"))
    rows = inputs.dealt(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")).select(
        text.render_markdown(F.concat(F.col("s_name"), F.lit("\n  "), F.col("s_acctbal").cast("string")), name, F.concat(F.lit("raw/"), name)).alias("value")
    )
    rows.write.option("maxRecordsPerFile", 1).text(path)
    read = files.load_bronze_text(spark, path, names="*.txt")
    return read.select(
        responses_file(F.col("text")).alias("source_file"), F.size(F.split(text.clean_lines(F.col("text")), "\n")).alias("lines"),
        F.col("raw_text_path").endswith(".txt").alias("has_path"),
    )


def responses_file(c: Column) -> Column:
    return F.regexp_extract(c, "(?m)^- Source file: `([^`]+)`", 1)


@query
def runs_table(spark, d):
    """Run manifests in two deliveries, the second one twice."""
    path = scratch_path(spark, "runs")
    rows = metrics.run_summary(inputs.silver_table(spark, d))
    late = F.col("run_id") >= "run-2"
    sinks.append_run(rows.filter(~late), path, 1)
    for _ in range(2):
        sinks.append_run(rows.filter(late), path, 2)
    return spark.read.parquet(path).select("run_id", "documents_received", "documents_accepted", "documents_rejected", "documents_failed")


@query
def manifest_files(spark, d):
    """Batch manifests written as JSON outside the table, twice, and read back."""
    path = scratch_path(spark, "manifests")
    silver = inputs.silver_table(spark, d)
    outcomes = silver.select("run_id", "document_id", "outcome")
    rows, summary = batch.consolidate_batches(inputs.expected(spark, d), outcomes, silver, order=["seq"])
    made = written(batch.manifests(rows, summary, "2000-12-31T00:00:00Z"), "manifests-made")
    for _ in range(2):
        sinks.write_manifest(made, path)
    return sinks.read_manifests(spark, path, made.schema).select("batch_id", "status", "expected_count", "gold_row_count", "duplicate_count", joined("run_ids").alias("run_ids"))


@query
def statement_extract(spark, d):
    """The statement in each answer: fenced with and without a word, or bare."""
    n = F.col("query_id")
    bare = F.col("generated_sql")
    answer = (
        F.when(n % 4 == 0, F.concat(F.lit("```sql\n"), bare, F.lit("\n```")))
        .when(n % 4 == 1, F.concat(F.lit("  ```"), bare, F.lit("``` trailing words")))
        .when(n % 4 == 2, F.concat(F.lit("```SQL "), bare)).otherwise(bare)
    )
    return inputs.statements(spark, d).select("query_id", F.md5(responses.statement_text(answer)).alias("statement_md5"))


@query
def chained_run(spark, d):
    """Two deliveries of texts, each taken through bronze, silver, gold and its manifest; the second one twice."""
    root = scratch_path(spark, "run")
    texts = inputs.extracted(spark, d)
    late = F.col("run_id") >= "run-2"
    first = run.run_all(texts.filter(~late), AS_OF, root, 1, ["seq"])
    run.run_all(texts.filter(late), AS_OF, root, 2, ["seq"])
    second = run.run_all(texts.filter(late), AS_OF, root, 2, ["seq"])
    return first.unionByName(second).select(
        "run_id", "documents_received", "documents_accepted", "documents_rejected", "documents_failed", "gold_rows", "gold_duplicates"
    )


@query
def contract_violations(spark, d):
    """What each document breaks of the silver contract."""
    rows = inputs.silver_table(spark, d).select(*schemas.SILVER.fieldNames(), "seq")
    changed = rows.withColumns({
        "document_type": F.when(F.col("seq") % 10 == 4, F.lit("letter")).otherwise(F.col("document_type")),
        "quality_status": F.when(F.col("seq") % 15 == 7, F.lit(None)).otherwise(F.col("quality_status")),
    })
    judged = contracts.with_violations(changed.drop("seq"), contracts.SILVER_CONTRACT).select("source_s3_key", joined("violations").alias("violations"))
    return judged.filter("violations <> ''")


@query
def contract_enforced(spark, d):
    """A write that refuses rows: the table and the quarantine after it."""
    root = scratch_path(spark, "enforced")
    rows = inputs.silver_table(spark, d).select(*schemas.SILVER.fieldNames())
    contracts.write_enforced(rows, contracts.SILVER_CONTRACT, f"{root}/silver", f"{root}/refused", 1)
    good = spark.read.parquet(f"{root}/silver").groupBy("run_id").agg(F.count(F.lit(1)).alias("documents"))
    bad = spark.read.parquet(f"{root}/refused").groupBy("run_id").agg(F.count(F.lit(1)).alias("documents"))
    return good.select("run_id", F.lit("accepted").alias("table_name"), "documents").unionByName(
        bad.select("run_id", F.lit("refused").alias("table_name"), "documents")
    )


@query
def catalog_latest_batch(spark, d):
    """The latest batch by its partition's name in the catalog, then that partition alone."""
    name, root = f"gold_{uuid.uuid4().hex}", scratch_path(spark, "catalog")
    rows = inputs.gold(spark, d).select(*schemas.GOLD_COLUMNS, "batch_id")
    cut = F.col("batch_id") < "batch-1998"
    sinks.write_gold(rows.filter(cut), root)
    catalog.create_gold_table(spark, name, root)
    sinks.write_gold(rows.filter(~cut), root)
    catalog.refresh_partitions(spark, name)
    latest = catalog.batch_rows(spark, name, catalog.latest_batch(spark, name))
    return latest.filter("processing_status = 'accepted'").groupBy("batch_id", "vendor_name").agg(F.count("document_id").alias("documents"))


@query
def sql_surface_date_parse(spark, d):
    register_functions(spark)
    gold_plan.register_views(inputs.gold(spark, d))
    return spark.sql("""
        SELECT year(date_parse(invoice_date, '%Y-%m-%d')) AS y, month(date_parse(invoice_date, '%Y-%m-%d')) AS m, count(*) AS invoices,
               min(hour(date_parse(processing_date, '%Y-%m-%dT%H:%i:%sZ'))) AS first_hour
        FROM gold_invoice_summary WHERE date_parse(invoice_date, '%Y-%m-%d') >= date_parse('01/02/1995', '%d/%m/%Y')
        GROUP BY 1, 2
    """)


@query
def sql_surface_approx_distinct(spark, d):
    """The approximate count by its SQL word, next to the exact one: within five standard errors."""
    register_functions(spark)
    gold_plan.register_views(inputs.gold(spark, d))
    return spark.sql("""
        SELECT currency, count(DISTINCT supplier_name) AS suppliers,
               abs(approx_distinct(supplier_name) - count(DISTINCT supplier_name)) <= 1 + 0.115 * count(DISTINCT supplier_name) AS close
        FROM gold_invoice_summary GROUP BY currency
    """)


@query
def distinct_sketches(spark, d):
    """Suppliers and documents per year from sketches that were stored per batch: within five standard errors."""
    path = scratch_path(spark, "sketches")
    gold = inputs.gold(spark, d)
    sketches.distinct_sketches(gold, ["batch_id"], ["vendor_name", "document_id"]).write.parquet(path)
    year = F.substring("batch_id", 7, 4).alias("year")
    united = sketches.united_distinct(spark.read.parquet(path).withColumn("year", year), ["year"], ["vendor_name", "document_id"])
    exact = gold.groupBy(year).agg(F.count_distinct("vendor_name").alias("vendors"), F.count_distinct("document_id").alias("documents"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1 + 0.08 * F.col(b)
    met = united.join(exact, united["year"].eqNullSafe(exact["year"])).select(
        exact["year"], "rows", "vendors", "documents", "vendor_name_distinct", "document_id_distinct"
    )
    return met.select(
        "year", "rows", "vendors", "documents", close("vendor_name_distinct", "vendors").alias("vendors_close"),
        close("document_id_distinct", "documents").alias("documents_close"),
    )


# --- streams over several micro-batches -------------------------------------------


ROWS_PER_FILE = 100_000


def in_parts(rows: DataFrame, by: str, parts: int, path: str, whole: bool = False) -> int:
    """Write ``rows`` as files in the order of a number, so that a stream takes them as that many micro-batches.

    With ``whole`` all rows are written once more as a last one. Gives the files of a micro-batch, none of them empty.
    """
    low, high = rows.agg(F.min(by), F.max(by)).first()
    step = (high - low) // parts + 1
    part = F.floor((F.col(by) - low) / step)
    counted = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    smallest = min(counted.get(n, 0) for n in range(parts))
    # Some partition of the smallest part has as many rows as there are files, and deals one to each.
    files = max(1, min(2 * rows.sparkSession.sparkContext.defaultParallelism, smallest // max(ROWS_PER_FILE, rows.rdd.getNumPartitions())))
    for n in range(parts):
        rows.filter(part == n).repartition(files).write.mode("append").parquet(path)
    if whole:
        rows.repartition(files).write.mode("append").parquet(path)
    return files


@query
def stream_gold_batches(spark, d):
    """Silver streamed into gold in four micro-batches, each marked through the bucketed key index."""
    root = scratch_path(spark, "gold-batches")
    silver = inputs.silver_table(spark, d)
    files = in_parts(silver, "seq", 4, f"{root}/silver")
    stream = spark.readStream.schema(silver.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/silver")
    run_to_end(stream, gold_stream.gold_batches(f"{root}/gold", f"{root}/index", ["seq"], compact_every=2), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/gold").select("seq", "is_duplicate", "duplicate_of_document_id", "duplicate_strategy")


@query
def stream_ingest_batches(spark, d):
    """Three micro-batches of arrivals and then all of them once more: valid documents are made once."""
    root = scratch_path(spark, "ingest-batches")
    made = inputs.source_keys(F.col("o_orderkey"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", made["run_id"].alias("run_id"), made["source_s3_key"].alias("source_s3_key"),
        keys.base_name(made["source_s3_key"]).alias("source_file_name"),
        keys.document_id(F.lit(""), made["source_s3_key"]).alias("document_id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total_amount"),
        F.col("o_orderdate").cast("date").cast("string").alias("document_date"),
    )
    files = in_parts(rows, "o_orderkey", 3, f"{root}/in", whole=True)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in").drop("o_orderkey")

    def build(arrived: DataFrame) -> DataFrame:
        return silver_plan.silver_from_text(arrived.withColumns({
            "raw_text": F.lit("invoice"), "raw_text_path": F.lit(None).cast("string"), "vendor_name": F.col("document_id"),
            "currency": F.lit("USD"), "created_at": F.lit("2000-12-31T00:00:00Z"), "flags": F.expr("cast(array() as array<string>)"),
        }), AS_OF)

    run_to_end(stream, ingest.ingest_batches(build, f"{root}/silver", f"{root}/rejected", compact_every=2), f"{root}/checkpoint")
    written = spark.read.parquet(f"{root}/silver")
    return written.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows_written"), F.count_distinct("run_id", "document_id").alias("documents"))


@query
def stream_dead_letter(spark, d):
    """Failed deliveries in four micro-batches: each message is set aside once, in the batch where it reaches the limit."""
    root = scratch_path(spark, "letters")
    deliveries = inputs.events(spark, d).select(
        F.concat(F.lit("m-"), (F.col("user_id") % 500).cast("string")).alias("message_id"), (F.col("event_type") == "error").alias("failed"),
        F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error"), "event_id",
    )
    files = in_parts(deliveries, "event_id", 4, f"{root}/in")
    stream = spark.readStream.schema(deliveries.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    work = ingest.retry_ledger(f"{root}/ledger", f"{root}/letters", ["message_id"], ["event_id"], compact_every=2)
    run_to_end(stream, work, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/letters").select("message_id", "failures", "last_error", F.col("epoch").cast("bigint").alias("epoch"))


@query
def alarm_calendar(spark, d):
    """Every period from the first event to the last, those without events as OK."""
    rows = alarms.with_calendar(alarms.alarm_windows(_alarm_events(inputs.events(spark, d)), lateness=None))
    return rounded(rows.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    ))


@query
def stream_alarm_calendar(spark, d):
    """The same from a stream of three micro-batches, the last window included."""
    root = scratch_path(spark, "alarm-calendar")
    events = _alarm_events(inputs.events(spark, d)).withColumn("second", F.unix_timestamp("ts"))
    files = in_parts(events, "second", 3, f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    run_to_end(alarms.alarm_windows(stream), alarms.alarm_batches(f"{root}/windows"), f"{root}/checkpoint", "update")
    rows = alarms.with_calendar(alarms.latest_windows(spark, f"{root}/windows"))
    return rounded(rows.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    ))


STATUS_PARTS = 3


@query
def stream_status_limit(spark, d):
    """Status events in three micro-batches: forward only, stuck invoices fail, finished ones leave the live table."""
    root = scratch_path(spark, "status-limit")
    events = inputs.status_events(spark, d).select(
        "invoice_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at"), "sequence"
    )
    files = in_parts(events.withColumn("second", F.unix_timestamp("updated_at")), "second", STATUS_PARTS, f"{root}/in")
    stream = spark.readStream.schema(events.withColumn("second", F.lit(0).cast("bigint")).schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    work = status_stream.status_batches(f"{root}/live", f"{root}/changes", ["updated_at", "sequence"], "3 days", "5 days")
    run_to_end(stream, work, f"{root}/checkpoint")
    return status_stream.live_state(spark, f"{root}/live").select("invoice_id", "status", "sequence", "timed_out")
