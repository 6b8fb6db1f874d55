"""Document-shaped inputs derived from the given tables.

Every frame covers its whole source table. Rows take varied shapes from the
order key, so that each rule and repair has rows to work on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.functions.flags import no_flags
from docpipe.functions.keys import base_name, document_id
from docpipe.operators.matching import candidates_from_evidence
from docpipe.plans.gold import build_gold, with_identity
from docpipe.plans.silver import outcome, silver_from_text
from docpipe.plans.sinks import write_gold
from docpipe.session import scratch_path

AS_OF = dt.date(2000, 12, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _variant(c: Column, cases: dict[int, Column], default: Column) -> Column:
    out = None
    for value, result in cases.items():
        test = c == value
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(default)


def _text(c: Column) -> Column:
    return c.cast("string")


def source_keys(k: Column) -> dict[str, Column]:
    """Run, base order and storage key of order ``k``; some orders repeat an earlier one."""
    spot = k % 50
    base = F.when(spot == 7, k - 7).when(spot == 9, k - 9).otherwise(k)
    file_of = F.when(spot == 7, k - 7).otherwise(k)
    ending = _variant(
        base % 20, {0: F.lit(".pdf"), 1: F.lit(".TIF"), 19: F.lit(".docx")}, F.lit(".png")
    )
    run = F.concat(F.lit("run-"), _text(k % 4))
    return {
        "base": base,
        "run_id": run,
        "source_s3_key": F.concat(F.lit("raw/run_id="), run, F.lit("/doc-"), _text(file_of), ending),
    }


_TABLES: dict[tuple[str, str, str], str] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stage's table, written once per session and scale, then read from storage."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = build()
    return spark.read.parquet(_TABLES[key])


def _in_files(spark: SparkSession, sf_dir: str, name: str, rows) -> DataFrame:
    """An input as a stored table of several files, in the partitions that ``rows`` gives."""

    def build() -> str:
        path = scratch_path(spark, name)
        rows(spark, sf_dir).write.parquet(path, compression="zstd")
        return path

    return _stage(spark, sf_dir, name, build)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a given table, dealt by hash. The given tables are single files of one row group, which one task reads.

    To be called on the few columns that are needed, before wide ones are made of them; without columns to hash by, the
    one task would sort all rows first.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_files(spark, sf_dir, "bronze", make_bronze)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_files(spark, sf_dir, "extracted", make_extracted)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_files(spark, sf_dir, "evidence", make_evidence)


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_files(spark, sf_dir, "enrichment", make_enrichment)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_files(spark, sf_dir, "attempts", make_attempts)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_files(spark, sf_dir, "envelopes", make_envelopes)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_files(spark, sf_dir, "documents", lambda s, d: dealt(table(s, d, "documents")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the successful extractions."""
    return _in_files(spark, sf_dir, "candidates", lambda s, d: candidates_from_evidence(evidence(s, d).filter("status = 'success'")).drop("textract_response"))


#: Inputs that are stored before use, in an order in which each finds those it is made from.
STORED = {f.__name__: f for f in (bronze, extracted, evidence, enrichment, attempts, envelopes, documents, candidates)}


def make_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_bronze``: one extracted document per order.

    Most orders describe themselves; the repeats take the fields of an earlier
    order. Splitting the two keeps the self-join to the few rows that need it.
    """
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    content = ["o_custkey", "o_totalprice", "o_orderdate"]
    repeats = (k % 50).isin(7, 9)
    own = orders.filter(~repeats).select(k.alias("k"), *content)
    copied = (
        orders.filter(repeats).select(k.alias("k"), source_keys(k)["base"].alias("_base"))
        .join(orders.filter(k % 50 == 0).select(k.alias("_base"), *content), "_base")
        .select("k", *content)
    )
    rows = dealt(own.unionByName(copied))
    named = rows.join(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"
    )
    keys = source_keys(F.col("k"))
    keyed = named.select(
        "k", *[c.alias(n) for n, c in keys.items()], "c_name",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("_price"),
        F.col("o_orderdate").cast("date").alias("_on"),
    )
    base, price, on, name = F.col("base"), F.col("_price"), F.col("_on"), F.col("c_name")
    null = F.lit(None).cast("string")
    vendor = _variant(
        base % 23,
        {1: null, 2: F.lit("12345"), 3: F.lit("X"), 4: F.concat(F.lit('  "'), name, F.lit('   Ltd" '))},
        name,
    )
    amount = _variant(
        base % 11,
        {
            1: null, 2: F.concat(F.lit("$"), price), 3: F.replace(price, F.lit("."), F.lit(" ")),
            4: F.concat(F.lit("("), price, F.lit(")")), 5: F.concat(F.lit("-"), price),
            6: F.concat(price, F.lit(" USD")), 7: F.lit("n/a"), 8: F.concat(F.lit("9"), price),
        },
        price,
    )
    date = _variant(
        base % 13,
        {
            1: null, 2: F.lit("not a date"), 3: F.lit("2999-01-01"), 4: F.lit("1960-05-05"),
            5: F.concat_ws("/", _text(F.month(on)), _text(F.day(on)), _text(F.year(on))),
        },
        _text(on),
    )
    currency = _variant(
        base % 9,
        {1: F.lit("usd"), 2: F.lit(" PEN "), 3: F.lit("GBP"), 4: null, 5: null, 6: F.lit("")},
        F.lit("EUR"),
    )
    text = F.concat(
        _variant(base % 6, {4: F.lit("Memo"), 5: F.lit("Contribution request")}, F.lit("INVOICE")),
        F.lit(" no "), _text(base), _variant(base % 9, {4: F.lit(" total €"), 5: F.lit(" total $")}, F.lit("")),
    )
    seq = F.col("k")
    return keyed.select(
        seq.alias("seq"), "run_id", "source_s3_key",
        vendor.alias("vendor_raw"), amount.alias("amount_raw"), date.alias("date_raw"),
        currency.alias("currency_raw"), text.alias("raw_text"),
        F.when(seq % 97 == 13, F.lit("failed")).otherwise(F.lit("success")).alias("ocr_status"),
        F.when(seq % 41 != 3, F.concat(_text(on), F.lit("T08:00:00Z"))).alias("created_at"),
        ((seq % 113) / 8).cast("double").alias("duration_seconds"),
    )


def make_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bronze`` in the column names the silver stage reads."""
    key = F.col("source_s3_key")
    return bronze(spark, sf_dir).select(
        "seq", "run_id", "source_s3_key", "raw_text", "created_at", "duration_seconds",
        base_name(key).alias("source_file_name"),
        document_id(F.lit(""), key).alias("document_id"),
        F.concat(F.lit("bronze/"), document_id(F.lit(""), key), F.lit(".md")).alias("raw_text_path"),
        F.col("vendor_raw").alias("vendor_name"), F.col("date_raw").alias("document_date"),
        F.col("amount_raw").alias("total_amount"), F.col("currency_raw").alias("currency"),
        F.when(F.col("ocr_status") == "failed", F.array(F.lit("textract_request_failed")))
        .otherwise(no_flags()).alias("flags"),
    )


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver documents with their ``seq``, ``duration_seconds`` and outcome."""
    built = silver_from_text(extracted(spark, sf_dir), AS_OF, keep=["seq", "duration_seconds"])
    return built.withColumn("outcome", outcome())


def silver_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the silver table of this session and scale lies."""
    silver_table(spark, sf_dir)
    return _TABLES[(spark.sparkContext.applicationId, sf_dir, "silver")]


def silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table with its fingerprints and business keys."""

    def build() -> str:
        path = scratch_path(spark, "silver")
        with_identity(silver(spark, sf_dir)).write.parquet(path, compression="zstd")
        return path

    return _stage(spark, sf_dir, "silver", build)


def build_gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build_gold(silver_table(spark, sf_dir), order=["seq"], keep=["seq"])
    return rows.withColumn("batch_id", F.concat(F.lit("batch-"), F.substring("created_at", 1, 7)))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold table: all documents with ``seq``, in monthly batches."""

    def build() -> str:
        path = scratch_path(spark, "gold")
        write_gold(build_gold_rows(spark, sf_dir), path)
        return path

    return _stage(spark, sf_dir, "gold", build)


def _detection(kind: str, text: Column, confidence: float) -> Column:
    return F.struct(
        F.struct(F.lit(kind).alias("Text")).alias("Type"),
        F.struct(text.alias("Text"), F.lit(confidence).alias("Confidence")).alias("ValueDetection"),
    )


def make_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_evidence``: extraction responses as JSON text.

    Some have no expense document, some repeat the total (the last one counts),
    failed extractions have an empty response and a message.
    """
    rows = extracted(spark, sf_dir)
    seq = F.col("seq")
    fields = F.array_compact(
        F.array(
            F.when(seq % 19 == 4, _detection("TOTAL", F.lit("0.01"), 12.5)),
            _detection("VENDOR_NAME", F.col("vendor_name"), 99.5),
            _detection("INVOICE_RECEIPT_DATE", F.col("document_date"), 98.25),
            _detection("TOTAL", F.col("total_amount"), 97.75),
            _detection("CURRENCY", F.col("currency"), 96.0),
        )
    )
    document = F.array(F.struct(fields.alias("SummaryFields")))
    response = F.to_json(
        F.struct(
            F.when(seq % 17 != 5, document).otherwise(F.filter(document, lambda d: F.lit(False))).alias("ExpenseDocuments"),
            F.col("raw_text"),
        )
    )
    failed = F.size("flags") > 0
    return rows.select(
        "seq", "run_id", "document_id", "source_s3_key", "source_file_name", "created_at",
        F.concat(F.lit("bronze/run_id="), "run_id", F.lit("/"), "document_id", F.lit(".json")).alias(
            "textract_response_s3_key"
        ),
        F.when(failed, F.lit("{}")).otherwise(response).alias("textract_response"),
        F.lit("textract_analyze_expense").alias("extraction_engine"),
        F.coalesce("created_at", F.lit("1999-01-01T00:00:00Z")).alias("extraction_timestamp"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(failed, F.lit("extraction request failed")).alias("error_message"),
        "duration_seconds",
    )


def make_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_enrich``: one enrichment response per order, in six shapes."""
    seq = F.col("o_orderkey")
    keys = source_keys(seq)
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey"))
    full = F.concat(
        F.lit('{"document_type":"receipt","vendor_name":"Vendor '), seq.cast("string"),
        F.lit('","document_date":"1999-05-05","total_amount":1.5e2,"currency":"PEN","confidence_summary":'),
        F.lit('{"vendor_name":0.8,"currency":0.7},"reasoning_flags":["guess"]}'),
    )
    response = _variant(
        seq % 6,
        {
            0: full,
            1: F.concat(
                F.lit('{"vendor_name":"Partner '), seq.cast("string"),
                F.lit('","currency":"EUR","total_amount":12.5,"confidence_summary":{"vendor_name":0.6,"total_amount":1e-05}}'),
            ),
            2: F.lit('{"vendor_name":null,"document_date":"12/31/1998","currency":"USD"}'),
            3: F.lit(None).cast("string"),
            4: F.concat(F.lit("```json\n"), full, F.lit("\n```")),
        },
        F.lit("{}"),
    )
    return orders.select(
        keys["run_id"].alias("run_id"),
        document_id(F.lit(""), keys["source_s3_key"]).alias("document_id"),
        response.alias("enrichment"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def make_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_attempts``: model responses per document, one per event."""
    n = F.col("event_id")
    response = _variant(
        n % 9,
        {
            0: F.lit(""),
            1: F.concat(F.lit('Here you go:\n```json\n{"total_amount": "$'), F.col("value").cast("string"),
                        F.lit('", "document_date": "2024-01-05", "vendor_name": "Acme"}\n```\nBye')),
            2: F.lit('Sure: {"total_amount": 1.2e3, "document_date": null, "vendor_name": "Beta"} and more {text'),
            3: F.lit("no braces here"),
            4: F.lit('{"total_amount": 12, "vendor_name": "Cut'),
            5: F.lit('[{"total_amount": 12}]'),
            6: F.lit('{"total_amount": null, "ocr_confidence_flags": "low_contrast"}'),
            7: F.lit('{"total_amount": "7,50", "ocr_confidence_flags": ["a", "b"]}'),
        },
        F.lit('{"total_amount": 5, "ocr_confidence_flags": {"x": 1}}'),
    )
    return dealt(events(spark, sf_dir).select("event_id", "user_id", "value")).select(
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("document_id"),
        n.alias("attempt"), response.alias("response"), F.col("value").alias("duration_seconds"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_status``: a status log from the event stream."""
    kinds = {"signup": "Uploaded", "view": "Processing", "click": "Consolidating", "purchase": "Completed"}
    status = F.lit("Failed")
    for kind, name in kinds.items():
        status = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(status)
    return events(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("invoice_id"),
        F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
        status.alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.col("event_id").alias("sequence"),
    )


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_expected``: documents per batch of forty orders; a few never arrive, a few entries are unusable."""
    k = F.col("o_orderkey")
    keys = source_keys(k)
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("batch-"), F.floor(k / 40).cast("string")).alias("batch_id"),
        keys["run_id"].alias("run_id"),
        F.explode(
            F.when(
                k % 500 == 11,
                F.array(keys["source_s3_key"], F.concat(F.lit("raw/lost/doc-lost-"), k.cast("string"), F.lit(".pdf"))),
            )
            .when(k % 800 == 33, F.array(keys["source_s3_key"], F.lit("bad run")))
            .when(k % 900 == 67, F.array(keys["source_s3_key"], F.lit("")))
            .otherwise(F.array(keys["source_s3_key"]))
        ).alias("source_s3_key"),
    )
    return rows.select(
        "batch_id", F.when(F.col("source_s3_key") != "bad run", F.col("run_id")).alias("run_id"), F.lit("").alias("document_id"),
        "source_s3_key", F.lit("").alias("source_file_name"),
    )


def make_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_events``: one arrival event per order, in seven shapes."""
    k = F.col("o_orderkey")
    key = source_keys(k)["source_s3_key"]
    spaced = F.concat(F.lit("raw/no run/"), k.cast("string"), F.lit(" año+100%.pdf"))

    def encoded(c: Column) -> Column:
        return F.replace(F.url_encode(c), F.lit("%2F"), F.lit("/"))

    def s3(c: Column, source: str = "aws:s3") -> Column:
        return F.struct(
            F.lit(source).alias("eventSource"),
            F.struct(
                F.struct(F.lit("lake").alias("name")).alias("bucket"), F.struct(c.alias("key")).alias("object")
            ).alias("s3"),
        )

    def queued(body: Column) -> Column:
        return F.to_json(
            F.struct(
                F.array(
                    F.struct(
                        F.lit("aws:sqs").alias("eventSource"),
                        F.concat(F.lit("m-"), k.cast("string")).alias("messageId"), body.alias("body"),
                    )
                ).alias("Records")
            )
        )

    def body(*records: Column) -> Column:
        return F.to_json(F.struct(F.array(*records).alias("Records")))

    payload = _variant(
        k % 10,
        {
            0: F.to_json(F.struct(key.alias("source_s3_key"), F.lit("direct").alias("run_id"))),
            1: queued(F.lit("{broken")),
            2: queued(body(s3(encoded(key)), s3(encoded(spaced)))),
            3: queued(body(s3(encoded(key), "aws:sns"), s3(encoded(key)))),
            4: F.to_json(F.struct(F.array(s3(encoded(key))).alias("Records"))),
            5: queued(body(s3(encoded(spaced)))),
        },
        queued(body(s3(encoded(key)))),
    )
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select(
        k.alias("event_id"), payload.alias("payload"), F.col("o_orderdate").cast("timestamp").alias("received_at")
    )


def named_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files to move, many of one name and some called like a numbered copy, and the names their folder already has."""
    k = F.col("o_orderkey")
    number = lambda of, n: F.concat(F.lit("_"), (of % n).cast("string"))
    ending = F.when(k % 3 == 0, F.lit(".pdf")).when(k % 3 == 1, F.lit(".tif")).otherwise(F.lit(""))
    name = F.concat(F.lit("f"), (k % 300).cast("string"), F.when(k % 7 == 3, number(k, 6)).otherwise(F.lit("")), ending)
    moved = table(spark, sf_dir, "orders").select(name.alias("file_name"), F.lpad(k.cast("string"), 12, "0").alias("path"))
    c = F.col("c_custkey")
    held = F.concat(F.lit("f"), (c % 300).cast("string"), F.when(c % 4 == 1, number(c, 9)).otherwise(F.lit("")), F.lit(".pdf"))
    return moved, table(spark, sf_dir, "customer").select(held.alias("name"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_upload``: upload requests of six or twelve files each."""
    k = F.col("p_partkey")
    wide = F.floor(k / 120) % 3 == 1
    request = F.when(wide, F.concat(F.lit("w-"), F.floor(k / 12).cast("string"))).otherwise(
        F.concat(F.lit("n-"), F.floor(k / 6).cast("string"))
    )
    name = F.concat(
        F.lit("scan-"), k.cast("string"),
        _variant(k % 17, {3: F.lit(".png"), 4: F.lit(""), 5: F.lit(".TIFF")}, F.lit(".pdf")),
    )
    return table(spark, sf_dir, "part").select(
        request.alias("request_id"), k.alias("idx"), name.alias("name"),
        _variant(k % 19, {2: F.lit("text/plain"), 3: F.lit(" IMAGE/TIFF ")}, F.lit("application/pdf")).alias("content_type"),
        (F.col("p_size").cast("bigint") * 430000).alias("size_bytes"),
    )


STATEMENT_SHAPES = {
    0: "SELECT vendor_name, COUNT(document_id) AS docs FROM gold_documents GROUP BY vendor_name",
    1: "  select   supplier_name, sum(total_amount) AS total from gold_invoice_summary group by supplier_name order by total desc limit 5 ; ; ",
    2: "",
    3: " ; ",
    4: "SELECT invoice_id FROM gold_invoice_summary; SELECT invoice_id FROM gold_invoice_summary",
    5: "DELETE FROM gold_documents",
    6: "SELECT document_id FROM gold_documents WHERE vendor_name = 'drop'",
    7: "SELECT * FROM gold_documents",
    8: "SELECT g.* FROM gold_documents g",
    9: "SELECT document_id, * FROM gold_documents",
    10: "SELECT 1",
    11: "SELECT a_name FROM people JOIN accounts ON people.id = accounts.id",
    12: "SELECT secret_column, invoice_id FROM gold_invoice_summary",
    13: "SELECT invoice_id FROM gold_invoice_summary LIMIT 5000",
    14: "SELECT g.document_id, s.supplier_name FROM gold.gold_documents g LEFT JOIN gold_invoice_summary AS s ON g.document_id = s.invoice_id LIMIT 50",
    15: "SELECT count(distinct vendor_name) FROM gold_documents WHERE currency IN ('USD', 'select me') AND batch_id = \"b x\"",
    16: "SELECT vendor_name FROM gold_documents d WHERE year(date(d.document_date)) = 2000 AND is_duplicate = false",
}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inv_statements``: a statement log, one row per event."""
    n = F.col("event_id")
    shape = n % (len(STATEMENT_SHAPES) + 1)
    spend = F.concat(
        F.lit("SELECT sum(total_amount) AS total FROM gold_invoice_summary WHERE lower(supplier_name) = 'vendor "),
        F.col("user_id").cast("string"), F.lit("' LIMIT "), (F.col("event_id") % 1500).cast("string"),
    )
    return events(spark, sf_dir).select(
        n.alias("query_id"),
        _variant(shape, {i: F.lit(s) for i, s in STATEMENT_SHAPES.items()}, spend).alias("generated_sql"),
        (F.col("value") * 100).cast("bigint").alias("execution_time_ms"),
        ((n % 64) / 4).cast("double").alias("scan_mb"),
        F.when(F.col("event_type") == "error", F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
    )
