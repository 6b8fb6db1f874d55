"""Writers. A table write replaces whole partitions, so re-running a job is idempotent.

Tables that several jobs add to (bronze, silver, gold copies, runs) keep each delivery below its own ``epoch``: a number the
caller gives a delivery, higher for later ones. A repeated delivery replaces itself; another one is never touched.
``current`` reads the latest delivery of every document, so each has one terminal outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe import schemas
from docpipe.functions.text import render_markdown
from docpipe.operators.matching import DOCUMENT_KEY
from docpipe.plans.silver import outcome
from docpipe.session import swept
from docpipe.sources import versions
from docpipe.streaming.sink import replace_batch


def _partitioned(df: DataFrame, *columns: str):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns)


def bronze_documents(texts: DataFrame) -> DataFrame:
    """Rendered bronze text documents as a column (kept in Parquet, not one file each)."""
    return texts.withColumn("markdown", render_markdown(F.col("text"), F.col("source_file_name"), F.col("source_path")))


def current(rows: DataFrame, key: list[str] = DOCUMENT_KEY) -> DataFrame:
    """Rows of the latest ``epoch`` that has their key; null keys compare as equal.

    The maximum is taken over key and number only, combined before it moves; rows then meet it by key.
    """
    return versions.newest(rows, key, ["epoch"])


def read_silver(spark: SparkSession, path: str) -> DataFrame | None:
    """Every document's latest delivery, from the compacted base and the deliveries since."""
    return versions.read_current(spark, path, DOCUMENT_KEY)


def compact_silver(spark: SparkSession, path: str, buckets: int = versions.BUCKETS) -> versions.Version:
    return versions.compact(spark, path, DOCUMENT_KEY, buckets=buckets)


def write_bronze_text(texts: DataFrame, path: str, delivery: int) -> None:
    replace_batch(bronze_documents(texts), path, delivery)


def evidence_records(extractions: DataFrame) -> DataFrame:
    """Bronze evidence rows, successful or failed with a message."""
    ok = F.col("status") == "success"
    given = {
        "textract_job_id": F.lit(None).cast("string"),
        "textract_response": F.when(ok, F.col("textract_response")).otherwise(F.lit("{}")),
        "error_message": F.when(~ok, F.col("error_message")),
    }
    return extractions.select(
        *[given[n].alias(n) if n in given else F.col(n) for n in schemas.BRONZE_EVIDENCE.fieldNames()]
    )


def write_evidence(extractions: DataFrame, path: str, delivery: int) -> None:
    replace_batch(evidence_records(extractions), path, delivery, "run_id")


def write_silver(silver: DataFrame, path: str, delivery: int, gather: bool = True) -> None:
    """One pass into valid, rejected and failed, below each delivery and run.

    ``gather`` brings each (outcome, run) together first, so that many runs do
    not become a file per task and run; leave it off for input already laid out
    by run.
    """
    routed = silver.withColumn("outcome", outcome())
    rows = routed.hint("rebalance", "outcome", "run_id") if gather else routed
    swept(silver.sparkSession)
    replace_batch(rows, path, delivery, "outcome", "run_id")


def write_silver_json(silver: DataFrame, path: str, delivery: int) -> None:
    """The same documents as JSON lines under their contract names."""
    routed = silver.withColumn("outcome", outcome()).withColumnsRenamed(schemas.CONTRACT_NAMES)
    # A partition column leaves the record, so runs are kept in it as well.
    rows = routed.withColumns({"run": F.col("run_id"), "epoch": F.lit(delivery).cast("bigint")})
    _partitioned(rows, "epoch", "outcome", "run").option("ignoreNullFields", "false").json(path)


def write_gold(gold: DataFrame, path: str) -> None:
    """Gold rows below their ``batch_id``.

    The rebalance hint gathers each batch into a few files: adaptive execution
    joins small batches into one task and splits a large one over several.
    """
    _partitioned(gold.hint("rebalance", "batch_id"), "batch_id").parquet(path)


def gold_copies(gold: DataFrame) -> DataFrame:
    """Add ``run_date`` per row, for the copies kept by run and by date."""
    return gold.withColumn("run_date", F.substring_index("created_at", "T", 1))


def write_gold_by_date(gold: DataFrame, path: str, delivery: int) -> None:
    replace_batch(gold_copies(gold), path, delivery, "run_date")


def write_gold_by_run(gold: DataFrame, path: str, delivery: int) -> None:
    replace_batch(gold, path, delivery, "run_id")


MANIFEST_KEY = ["batch_id"]


def write_manifest(manifest: DataFrame, path: str, delivery: int | None = None) -> None:
    """Batch manifests as JSON lines, kept outside the table's own folder.

    A manifest replaces the earlier ones of its batch, and no others. Many batches share a file below their delivery (by
    default the next number): with a folder each, the driver would delete and rename as many folders as there are batches.
    """
    if delivery is None:
        delivery = max(versions.deliveries(manifest.sparkSession, path), default=0) + 1
    numbered = manifest.withColumn("epoch", F.lit(delivery).cast("bigint"))
    _partitioned(numbered, "epoch").json(path)


def read_manifests(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    """The last manifest of every batch, with the columns of ``layout``."""
    rows = spark.read.schema(T.StructType([*layout.fields, T.StructField("epoch", T.LongType())])).json(path)
    return current(rows, MANIFEST_KEY).select(*layout.names)


def append_run(summary: DataFrame, path: str, delivery: int) -> None:
    """Add finished runs to the runs table; the same delivery again replaces its rows."""
    replace_batch(summary, path, delivery)


def append_status(events: DataFrame, path: str) -> None:
    """Status is an append-only log; readers take the latest row per invoice."""
    events.select("invoice_id", "run_id", "status", "updated_at").write.mode("append").parquet(path)


STATUS_KEY, STATUS_LATEST = ["invoice_id"], ["updated_at", "epoch"]


def write_status(events: DataFrame, path: str, delivery: int, buckets: int = versions.BUCKETS) -> None:
    """Status rows as a delivery by bucket of the invoice; a replay replaces itself."""
    versions.put(events, path, delivery, STATUS_KEY, buckets)


def read_status(spark: SparkSession, path: str, invoices: DataFrame | None = None, buckets: int = versions.BUCKETS) -> DataFrame | None:
    """The last status of every invoice, or of ``invoices`` (their ids) from their buckets alone."""
    return versions.read_current(spark, path, STATUS_KEY, STATUS_LATEST, keys=invoices, buckets=buckets)


def compact_status(spark: SparkSession, path: str, buckets: int = versions.BUCKETS) -> versions.Version:
    return versions.compact(spark, path, STATUS_KEY, STATUS_LATEST, buckets=buckets)
