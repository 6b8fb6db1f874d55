"""Readers for raw listings, bronze, silver and gold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe import schemas
from docpipe.functions.flags import no_flags
from docpipe.functions.keys import base_name, stem, suffix
from docpipe.functions.text import strip
from docpipe.operators.validation import DOCUMENT_SUFFIXES


def supported_files(listing: DataFrame, limit: int | None = None, suffixes=DOCUMENT_SUFFIXES) -> DataFrame:
    """Keep supported files; with a limit, the first ones in path order (only then is anything sorted)."""
    kept = listing.filter(suffix(base_name(F.col("path"))).isin(*suffixes))
    return kept if limit is None else kept.orderBy("path").limit(limit)


def list_raw_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Raw files as path, length and modification time; contents are never read."""
    listing = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return supported_files(listing, limit)


def load_bronze_text(spark: SparkSession, folder: str, limit: int | None = None, names: str = "*.md") -> DataFrame:
    """One row per markdown document: source_file, raw_text_path, text."""
    texts = (
        spark.read.option("pathGlobFilter", names).text(folder, wholetext=True)
        .select(
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias("raw_text_path"),
            F.col("value").alias("text"),
        )
    )
    return texts if limit is None else texts.orderBy("raw_text_path").limit(limit)


def load_bronze_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence records; the free-form response stays JSON text."""
    return spark.read.schema(schemas.BRONZE_EVIDENCE).option("recursiveFileLookup", True).json(folder)


def _has_files(spark: SparkSession, folder: str) -> bool:
    names = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .load(folder).select("path")
    )
    return bool(names.take(1))


def read_silver_json(
    spark: SparkSession, folder: str, as_of: dt.datetime, one_per_file: bool = False, fallback: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of a folder tree of silver JSON.

    ``one_per_file`` reads indented one-document files, JSON lines otherwise. If
    the folder has no JSON file, ``fallback`` is read if one is named. Text that is not one
    JSON object goes to quarantine. Absent fields get their defaults.
    """
    source = folder if fallback is None or _has_files(spark, folder) else fallback
    texts = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .text(source, wholetext=one_per_file)
        .select("value", F.col("_metadata.file_path").alias("source_path"))
        .filter(strip(F.col("value")) != "")
    )
    return split_silver(texts, as_of)


def split_silver(texts: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of rows with ``value`` (JSON text) and ``source_path``."""
    layout = T.StructType(
        [
            *[T.StructField(schemas.CONTRACT_NAMES.get(f.name, f.name), f.dataType) for f in schemas.SILVER.fields],
            T.StructField("_corrupt", T.StringType()),
        ]
    )
    parsed = texts.withColumn(
        "_doc", F.from_json("value", layout, {"columnNameOfCorruptRecord": "_corrupt"})
    )
    # An array or a scalar would parse to nulls without an error, so the first letter decides.
    bad = (
        ~strip(F.col("value")).startswith("{") | F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull()
    )
    name = stem(base_name(F.col("source_path")))
    defaults = {
        "run_id": F.lit("local-run"),
        "document_id": name,
        "source_s3_key": F.concat(F.lit("data/raw/"), name, F.lit(".tif")),
        "source_file_name": F.concat(name, F.lit(".tif")),
        "quality_flags": F.coalesce(F.col("_doc.ocr_confidence_flags"), no_flags()),
        "quality_status": F.lit("accepted"),
        "processing_status": F.lit("accepted"),
        "created_at": F.lit(as_of.strftime("%Y-%m-%dT%H:%M:%SZ")),
    }
    columns = []
    for field in schemas.SILVER.fieldNames():
        value = F.col(f"_doc.{schemas.CONTRACT_NAMES.get(field, field)}")
        columns.append((F.coalesce(value, defaults[field]) if field in defaults else value).alias(field))
    return parsed.filter(~bad).select(*columns), parsed.filter(bad).select("source_path", "value")


def load_gold(spark: SparkSession, root: str) -> DataFrame:
    """The partitioned gold table; filters on ``batch_id`` prune directories."""
    layout = T.StructType([*schemas.GOLD.fields, T.StructField("batch_id", T.StringType())])
    return spark.read.schema(layout).parquet(root)


def discover_partitions(spark: SparkSession, table: str) -> None:
    """Register batches that landed after the table was created (path reads need nothing)."""
    spark.catalog.recoverPartitions(table)
