"""Checks on arriving documents and upload requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.functions.flags import collect_flags, flag
from docpipe.functions.keys import base_name, suffix
from docpipe.functions.text import strip

# Accepted file kinds and upload limits.
DOCUMENT_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff")
UPLOAD_SUFFIXES = (".pdf", ".tif", ".tiff")
UPLOAD_CONTENT_TYPES = ("application/pdf", "image/tiff", "image/tif", "application/octet-stream")
MAX_FILES_PER_UPLOAD = 10
MAX_UPLOAD_BYTES = 20 * 1024 * 1024


def validate_arrivals(arrivals: DataFrame, suffixes=DOCUMENT_SUFFIXES) -> DataFrame:
    """Add ``errors`` (ordered) and ``valid`` to arrival records."""
    key = F.coalesce(F.col("source_s3_key"), F.lit(""))
    name = F.coalesce(F.nullif(F.col("source_file_name"), F.lit("")), base_name(key))
    errors = collect_flags(
        flag(F.coalesce(F.col("run_id"), F.lit("")) == "", "missing_run_id"),
        flag(key == "", "missing_source_s3_key"),
        flag(~suffix(name).isin(*suffixes), "unsupported_extension"),
    )
    return arrivals.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def file_error():
    """First problem of one uploaded file as ``code: message``, or null."""
    name = strip(F.coalesce(F.col("name"), F.lit("")))
    kind = F.lower(strip(F.coalesce(F.col("content_type"), F.lit(""))))
    return (
        F.when(
            (name == "") | ~suffix(name).isin(*UPLOAD_SUFFIXES),
            F.lit("unsupported_file_type: only PDF and TIFF invoice files are accepted."),
        )
        .when(
            ~kind.isin(*UPLOAD_CONTENT_TYPES),
            F.lit("unsupported_file_type: unsupported content_type for invoice upload."),
        )
        .when(
            F.col("size_bytes") > MAX_UPLOAD_BYTES,
            F.lit("invalid_request: file size exceeds 20 MB limit."),
        )
    )


def validate_uploads(files: DataFrame) -> DataFrame:
    """One verdict per upload request; the first failing file in order decides.

    ``files`` has one row per file: request_id, idx, name, content_type,
    size_bytes. A request without files is one row with a null ``idx``.
    """
    checked = files.withColumn("_error", F.when(F.col("idx").isNotNull(), file_error()))
    verdict = checked.groupBy("request_id").agg(
        F.count("idx").alias("file_count"),
        F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("idx"))).alias("_first"),
    )
    error = (
        F.when(F.col("file_count") == 0, F.lit("invalid_request: files must be a non-empty array."))
        .when(
            F.col("file_count") > MAX_FILES_PER_UPLOAD,
            F.lit(f"invalid_request: Maximum {MAX_FILES_PER_UPLOAD} files per request."),
        )
        .otherwise(F.col("_first"))
    )
    return verdict.select(
        "request_id", "file_count", error.isNull().alias("accepted"),
        F.substring_index(error, ": ", 1).alias("error"),
        F.regexp_extract(error, "^[a-z_]+: (.*)$", 1).alias("message"),
    )
