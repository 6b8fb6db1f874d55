"""Storage keys, file names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.functions.text import blank_to_null, strip


def base_name(key: Column) -> Column:
    """Last path part; trailing slashes do not count."""
    return F.substring_index(F.rtrim(key, F.lit("/")), "/", -1)


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def suffix(name: Column) -> Column:
    """Lower-case last suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def run_id_from_key(key: Column) -> Column:
    """Value of the first ``run_id=`` path part that is not blank."""
    return blank_to_null(strip(F.regexp_extract(key, r"(?:^|/)run_id=\s*([^/\s][^/]*)", 1)))


def document_id(file_name: Column, key: Column) -> Column:
    return stem(F.coalesce(blank_to_null(file_name), base_name(key)))


def stamped_run_id(prefix: str | Column, as_of: Column) -> Column:
    """``prefix-YYYYMMDDTHHMMSSZ``; ``as_of`` is a job parameter, not the clock."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("-"), F.date_format(as_of, "yyyyMMdd'T'HHmmss'Z'"))


def storage_key(prefix: str | Column, run_id: Column, file_name: Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(F.btrim(head, F.lit("/")), F.lit("/run_id="), run_id, F.lit("/"), file_name)


def execution_name(run_id: Column, file_name: Column, index: Column) -> Column:
    """``run-stem-index`` limited to letters, digits, ``-`` and ``_``, 80 characters."""
    joined = F.concat(run_id, F.lit("-"), stem(file_name), F.lit("-"), index.cast("string"))
    return F.substring(F.regexp_replace(joined, r"[^\p{L}\p{N}_-]", "-"), 1, 80)


def safe_stem(identifier: Column) -> Column:
    """File-system-safe stem; falls back to ``unknown_document``."""
    joined = F.regexp_replace(strip(F.coalesce(identifier, F.lit(""))), r"[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(blank_to_null(F.btrim(joined, F.lit("._"))), F.lit("unknown_document"))
