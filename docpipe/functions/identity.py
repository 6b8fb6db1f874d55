"""Business keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.functions.text import blank_to_null, key_text, strip
from docpipe.functions.values import key_amount


def business_key(
    vendor: Column, date: Column, total: Column, currency: Column, invoice_number: Column | None = None
) -> Column:
    """``invoice|vendor|date|amount|currency[|number]``; null unless the four are present."""
    required = [key_text(vendor), date, key_amount(total), key_text(currency)]
    parts = [F.lit("invoice"), *required]
    if invoice_number is not None:
        parts.append(blank_to_null(key_text(invoice_number)))
    complete = required[0].isNotNull()
    for part in required[1:]:
        complete = complete & part.isNotNull()
    return F.when(complete, F.concat_ws("|", *parts))


def payload_fingerprint(
    vendor: Column, date: Column, total: Column, currency: Column, file_name: Column
) -> Column:
    """SHA-256 of the compact JSON of five normalised fields, keys sorted, nulls kept."""
    payload = F.to_json(
        F.struct(
            key_text(currency).alias("currency"),
            date.alias("document_date"),
            key_text(file_name).alias("source_file_name"),
            key_amount(total).alias("total_amount"),
            key_text(vendor).alias("vendor_name"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.sha2(payload, 256)


def fingerprint(existing: Column, raw_text: Column | None, fallback: Column) -> Column:
    """An existing fingerprint wins, then the hash of the whole text, then the payload."""
    options = [blank_to_null(strip(existing))]
    if raw_text is not None:
        options.append(F.sha2(raw_text, 256))
    return F.coalesce(*options, fallback)
