"""Fields out of extraction evidence and model responses (JSON text columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.functions.flags import coerce_flags, no_flags
from docpipe.functions.text import strip
from docpipe.schemas import EVIDENCE_RESPONSE, EXTRACTION_RESPONSE

# Evidence field type per canonical field.
EVIDENCE_FIELDS = {
    "vendor_name": "VENDOR_NAME",
    "document_date": "INVOICE_RECEIPT_DATE",
    "total_amount": "TOTAL",
    "currency": "CURRENCY",
}

# Flags a response or an evidence record can carry.
NO_EVIDENCE_DOCUMENTS = "textract_no_expense_documents"
EMPTY_RESPONSE = "empty_llm_response"
INVALID_RESPONSE = "invalid_json_response"
INVALID_FLAGS = "invalid_ocr_confidence_flags"


def confidence_name(field: str) -> str:
    return "vendor_confidence" if field == "vendor_name" else f"{field}_confidence"


def evidence_detections(parsed: Column) -> dict[str, Column]:
    """Per canonical field the last detection of its type, in the first document only."""
    documents = parsed["ExpenseDocuments"]
    fields = F.try_element_at(documents, F.lit(1))["SummaryFields"]

    def last_detection(kind: str) -> Column:
        of_kind = F.filter(fields, lambda f: f["Type"]["Text"] == kind)
        return F.try_element_at(of_kind, F.lit(-1))["ValueDetection"]

    found = {f"_{field}": last_detection(kind) for field, kind in EVIDENCE_FIELDS.items()}
    return {
        "_found": F.coalesce(F.size(documents), F.lit(0)) > 0,
        "_raw_text": parsed["raw_text"],
        **found,
    }


def evidence_candidate() -> dict[str, Column]:
    """Candidate columns over the columns of ``evidence_detections``."""
    found = F.col("_found")
    columns: dict[str, Column] = {
        "document_type": F.when(found, F.lit("invoice")).otherwise(F.lit("unknown")),
        "document_type_confidence": F.when(found, F.lit(0.9)),
    }
    for field in EVIDENCE_FIELDS:
        text = F.col(f"_{field}.Text")
        columns[field] = F.when(text != "", strip(text))
        columns[confidence_name(field)] = F.col(f"_{field}.Confidence")
    columns["raw_text"] = F.when(found, F.coalesce(F.col("_raw_text"), F.lit("")))
    columns["quality_flags"] = F.when(~found, F.array(F.lit(NO_EVIDENCE_DOCUMENTS))).otherwise(no_flags())
    return columns


def parse_evidence(response: Column) -> Column:
    return F.from_json(response, EVIDENCE_RESPONSE)


def json_body(response: Column) -> Column:
    """The JSON object in a response: a fenced object, else from the first brace on."""
    text = strip(response)
    # Odd parts between fence marks are inside a fence; the first that is an object, its language word aside, is taken.
    parts = F.filter(F.split(text, "```"), lambda part, i: (i % 2 == 1) & (i < F.size(F.split(text, "```")) - 1))
    inner = F.transform(parts, lambda part: strip(F.regexp_replace(part, "^json", "")))
    fenced = F.try_element_at(F.filter(inner, lambda part: part.startswith("{") & part.endswith("}")), F.lit(1))
    bare = F.when(text.contains("{") & text.contains("}"), F.substr(text, F.locate("{", text)))
    return F.coalesce(fenced, bare)


def parse_extraction(body: Column) -> Column:
    """Parse the object; text after it is ignored, a broken one sets ``_corrupt``."""
    return F.from_json(body, EXTRACTION_RESPONSE, {"columnNameOfCorruptRecord": "_corrupt"})


def extraction_flags(response: Column, body: Column, parsed: Column) -> Column:
    blank = strip(F.coalesce(response, F.lit(""))) == ""
    return (
        F.when(blank, F.array(F.lit(EMPTY_RESPONSE)))
        .when(body.isNull() | parsed.isNull() | parsed["_corrupt"].isNotNull(), F.array(F.lit(INVALID_RESPONSE)))
        .otherwise(coerce_flags(parsed["ocr_confidence_flags"], INVALID_FLAGS))
    )


def json_number_text(body: Column, field: str, text: Column) -> Column:
    """Text of a top-level JSON field; a bare number with an exponent is written out in full.

    Amount clean-up drops letters, which is meant for text such as ``12 USD`` and
    must not touch the ``e`` of a JSON number. A typed read tells the two apart: a
    text is no number to it, and fields of the same name further down are not seen.
    """
    number = F.from_json(body, f"{field} double")[field]
    return F.when(number.isNotNull() & text.rlike("[eE]"), number.try_cast("decimal(38,10)").cast("string")).otherwise(text)


def parse_enrichment(body: Column) -> Column:
    """Keys the response returned and their values as text; null when it is no JSON object."""
    return F.from_json(body, "map<string,string>")


def parse_confidences(summary: Column) -> Column:
    return F.from_json(summary, "map<string,double>")


def strip_fence(response: Column) -> Column:
    """Contents of a leading code fence without a ``json`` word; other text unchanged."""
    text = strip(response)
    inner = F.regexp_extract(text, r"(?s)^```(?:json)?(.*?)(?:```|$)", 1)
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


def statement_text(response: Column) -> Column:
    """The statement in a response: a closed leading fence loses its marks and ``sql`` word."""
    text = strip(response)
    closed = text.rlike(r"(?s)^```.*?```")
    inner = strip(F.regexp_extract(text, r"(?is)^```\s*(?:sql)?(.*?)```", 1))
    return F.when(closed, inner).otherwise(text)
