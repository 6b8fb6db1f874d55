"""Table layouts. Schemas are always explicit; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

STRING, DOUBLE, BOOLEAN, STRINGS = StringType(), DoubleType(), BooleanType(), ArrayType(StringType())

# Column names and types of the written contracts, in their order.

# The canonical silver document.
SILVER = StructType([
    StructField("run_id", STRING),
    StructField("document_id", STRING),
    StructField("source_s3_key", STRING),
    StructField("source_file_name", STRING),
    StructField("raw_text_path", STRING),
    StructField("document_type", STRING),
    StructField("document_type_confidence", DOUBLE),
    StructField("vendor_name", STRING),
    StructField("vendor_confidence", DOUBLE),
    StructField("document_date", STRING),
    StructField("document_date_confidence", DOUBLE),
    StructField("total_amount", DOUBLE),
    StructField("total_amount_confidence", DOUBLE),
    StructField("currency", STRING),
    StructField("currency_confidence", DOUBLE),
    StructField("extraction_engine", STRING),
    StructField("normalization_engine", STRING),
    StructField("llm_model_id", STRING),
    StructField("enrichment_invoked", BOOLEAN),
    StructField("enrichment_completed_fields", STRINGS),
    StructField("processing_status", STRING),
    StructField("quality_status", STRING),
    StructField("quality_score", DOUBLE),
    StructField("quality_flags", STRINGS),
    StructField("rejection_reason", STRING),
    StructField("reason_code", STRING),
    StructField("document_fingerprint", STRING),
    StructField("business_key", STRING),
    StructField("is_duplicate", BOOLEAN),
    StructField("duplicate_of_document_id", STRING),
    StructField("duplicate_strategy", STRING),
    StructField("duplicate_confidence", DOUBLE),
    StructField("created_at", STRING),
    StructField("vendor_or_requester", STRING),
    StructField("source_file", STRING),
    StructField("ocr_confidence_flags", STRINGS),
])

# The analytical table, before its partition column ``batch_id``.
GOLD = StructType([
    StructField("run_id", STRING),
    StructField("document_id", STRING),
    StructField("source_s3_key", STRING),
    StructField("source_file_name", STRING),
    StructField("document_type", STRING),
    StructField("document_date", STRING),
    StructField("vendor_name", STRING),
    StructField("total_amount", DOUBLE),
    StructField("currency", STRING),
    StructField("extraction_engine", STRING),
    StructField("normalization_engine", STRING),
    StructField("llm_model_id", STRING),
    StructField("enrichment_invoked", BOOLEAN),
    StructField("enrichment_completed_fields", STRINGS),
    StructField("processing_status", STRING),
    StructField("quality_status", STRING),
    StructField("quality_flags", STRINGS),
    StructField("rejection_reason", STRING),
    StructField("created_at", STRING),
    StructField("document_fingerprint", STRING),
    StructField("business_key", STRING),
    StructField("is_duplicate", BOOLEAN),
    StructField("duplicate_of_document_id", STRING),
    StructField("duplicate_strategy", STRING),
    StructField("duplicate_confidence", DOUBLE),
])
GOLD_COLUMNS = GOLD.fieldNames()

# Our neutral names and the names the written contract uses.
CONTRACT_NAMES = {
    "enrichment_invoked": "bedrock_invoked",
    "enrichment_completed_fields": "bedrock_completed_fields",
}

BRONZE_EVIDENCE = StructType([
    StructField("run_id", STRING),
    StructField("document_id", STRING),
    StructField("source_s3_key", STRING),
    StructField("source_file_name", STRING),
    StructField("textract_job_id", STRING),
    StructField("textract_response_s3_key", STRING),
    StructField("textract_response", STRING),
    StructField("extraction_engine", STRING),
    StructField("extraction_timestamp", STRING),
    StructField("status", STRING),
    StructField("error_message", STRING),
])

EVIDENCE_RESPONSE = (
    "ExpenseDocuments array<struct<SummaryFields: array<struct<"
    "Type: struct<Text: string>, ValueDetection: struct<Text: string, Confidence: double>>>>>, "
    "raw_text string"
)

EXTRACTION_RESPONSE = (
    "total_amount string, document_date string, vendor_name string, vendor_or_requester string, "
    "currency string, ocr_confidence_flags string, _corrupt string"
)

# One arrival event: queue records whose body is JSON holding object records.
QUEUE_EVENT = (
    "Records array<struct<eventSource: string, messageId: string, body: string, "
    "s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>, "
    "bucket_name string, source_s3_key string, source_file_name string, run_id string, "
    "created_at string, sqs_message_id string"
)
OBJECT_RECORDS = (
    "Records array<struct<eventSource: string, s3: struct<bucket: struct<name: string>, "
    "object: struct<key: string>>>>"
)

EXPECTED_DOCUMENTS = StructType([
    StructField("batch_id", STRING),
    StructField("run_id", STRING),
    StructField("document_id", STRING),
    StructField("source_s3_key", STRING),
    StructField("source_file_name", STRING),
])
STATUS = StructType([
    StructField("invoice_id", STRING),
    StructField("run_id", STRING),
    StructField("status", STRING),
    StructField("updated_at", STRING),
])

# The older flat contract: three groups of fields, in order.
LEGACY_CONTRACT = {
    "common": StructType([
        StructField("source_file", STRING),
        StructField("document_type", STRING),
        StructField("document_id", STRING),
        StructField("document_date", STRING),
        StructField("vendor_or_requester", STRING),
        StructField("recipient_name", STRING),
        StructField("recipient_address", STRING),
        StructField("description", STRING),
        StructField("amount", DOUBLE),
        StructField("total_amount", DOUBLE),
        StructField("currency", STRING),
        StructField("account_code", STRING),
        StructField("check_payable_to", STRING),
        StructField("payment_terms", STRING),
        StructField("notes", STRING),
        StructField("raw_text_path", STRING),
        StructField("ocr_confidence_flags", STRINGS),
    ]),
    "invoice": StructType([
        StructField("invoice_number", STRING),
        StructField("customer_name", STRING),
        StructField("project_name", STRING),
        StructField("job_number", STRING),
        StructField("line_items_text", STRING),
        StructField("tax_amount", DOUBLE),
        StructField("subtotal_amount", DOUBLE),
        StructField("amount_due", DOUBLE),
    ]),
    "contribution": StructType([
        StructField("state_flag", BOOLEAN),
        StructField("local_flag", BOOLEAN),
        StructField("current_office_district", STRING),
        StructField("aspired_office_district", STRING),
        StructField("party", STRING),
        StructField("leadership_position", STRING),
        StructField("approved_by", STRING),
    ]),
}


def legacy_fields() -> list[StructField]:
    return [field for group in LEGACY_CONTRACT.values() for field in group.fields]


# The semantic view: business name and gold column (None: not captured yet).
INVOICE_SUMMARY = {
    "invoice_id": "document_id",
    "invoice_date": "document_date",
    "supplier_name": "vendor_name",
    "currency": "currency",
    "total_amount": "total_amount",
    "subtotal_amount": None,
    "tax_amount": None,
    "document_type": "document_type",
    "processing_date": "created_at",
}
