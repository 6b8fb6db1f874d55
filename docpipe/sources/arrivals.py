"""Arrival events: queue envelopes around object-created records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.functions.keys import base_name, execution_name, run_id_from_key, stamped_run_id
from docpipe.functions.text import blank_to_null
from docpipe.schemas import OBJECT_RECORDS, QUEUE_EVENT

# Record origins.
QUEUE, OBJECT_STORE = "aws:sqs", "aws:s3"

_UNWRAPPED = (
    "array<struct<eventSource: string, s3: struct<bucket: struct<name: string>, "
    "object: struct<key: string>>, messageId: string>>"
)


def decode_key(key: Column) -> Column:
    """URL-decoded key, ``+`` as space; an escape that is not one stays as written."""
    literal_percent = F.regexp_replace(key, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(literal_percent), key)


def _body_text(body: Column) -> Column:
    return F.coalesce(blank_to_null(body), F.lit("{}"))


def decode_arrivals(
    events: DataFrame, payload: str = "payload", received: str = "received_at",
    run_prefix: str = "run", default_bucket: str = "",
) -> DataFrame:
    """One row per arrived object, in envelope order.

    Queue records hold a JSON body with object records; records of other origins
    are ignored. An event without any object record is read as a direct record.
    The index within the event comes from the unwrapped array, so no window and
    no shuffle is needed.
    """
    passed_through = [c for c in events.columns if c != payload]
    parsed = events.withColumn("_event", F.from_json(payload, QUEUE_EVENT))

    def unwrap(record: Column) -> Column:
        inner = F.from_json(_body_text(record["body"]), OBJECT_RECORDS)["Records"]
        from_queue = F.transform(
            inner,
            lambda r: F.struct(
                r["eventSource"].alias("eventSource"), r["s3"].alias("s3"), record["messageId"].alias("messageId")
            ),
        )
        itself = F.array(
            F.struct(
                record["eventSource"].alias("eventSource"), record["s3"].alias("s3"),
                F.lit(None).cast("string").alias("messageId"),
            )
        )
        return F.coalesce(F.when(record["eventSource"] == QUEUE, from_queue).otherwise(itself), F.array().cast(_UNWRAPPED))

    records = F.coalesce(F.flatten(F.transform("_event.Records", unwrap)), F.array().cast(_UNWRAPPED))
    objects = F.filter(records, lambda r: r["eventSource"] == OBJECT_STORE)
    unpacked = parsed.withColumn("_objects", objects)
    # An empty list still yields one row, the direct record.
    spread = unpacked.select(*passed_through, "_event", F.posexplode_outer("_objects").alias("_index", "_object"))
    direct = F.col("_object").isNull()
    text = F.lit("")
    key = F.when(direct, F.coalesce(F.col("_event.source_s3_key"), text)).otherwise(
        decode_key(F.coalesce(F.col("_object.s3.object.key"), text))
    )
    keyed = spread.withColumn("source_s3_key", key).withColumn("_direct", direct)
    on = F.col(received)
    name = F.when(F.col("_direct"), blank_to_null(F.col("_event.source_file_name")))
    run = F.when(F.col("_direct"), blank_to_null(F.col("_event.run_id")))
    created = F.when(F.col("_direct"), blank_to_null(F.col("_event.created_at")))
    named = keyed.select(
        *passed_through,
        F.when(F.col("_direct"), F.coalesce(blank_to_null(F.col("_event.bucket_name")), F.lit(default_bucket)))
        .otherwise(F.coalesce(F.col("_object.s3.bucket.name"), text)).alias("bucket_name"),
        "source_s3_key",
        F.coalesce(name, base_name(F.col("source_s3_key"))).alias("source_file_name"),
        F.coalesce(run, run_id_from_key(F.col("source_s3_key")), stamped_run_id(run_prefix, on)).alias("run_id"),
        F.coalesce(created, F.date_format(on, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
        F.coalesce(
            F.when(F.col("_direct"), F.col("_event.sqs_message_id")).otherwise(F.col("_object.messageId")), text
        ).alias("message_id"),
        F.coalesce("_index", F.lit(0)).alias("record_index"),
    )
    return named.withColumn(
        "execution_id", execution_name(F.col("run_id"), F.col("source_file_name"), F.col("record_index"))
    )


def unreadable_bodies(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Queue records whose body is not a JSON object, for quarantine."""
    kept = [c for c in events.columns if c != payload]
    records = events.select(*kept, F.explode(F.from_json(payload, QUEUE_EVENT)["Records"]).alias("_r"))
    body = _body_text(F.col("_r.body"))
    parsed = F.from_json(body, OBJECT_RECORDS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    broken = parsed["_corrupt"].isNotNull() | ~F.ltrim(body).startswith("{")
    return records.filter((F.col("_r.eventSource") == QUEUE) & broken).select(
        *kept, F.col("_r.messageId").alias("message_id"), F.col("_r.body").alias("body"),
        F.lit("invalid_sqs_body").alias("error"),
    )
