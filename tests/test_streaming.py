"""Streams give what the batch gives, and replays change nothing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docpipe.operators.duplicates import mark_duplicates
from docpipe.plans.gold import with_identity
from docpipe.streaming import alarms, ingest
from docpipe.streaming.gold import gold_batches
from docpipe.streaming.sink import run_to_end
from tests.test_storage import AS_OF, texts


def parts(df, path, n):
    """Write ``df`` as ``n`` files in ``seq`` order, one micro-batch each."""
    for i in range(n):
        df.filter(F.col("seq") % n == i).coalesce(1).write.mode("append").parquet(path)


def silver_rows(spark, n=60):
    rows = [("r1", f"d{i}", "Acme" if i % 3 == 0 else f"V{i % 20}", "2020-01-01", f"{i % 4}.50", "USD", "invoice") for i in range(n)]
    made = texts(spark, rows)
    return made.withColumn("seq", F.substring("document_id", 2, 9).cast("int"))


def test_gold_stream_marks_against_earlier_batches(spark, tmp_path):
    silver = silver_rows(spark)
    source = str(tmp_path / "silver")
    parts(silver, source, 3)
    stream = spark.readStream.schema(silver.schema).option("maxFilesPerTrigger", 1).parquet(source)
    work = gold_batches(str(tmp_path / "gold"), str(tmp_path / "index"), ["seq"])
    run_to_end(stream, work, str(tmp_path / "cp"))
    gold = spark.read.parquet(str(tmp_path / "gold"))
    assert gold.select("epoch").distinct().count() == 3 and gold.count() == 60
    # The batch equivalent: order by (epoch, seq) instead of seq.
    epochs = gold.select("document_id", "epoch")
    whole = mark_duplicates(with_identity(silver).join(epochs, "document_id"), ["epoch", "seq"])
    names = ["document_id", "duplicate_strategy", "duplicate_of_document_id"]
    want = sorted(map(str, whole.select(*names).collect()))
    assert sorted(map(str, gold.select(*names).collect())) == want
    # Replay the last micro-batch: same rows.
    work(silver.join(epochs.filter("epoch = 2").select("document_id"), "document_id").select(*silver.columns), 2)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "gold")).select(*names).collect())) == want


def test_ingest_once_and_skip_done(spark, tmp_path):
    rows = [(i, "r", f"raw/run_id=r/d{i % 10}.{'txt' if i % 10 == 9 else 'pdf'}", f"d{i % 10}") for i in range(30)]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "seq int, run_id string, source_s3_key string, document_id string")
    parts(df, source, 3)
    stream = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        .withColumn("source_file_name", F.substring_index("source_s3_key", "/", -1)).withColumn("arrived_at", F.current_timestamp())
    )

    def build(batch):
        from docpipe.plans.silver import silver_from_text

        return silver_from_text(batch.withColumns({
            "vendor_name": F.lit("Acme"), "document_date": F.lit("2020-01-01"), "total_amount": F.lit("5"), "currency": F.lit("USD"),
            "raw_text": F.lit("invoice"), "raw_text_path": F.lit(""), "created_at": F.lit("t"), "flags": F.expr("cast(array() as array<string>)"),
        }), AS_OF)

    silver, refused = str(tmp_path / "silver"), str(tmp_path / "refused")
    work = ingest.ingest_batches(build, silver, refused)
    run_to_end(ingest.once_each(stream, ["source_s3_key"]), work, str(tmp_path / "cp"))
    done = spark.read.parquet(silver)
    assert done.count() == 9 and done.select("document_id").distinct().count() == 9
    assert spark.read.parquet(refused).select("source_s3_key").distinct().count() == 1
    # A delivery after the retention time reaches the batch function again and is skipped there.
    late = df.filter("seq < 3").withColumn("source_file_name", F.substring_index("source_s3_key", "/", -1)).withColumn("arrived_at", F.current_timestamp())
    work(late, 99)
    assert spark.read.parquet(silver).count() == 9


def test_dead_letters(spark):
    rows = [("a", True, "e1", 1), ("a", True, "e2", 2), ("a", True, "e3", 3), ("b", True, "x", 1), ("b", False, None, 2), ("b", True, "y", 3)]
    df = spark.createDataFrame(rows, "k string, failed boolean, error string, at int")
    got = [(r.k, r.failures, r.last_error) for r in ingest.dead_letters(df, ["k"], ["at"]).collect()]
    assert got == [("a", 3, "e3")]


def test_alarms_in_batch_and_stream(spark, tmp_path):
    base = dt.datetime(2020, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), int(m == 7), 1.0 if m < 2 else 0.0, i) for i, m in enumerate(range(0, 60))]
    df = spark.createDataFrame(rows, "ts timestamp, failed int, unknown double, seq int")
    batch = alarms.alarm_windows(df, lateness=None)
    raised = {(r.window_start.minute, r.failures_alarm, r.unknown_rate_alarm) for r in alarms.raised(batch).collect()}
    assert raised == {(0, False, True), (5, True, False)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = alarms.alarm_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    seen = []
    run_to_end(stream, lambda rows, epoch: seen.extend(rows.collect()), str(tmp_path / "cp"))
    whole = {r.window_start: r for r in batch.collect()}
    closed = {r.window_start: r for r in seen}
    assert len(closed) == 9 and all(whole[k] == v for k, v in closed.items())
