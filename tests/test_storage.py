"""Readers, writers, batches and partitions on small folders."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docpipe import schemas
from docpipe.operators import status
from docpipe.plans import batch, curated, questions, sinks
from docpipe.plans import gold as gold_plan
from docpipe.plans import silver as silver_plan
from docpipe.sources import arrivals, files

AS_OF = dt.date(2020, 6, 30)


def texts(spark, rows):
    """(run, document, vendor, date, amount, currency, text) to silver."""
    raw = spark.createDataFrame(
        rows, "run_id string, document_id string, vendor_name string, document_date string, total_amount string, currency string, raw_text string"
    )
    ready = raw.withColumns({
        "source_s3_key": F.concat(F.lit("raw/run_id="), "run_id", F.lit("/"), "document_id", F.lit(".pdf")),
        "source_file_name": F.concat("document_id", F.lit(".pdf")), "raw_text_path": F.lit("x.md"),
        "created_at": F.lit("2020-06-30T10:00:00Z"), "flags": F.expr("cast(array() as array<string>)"),
    })
    return silver_plan.silver_from_text(ready, AS_OF)


ROWS = [
    ("r1", "a", "Acme", "2020-01-01", "10.00", "USD", "invoice"), ("r1", "b", "Acme", "2020-01-01", "10.00", "USD", "invoice"),
    ("r1", "c", "12345", "2020-01-01", "10.00", "USD", "invoice"), ("r2", "a", "Acme", "2020-01-01", "10.00", "USD", "invoice"),
    ("r2", "d", "Beta", "2020-02-02", "20.00", "EUR", "contribution"),
]


def test_raw_listing(spark, tmp_path):
    for name in ("b.PDF", "a.tif", "note.txt", "c.jpeg"):
        (tmp_path / name).write_bytes(b"x" * 10)
    listing = files.list_raw_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in listing.collect()) == ["a.tif", "b.PDF", "c.jpeg"]
    assert "Sort" not in listing._jdf.queryExecution().executedPlan().toString()
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "content#" not in plan
    assert files.list_raw_files(spark, str(tmp_path), limit=2).count() == 2


def test_bronze_text(spark, tmp_path):
    for name in ("two", "one"):
        (tmp_path / f"{name}.md").write_text(f"# OCR Extract\n\n- Source file: `{name}.tif`\n\nline\n")
    (tmp_path / "skip.txt").write_text("no")
    read = files.load_bronze_text(spark, str(tmp_path))
    assert sorted(r.source_file for r in read.collect()) == ["one.md", "two.md"]
    assert files.load_bronze_text(spark, str(tmp_path), limit=1).first().source_file == "one.md"


def test_silver_json_one_per_file(spark, tmp_path):
    valid = tmp_path / "valid"
    (valid / "run_id=r1").mkdir(parents=True)
    (valid / "run_id=r1" / "a.json").write_text(json.dumps({"document_id": "a", "bedrock_invoked": True, "ocr_confidence_flags": ["f"]}, indent=2))
    (valid / "b.json").write_text("{}")
    (valid / "list.json").write_text("[{}]")
    (valid / "bad.json").write_text("{oops")
    good, bad = files.read_silver_json(spark, str(valid), dt.datetime(2020, 1, 1), one_per_file=True)
    rows = {r.document_id: r for r in good.collect()}
    assert set(rows) == {"a", "b"} and bad.count() == 2
    assert rows["a"].enrichment_invoked and rows["a"].quality_flags == ["f"] and rows["a"].run_id == "local-run"
    assert rows["b"].source_s3_key == "data/raw/b.tif" and rows["b"].created_at == "2020-01-01T00:00:00Z"


def test_silver_json_reads_a_fallback_only_if_named(spark, tmp_path):
    (tmp_path / "valid").mkdir()
    (tmp_path / "x.json").write_text('{"document_id": "x"}')
    none, _ = files.read_silver_json(spark, str(tmp_path / "valid"), dt.datetime(2020, 1, 1))
    assert none.count() == 0
    good, _ = files.read_silver_json(spark, str(tmp_path / "valid"), dt.datetime(2020, 1, 1), fallback=str(tmp_path))
    assert [r.document_id for r in good.collect()] == ["x"]


def test_silver_json_round_trip(spark, tmp_path):
    silver = texts(spark, ROWS)
    sinks.write_silver_json(silver, str(tmp_path / "s"), 1)
    good, bad = files.read_silver_json(spark, str(tmp_path / "s"), dt.datetime(2020, 1, 1))
    names = ["run_id", "document_id", "processing_status", "quality_flags", "total_amount"]
    assert bad.count() == 0
    assert sorted(map(str, good.select(*names).collect())) == sorted(map(str, silver.select(*names).collect()))


def test_routing_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "silver")
    for _ in range(2):
        sinks.write_silver(texts(spark, ROWS), path, 1)
    counts = {r.outcome: r["count"] for r in spark.read.parquet(path).groupBy("outcome").count().collect()}
    assert counts == {"valid": 4, "rejected": 1}


def test_deliveries_keep_earlier_documents(spark, tmp_path):
    path, runs = str(tmp_path / "silver"), str(tmp_path / "runs")
    sinks.write_silver(texts(spark, ROWS), path, 1)
    turned = [("r1", "c", "Acme", "2020-01-01", "11.00", "USD", "invoice"), ("r1", "e", "Beta", "2020-02-02", "5.00", "EUR", "invoice")]
    for _ in range(2):
        sinks.write_silver(texts(spark, turned), path, 2)
    rows = sinks.current(spark.read.parquet(path)).select("run_id", "document_id", "outcome").collect()
    assert sorted(map(tuple, rows)) == [
        ("r1", "a", "valid"), ("r1", "b", "valid"), ("r1", "c", "valid"), ("r1", "e", "valid"), ("r2", "a", "valid"), ("r2", "d", "valid")
    ]
    for delivery in (1, 2, 2):
        sinks.append_run(spark.createDataFrame([(f"r{delivery}",)], "run_id string"), runs, delivery)
    assert sorted(r.run_id for r in spark.read.parquet(runs).collect()) == ["r1", "r2"]


def test_bronze_and_copies_keep_earlier_deliveries(spark, tmp_path):
    text = "text string, source_file_name string, source_path string"
    for delivery, name in ((1, "a"), (2, "b"), (2, "b")):
        sinks.write_bronze_text(spark.createDataFrame([("line", f"{name}.tif", f"raw/{name}.tif")], text), str(tmp_path / "b"), delivery)
        gold = gold_plan.build_gold(texts(spark, [("r1", name, "Acme", "2020-01-01", "10.00", "USD", "invoice")]))
        sinks.write_gold_by_date(gold, str(tmp_path / "d"), delivery)
        sinks.write_gold_by_run(gold, str(tmp_path / "r"), delivery)
    assert sorted(r.source_file_name for r in spark.read.parquet(str(tmp_path / "b")).collect()) == ["a.tif", "b.tif"]
    for copy in ("d", "r"):
        assert sorted(r.document_id for r in spark.read.parquet(str(tmp_path / copy)).collect()) == ["a", "b"]


def test_gold_partitions_prune_and_replace(spark, tmp_path):
    path = str(tmp_path / "gold")
    gold = gold_plan.build_gold(texts(spark, ROWS)).withColumn("batch_id", F.concat(F.lit("batch-"), "run_id"))
    for _ in range(2):
        sinks.write_gold(gold, path)
    table = files.load_gold(spark, path)
    assert table.count() == 4
    one = table.filter("batch_id = 'batch-r2'").select("vendor_name")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan and "ReadSchema: struct<vendor_name:string>" in plan
    assert one.count() == 2


def test_partition_discovery(spark, tmp_path):
    path = str(tmp_path / "gold")
    gold = gold_plan.build_gold(texts(spark, ROWS)).withColumn("batch_id", F.lit("batch-1"))
    sinks.write_gold(gold, path)
    spark.sql("DROP TABLE IF EXISTS gold_catalog")
    spark.sql(
        "CREATE TABLE gold_catalog (document_id STRING, batch_id STRING) USING parquet "
        f"PARTITIONED BY (batch_id) LOCATION '{path}'"
    )
    assert spark.table("gold_catalog").count() == 0
    files.discover_partitions(spark, "gold_catalog")
    assert spark.table("gold_catalog").count() == 4
    spark.sql("DROP TABLE gold_catalog")


def test_copies_by_date_and_run(spark, tmp_path):
    gold = gold_plan.build_gold(texts(spark, ROWS))
    sinks.write_gold_by_date(gold, str(tmp_path / "d"), 1)
    sinks.write_gold_by_run(gold, str(tmp_path / "r"), 1)
    assert {r.run_date.isoformat() for r in spark.read.parquet(str(tmp_path / "d")).select("run_date").distinct().collect()} == {"2020-06-30"}
    assert spark.read.parquet(str(tmp_path / "r")).filter("run_id = 'r2'").count() == 2


def test_duplicates_of_the_walkthrough(spark):
    rows = {(r.run_id, r.document_id): r for r in gold_plan.build_gold(texts(spark, ROWS)).collect()}
    assert rows[("r1", "a")].duplicate_strategy == "none"
    assert (rows[("r1", "b")].duplicate_strategy, rows[("r1", "b")].duplicate_of_document_id) == ("business_key", "a")
    assert (rows[("r2", "a")].duplicate_strategy, rows[("r2", "a")].duplicate_confidence) == ("exact_fingerprint", 1.0)
    assert not rows[("r2", "d")].is_duplicate


def test_incremental_equals_key_index(spark):
    silver = texts(spark, ROWS)
    current, past = silver.filter("run_id = 'r2'"), silver.filter("run_id = 'r1'")
    full = gold_plan.build_gold(current, history=past)
    index = gold_plan.key_index(gold_plan.with_identity(past.filter("processing_status = 'accepted'")))
    now = gold_plan.with_identity(current)
    from docpipe.operators.duplicates import mark_against_history

    small = mark_against_history(now, gold_plan.relevant_history(index, now), gold_plan.STORAGE_ORDER)
    names = ["document_id", "duplicate_strategy", "duplicate_of_document_id"]
    assert sorted(map(str, full.select(*names).collect())) == sorted(map(str, small.select(*names).collect()))


def test_batches(spark, tmp_path):
    silver = texts(spark, ROWS)
    outcomes = silver.select("run_id", "document_id", silver_plan.outcome().alias("outcome"))
    expected = spark.createDataFrame(
        [("b1", "r1", "", "raw/a.pdf", ""), ("b1", "r1", "b", "", ""), ("b1", "r1", "c", "", ""),
         ("b2", "r2", "d", "", ""), ("b2", "r2", "lost", "", ""),
         ("b3", "r2", "d", "", ""), ("b3", "", "x", "", ""), ("b4", "r2", "a", "", "")], schemas.EXPECTED_DOCUMENTS
    )
    gold, summary = batch.consolidate_batches(expected, outcomes, silver)
    by_batch = {r.batch_id: r for r in summary.collect()}
    assert (by_batch["b1"].status, by_batch["b1"].valid_count, by_batch["b1"].rejected_count) == ("completed", 2, 1)
    assert (by_batch["b2"].status, by_batch["b2"].missing_count) == ("incomplete", 1)
    assert (by_batch["b3"].status, by_batch["b3"].invalid_count, by_batch["b3"].expected_count) == ("invalid", 1, 2)
    refused = batch.refused_entries(batch.match_expected(expected, outcomes)).collect()
    assert [(r.batch_id, r.problem) for r in refused] == [("b3", "missing_run_id")]
    rows = {(r.batch_id, r.document_id): r for r in gold.collect()}
    assert set(rows) == {("b1", "a"), ("b1", "b"), ("b4", "a")}
    # The document of b4 repeats one that only history has; b1's own documents are no history to it.
    assert (rows[("b4", "a")].duplicate_strategy, rows[("b4", "a")].duplicate_of_document_id) == ("exact_fingerprint", "a")
    made = batch.manifests(gold, summary, "now")
    sinks.write_manifest(made, str(tmp_path / "m"))
    by = {r.batch_id: r for r in made.collect()}
    assert set(by) == {"b1", "b4"} and (by["b1"].gold_row_count, by["b1"].duplicate_count, by["b1"].run_ids) == (2, 2, ["r1"])


def test_evidence_round_trip(spark, tmp_path):
    response = json.dumps({"ExpenseDocuments": [{"SummaryFields": [
        {"Type": {"Text": "TOTAL"}, "ValueDetection": {"Text": "1.00", "Confidence": 10}},
        {"Type": {"Text": "TOTAL"}, "ValueDetection": {"Text": " 2.00 ", "Confidence": 20}},
        {"Type": {"Text": "VENDOR_NAME"}, "ValueDetection": {"Text": ""}}, {"Type": {}}]}, {"SummaryFields": []}]})
    rows = [("r", "a", "k/a", "a.pdf", None, "e/a", response, "textract_analyze_expense", "t", "success", None),
            ("r", "b", "k/b", "b.pdf", None, "e/b", "{}", "textract_analyze_expense", "t", "failed", "boom")]
    sinks.write_evidence(spark.createDataFrame(rows, schemas.BRONZE_EVIDENCE), str(tmp_path / "e"), 1)
    stored = spark.read.parquet(str(tmp_path / "e"))
    from docpipe.operators.matching import candidates_from_evidence

    got = {r.document_id: r for r in candidates_from_evidence(stored).collect()}
    assert (got["a"].total_amount, got["a"].total_amount_confidence, got["a"].vendor_name) == ("2.00", 20.0, None)
    assert (got["b"].document_type, got["b"].quality_flags) == ("unknown", ["textract_no_expense_documents"])


def test_arrival_index_runs_over_the_event(spark):
    body = json.dumps({"Records": [{"eventSource": "aws:s3", "s3": {"bucket": {"name": "b"}, "object": {"key": f"raw/run_id=r/{n}.pdf"}}} for n in "xy"]})
    event = json.dumps({"Records": [{"eventSource": "aws:sqs", "messageId": m, "body": body} for m in ("1", "2")]})
    df = spark.createDataFrame([(event,)], "payload string").withColumn("received_at", F.lit("2020-01-01").cast("timestamp"))
    rows = arrivals.decode_arrivals(df).orderBy("record_index").collect()
    assert [(r.record_index, r.message_id, r.source_file_name) for r in rows] == [(0, "1", "x.pdf"), (1, "1", "y.pdf"), (2, "2", "x.pdf"), (3, "2", "y.pdf")]
    assert rows[3].execution_id == "r-y-3"


def test_status_log(spark, tmp_path):
    path = str(tmp_path / "status")
    for row in (("a", "r", "Uploaded", "t1"), ("a", "r", "Completed", "t2"), ("b", "r", "Uploaded", "t1")):
        sinks.append_status(spark.createDataFrame([row], schemas.STATUS), path)
    latest = status.latest_status(spark.read.parquet(path), ["invoice_id"], ["updated_at"])
    assert {r.invoice_id: r.status for r in latest.collect()} == {"a": "Completed", "b": "Uploaded"}
    assert status.status_page(latest, limit=1).first().invoice_id == "a" and status.next_token(latest, limit=1).first().next_token == "a"
    assert status.next_token(latest, token="a").first().next_token is None


def test_transform_job_checks_its_contract(spark):
    orders = spark.createDataFrame([(1, 1, 5.0, "d"), (1, 2, 6.0, "d"), (2, 1, None, "d"), (None, 1, 1.0, "d")],
                                   "order_id int, customer_id int, order_total double, order_date string")
    result = curated.run_transform(spark, curated.CURATED_ORDERS, {"bronze_orders": orders})
    row = curated.key_violations(result, curated.CURATED_ORDERS).first()
    assert result.count() == 3 and (row.null_keys, row.repeated_keys) == (1, 1)
    wrong = curated.TransformJob("w", "SELECT order_id FROM bronze_orders", "x", ("order_id",), ("order_id", "more"))
    with pytest.raises(ValueError):
        curated.run_transform(spark, wrong, {"bronze_orders": orders})


def test_bounded_results(spark):
    assert questions.bounded(spark.range(500)).count() == 100
    with pytest.raises(ValueError):
        questions.bounded(spark.range(5), 1001)


def test_empty_gold_metrics(spark):
    from docpipe.operators.metrics import completion_metrics

    row = completion_metrics(spark.createDataFrame([], schemas.GOLD)).first()
    assert (row.rows, row.amount_completion_rate, row.unknown_document_type_rate) == (0, 0.0, 0.0)
