"""Row-wise contracts, SQL words, sketches, the catalog, status limits, alarm periods, free names, whole runs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docpipe import schemas
from docpipe.functions.sql import register_functions
from docpipe.operators import contracts, ranks, sketches, status
from docpipe.plans import gold as gold_plan
from docpipe.plans import run, sinks
from docpipe.sources import catalog
from docpipe.streaming import alarms
from docpipe.streaming import status as status_stream
from docpipe.streaming.sink import run_to_end
from tests.test_storage import AS_OF, ROWS, texts

EVIDENCE = [
    ("r", "a", "k", "a.pdf", None, None, "{}", "textract_analyze_expense", "t", "success", None),
    ("r", None, "k", "b.pdf", None, None, None, "other", "t", "done", None),
]


def test_violations_by_row(spark):
    rows = spark.createDataFrame(EVIDENCE, schemas.BRONZE_EVIDENCE)
    found = contracts.with_violations(rows.withColumn("more", F.lit(1)).drop("error_message"), contracts.BRONZE_CONTRACT).collect()
    assert found[0].violations == ["undeclared:more"]
    assert found[1].violations == ["required:document_id", "required:textract_response", "enum:extraction_engine", "enum:status", "undeclared:more"]
    mistyped = rows.withColumn("status", F.lit(1)).drop("run_id")
    assert contracts.with_violations(mistyped, contracts.BRONZE_CONTRACT).first().violations[0] == "required:run_id"
    assert "type:status" in contracts.with_violations(mistyped, contracts.BRONZE_CONTRACT).first().violations


def test_enforced_write(spark, tmp_path):
    rows = spark.createDataFrame(EVIDENCE, schemas.BRONZE_EVIDENCE)
    for _ in range(2):
        contracts.write_enforced(rows, contracts.BRONZE_CONTRACT, str(tmp_path / "good"), str(tmp_path / "bad"), 1)
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert [r.document_id for r in good.collect()] == ["a"] and "violations" not in good.columns
    assert [len(r.violations) for r in bad.collect()] == [4]


@pytest.mark.parametrize(
    "value, pattern, want",
    [
        ("2020-03-04", "%Y-%m-%d", dt.datetime(2020, 3, 4)), ("04/03/2020 05:06:07", "%d/%m/%Y %H:%i:%s", dt.datetime(2020, 3, 4, 5, 6, 7)),
        ("2020-03-04T05:06:07Z", "%Y-%m-%dT%H:%i:%sZ", dt.datetime(2020, 3, 4, 5, 6, 7)), ("day 04 of 03, 2020", "day %d of %m, %Y", dt.datetime(2020, 3, 4)),
        (None, "%Y", None),
    ],
)
def test_date_parse(spark, value, pattern, want):
    register_functions(spark)
    spark.createDataFrame([(value, pattern)], "v string, p string").createOrReplaceTempView("dates")
    assert spark.sql("SELECT date_parse(v, p) AS d FROM dates").first().d == want


def test_approx_distinct_word_and_sketches(spark, tmp_path):
    register_functions(spark)
    rows = spark.range(20_000).select((F.col("id") % 5).alias("g"), (F.col("id") % 7).alias("batch"), (F.col("id") % 3000).cast("string").alias("v"))
    rows.createOrReplaceTempView("values_seen")
    for r in spark.sql("SELECT g, approx_distinct(v) AS a, approx_count_distinct(v, 0.05) AS b, count(DISTINCT v) AS n FROM values_seen GROUP BY g").collect():
        assert r.a == r.b and abs(r.a - r.n) <= 0.15 * r.n
    stored = sketches.distinct_sketches(rows.withColumn("v", F.when(F.col("g") < 4, F.col("v"))), ["g", "batch"], ["v"])
    stored.write.parquet(str(tmp_path / "s"))
    united = {r.g: (r.rows, r.v_distinct) for r in sketches.united_distinct(spark.read.parquet(str(tmp_path / "s")), ["g"], ["v"]).collect()}
    assert all(n == 4000 and (abs(v - 600) <= 48 if g < 4 else v == 0) for g, (n, v) in united.items())


def test_latest_batch_reads_one_partition(spark, tmp_path):
    gold = gold_plan.build_gold(texts(spark, ROWS)).withColumn("batch_id", F.concat(F.lit("b"), "run_id"))
    root, name = str(tmp_path / "gold"), "gold_of_test"
    sinks.write_gold(gold.filter("run_id = 'r1'"), root)
    catalog.create_gold_table(spark, name, root)
    assert catalog.latest_batch(spark, name) == "br1"
    sinks.write_gold(gold.filter("run_id = 'r2'"), root)
    catalog.refresh_partitions(spark, name)
    rows = catalog.batch_rows(spark, name, catalog.latest_batch(spark, name))
    assert rows.count() == 2 and all("batch_id=br2" in f for f in rows.inputFiles())
    assert sorted(r.batch_id for r in catalog.batches(spark, name).collect()) == ["br1", "br2"]
    spark.sql(f"DROP TABLE {name}")


def test_pages_ask_for_one_row_more(spark):
    latest = spark.createDataFrame([(f"i{k:02d}", "Completed" if k % 2 else "Failed") for k in range(10)], "invoice_id string, status string")
    token, seen = None, []
    while True:
        seen += [r.invoice_id for r in status.status_page(latest, "Completed", 2, token).collect()]
        token = status.next_token(latest, "Completed", 2, token).first().next_token
        if token is None:
            break
    assert seen == [f"i{k:02d}" for k in range(1, 10, 2)]
    for size in (0, 101):
        with pytest.raises(ValueError):
            status.status_page(latest, limit=size)


def walked(events, size, stuck, keep):
    """The status rules over micro-batches of ``size`` events, one invoice at a time."""
    step = status.STATUS_ORDER
    live: dict = {}
    clock = None
    for at in range(0, len(events), size):
        for invoice, state, when, number in events[at : at + size]:
            clock = max(clock or when, when)
            new = (state, when, number, False)
            old = live.get(invoice)
            if old is None or (step[new[0]], *new[1:3]) > (step[old[0]], *old[1:3]):
                live[invoice] = new
        for invoice, (state, when, number, late) in list(live.items()):
            if state not in status_stream.TERMINAL and when < clock - stuck:
                live[invoice] = ("Failed", when, number, True)
                state = "Failed"
            if state in status_stream.TERMINAL and when < clock - keep:
                del live[invoice]
    return live


def test_status_machine_times_out_and_forgets(spark, tmp_path):
    rng = random.Random(8)
    base = dt.datetime(2020, 1, 1)
    names = list(status.STATUS_ORDER)
    events = [(f"i{rng.randrange(25)}", rng.choice(names[:3] * 4 + names[3:]), base + dt.timedelta(hours=3 * k), k) for k in range(120)]
    schema = "invoice_id string, status string, updated_at timestamp, sequence int"
    source = str(tmp_path / "in")
    for at in range(0, 120, 30):
        spark.createDataFrame(events[at : at + 30], schema).coalesce(1).write.mode("append").parquet(source)
    work = status_stream.status_batches(str(tmp_path / "live"), str(tmp_path / "changes"), ["updated_at", "sequence"], "2 days", "4 days")
    run_to_end(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), work, str(tmp_path / "cp"))
    want = walked(events, 30, dt.timedelta(days=2), dt.timedelta(days=4))
    got = lambda: {r.invoice_id: (r.status, r.updated_at, r.sequence, r.timed_out) for r in status_stream.live_state(spark, str(tmp_path / "live")).collect()}
    assert got() == want and len(want) < 25 and any(v[3] for v in want.values())
    work(spark.createDataFrame(events[90:], schema), 3)  # the last micro-batch again
    assert got() == want
    last = {r.invoice_id: r.status for r in status_stream.last_changes(spark, str(tmp_path / "changes")).collect()}
    assert all(last[k] == v[0] for k, v in want.items())


def test_alarm_periods_without_events(spark, tmp_path):
    base = dt.datetime(2020, 1, 1)
    rows = [(base + dt.timedelta(minutes=m), int(m == 31), 1.0) for m in (0, 1, 31, 32)]
    df = spark.createDataFrame(rows, "ts timestamp, failed int, unknown double")
    filled = alarms.with_calendar(alarms.alarm_windows(df, lateness=None)).orderBy("window_start").collect()
    assert [r.window_start.minute for r in filled] == [0, 5, 10, 15, 20, 25, 30]
    assert [r.failures_alarm for r in filled] == [False] * 6 + [True] and filled[1].failures == 0 and filled[1].unknown_rate is None
    longer = alarms.with_calendar(alarms.alarm_windows(df, lateness=None), base - dt.timedelta(minutes=7), base + dt.timedelta(minutes=41))
    assert longer.count() == 11 and alarms.with_calendar(alarms.alarm_windows(df.limit(0), lateness=None)).count() == 0
    for at in (0, 2):
        spark.createDataFrame(rows[at : at + 2], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_to_end(alarms.alarm_windows(stream), alarms.alarm_batches(str(tmp_path / "w")), str(tmp_path / "cp"), "update")
    streamed = alarms.with_calendar(alarms.latest_windows(spark, str(tmp_path / "w"))).orderBy("window_start").collect()
    assert streamed == filled  # the last window, too


def stepwise_names(rows, folder):
    """Names given one file at a time."""
    used, seen, out = {n for n, _ in rows} | set(folder), set(), {}
    for name, path in sorted(rows, key=lambda r: r[1]):
        if name not in seen and name not in folder:
            out[path] = name
        else:
            at = name.rfind(".")
            bare, tail = (name[:at], name[at:]) if at > 0 else (name, "")
            k = next(k for k in range(1, 10**6) if f"{bare}_{k}{tail}" not in used)
            out[path] = f"{bare}_{k}{tail}"
            used.add(out[path])
        seen.add(name)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_names_are_free(spark, seed):
    rng = random.Random(seed)
    names = ["a.pdf"] * 3 + ["a_1.pdf", "a_2.pdf", "a_1_1.pdf", "b", "b_1", "b_01", ".x", "a_3.tif", "c_99999999999999999999.pdf", "d.pdf"]
    rows = [("a.pdf", "1"), ("a.pdf", "2"), ("a_1.pdf", "3")] if seed == 0 else [(rng.choice(names), f"p{k:03d}") for k in range(90)]
    folder = ["a_7.pdf", "d.pdf", "d_1.pdf", "d_4.pdf", *rng.sample(names, 3)] if seed == 2 else []
    df = spark.createDataFrame(rows, "file_name string, path string")
    taken = spark.createDataFrame([(n,) for n in folder], "name string") if folder else None
    got = {r.path: r.target_name for r in ranks.collision_free_names(df, taken=taken).collect()}
    assert got == stepwise_names(rows, folder)
    assert len(set(got.values()) | set(folder)) == len(rows) + len(set(folder))


def test_amount_is_not_taken_from_the_confidences(spark):
    from docpipe.functions.responses import json_number_text, parse_enrichment

    bodies = {
        '{"total_amount": 12.5, "confidence_summary": {"total_amount": 1e-05}}': 12.5, '{"total_amount": 1.5e2}': 150.0,
        '{"confidence_summary": {"total_amount": 1e-05}, "total_amount": 2E+1}': 20.0, '{"total_amount": 1e-05}': 0.00001,
    }
    df = spark.createDataFrame([(b,) for b in bodies], "body string").withColumn("got", parse_enrichment(F.col("body")))
    text = json_number_text(F.col("body"), "total_amount", F.col("got")["total_amount"])
    assert {r.body: float(r.t) for r in df.select("body", text.alias("t")).collect()} == bodies
    as_text = spark.createDataFrame([('{"total_amount": "1e5"}',)], "body string").withColumn("got", parse_enrichment(F.col("body")))
    assert as_text.select(text.alias("t")).first().t == "1e5"


def test_whole_run(spark, tmp_path):
    raw = spark.createDataFrame(
        [r for r in ROWS], "run_id string, document_id string, vendor_name string, document_date string, total_amount string, currency string, raw_text string"
    ).withColumns({
        "source_s3_key": F.concat(F.lit("raw/run_id="), "run_id", F.lit("/"), "document_id", F.lit(".pdf")), "duration_seconds": F.lit(1.0),
        "source_file_name": F.concat("document_id", F.lit(".pdf")), "raw_text_path": F.lit("x.md"),
        "created_at": F.lit("2020-06-30T10:00:00Z"), "flags": F.expr("cast(array() as array<string>)"),
    })
    root = str(tmp_path / "lake")
    first = run.run_all(raw.filter("run_id = 'r1'"), AS_OF, root, 1).first()
    assert (first.documents_received, first.documents_accepted, first.gold_rows, first.gold_duplicates) == (3, 2, 2, 1)
    for _ in range(2):
        second = run.run_all(raw.filter("run_id = 'r2'"), AS_OF, root, 2).first()
    assert (second.documents_received, second.gold_rows, second.gold_duplicates) == (2, 2, 1)  # r2's a repeats r1's
    assert spark.read.parquet(f"{root}/runs").count() == 2 and spark.read.parquet(f"{root}/gold").count() == 4
    assert spark.read.parquet(f"{root}/bronze").count() == 5
