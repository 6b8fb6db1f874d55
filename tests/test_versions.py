"""Compacted tables, bucketed lookups, batches against history, the retry ledger."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docpipe.operators.duplicates import IDENTITY, mark_batches
from docpipe.plans import sinks
from docpipe.sources import versions
from docpipe.streaming import ingest
from docpipe.streaming.sink import replace_batch, run_to_end

ROW = "k string, part int, v int"


def put(spark, path, epoch, rows):
    versions.put(spark.createDataFrame(rows, ROW), path, epoch, ["k"], 8)


def current(spark, path, **more):
    found = versions.read_current(spark, path, ["k", "part"], buckets=8, **more)
    return sorted((r.k or "", r.part, r.v, r.epoch) for r in found.collect())


def test_compaction_keeps_the_current_view(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(1)
    assert versions.read_current(spark, path, ["k"]) is None
    want = {}
    for epoch in range(1, 7):
        rows = [(rng.choice([None, *"abcdefghij"]), rng.randrange(3), rng.randrange(100)) for _ in range(8)]
        rows = list({(k, p): (k, p, v) for k, p, v in rows}.values())
        put(spark, path, epoch, rows)
        want |= {(k or "", p): (k or "", p, v, epoch) for k, p, v in rows}
        assert current(spark, path) == sorted(want.values())
        if epoch in (2, 5):
            assert versions.compact(spark, path, ["k", "part"], by=["k"], buckets=8).number == (1 if epoch == 2 else 2)
            assert current(spark, path) == sorted(want.values())
    asked = spark.createDataFrame([("a",), ("zz",)], "k string")
    assert current(spark, path, keys=asked) == sorted(r for r in want.values() if r[0] == "a")


def test_compaction_in_rounds_of_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "ROUND_BYTES", 1)  # as many rounds as a large table has
    moved = []
    merged = versions._merged
    monkeypatch.setattr(versions, "_merged", lambda base, tail, *more: moved.append(merged(base, tail, *more)) or moved[-1])
    path, rng, want = str(tmp_path / "t"), random.Random(3), {}
    for epoch in (1, 2, 5, 4, 6):  # 4 comes late, so base rows win over it
        rows = [(rng.choice([None, *"abcdefghijklmnop"]), rng.randrange(3), rng.randrange(100)) for _ in range(30)]
        rows = list({(k, p): (k, p, v) for k, p, v in rows}.values())
        rows += rows[:2]  # rows that repeat in a delivery both stay
        put(spark, path, epoch, rows)
        for k, p, v in set(rows):
            if want.get((k or "", p), (0,))[0] < epoch:
                want[k or "", p] = (epoch, [v] * rows.count((k, p, v)))
        before = len(moved)
        versions.compact(spark, path, ["k", "part"], by=["k"], buckets=8)
        assert 2 <= len(moved) - before <= versions.ROUNDS
        assert current(spark, path) == sorted((k, p, v, e) for (k, p), (e, vs) in want.items() for v in vs)
        if epoch == 1:  # one delivery only: nothing to be told apart, so nothing moves but to its bucket
            assert all("Exchange" not in m._jdf.queryExecution().sparkPlan().toString() and "Join" not in m._jdf.queryExecution().sparkPlan().toString() for m in moved)
    files = [f.name for f in (tmp_path / "t").rglob("*.parquet")]
    assert files and all("zstd" in f for f in files)


def test_a_replayed_delivery_is_never_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 1, [("a", 1, 10), ("b", 1, 10)])
    put(spark, path, 2, [("a", 1, 20)])
    versions.compact(spark, path, ["k", "part"], by=["k"], buckets=8)
    put(spark, path, 2, [("a", 1, 21), ("c", 1, 21)])  # the covered delivery comes again, whole this time
    assert current(spark, path) == [("a", 1, 21, 2), ("b", 1, 10, 1), ("c", 1, 21, 2)]
    versions.compact(spark, path, ["k", "part"], by=["k"], buckets=8)
    assert current(spark, path) == [("a", 1, 21, 2), ("b", 1, 10, 1), ("c", 1, 21, 2)]


def test_two_compactions_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 1, [("a", 1, 10)])
    versions.compact(spark, path, ["k", "part"], by=["k"], buckets=8)
    with pytest.raises(RuntimeError):
        versions._publish(spark, path, versions.Version(1, 8, {}, {}))
    assert current(spark, path) == [("a", 1, 10, 1)]


def test_lookup_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    for epoch in (1, 2, 3):
        put(spark, path, epoch, [(f"k{epoch}-{i}", 0, i) for i in range(400)])
    asked = spark.createDataFrame([("k1-5",), ("k2-7",)], "k string")
    for compacted in (False, True):
        if compacted:
            versions.compact(spark, path, ["k", "part"], by=["k"], buckets=8, upto=2)
        found = versions.read_current(spark, path, ["k", "part"], keys=asked, buckets=8)
        assert sorted((r.k, r.v) for r in found.collect()) == [("k1-5", 5), ("k2-7", 7)]
        if not compacted:
            assert all("PartitionFilters: [" + "bucket" in line for line in scans(found))
            continue
        tail = [f for f in found.inputFiles() if "epoch=" in f]
        base = {f.split("_in=")[1].split("/")[0] for f in found.inputFiles() if "_in=" in f}
        buckets = {r[0] for r in asked.select(versions.bucket_of(["k"], 8).cast("string")).collect()}
        assert base == buckets and all("epoch=3" in f for f in tail)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.split("\n") if "FileScan parquet" in line and "PartitionFilters" in line]
    assert found
    return [line.replace("[isnotnull(bucket", "[bucket") for line in found]


def test_silver_and_status_after_compaction(spark, tmp_path):
    path = str(tmp_path / "silver")
    rows = [("r1", "a", "failed"), ("r1", "b", "valid"), (None, "c", "valid")]
    schema = "run_id string, document_id string, outcome string"
    replace_batch(spark.createDataFrame(rows, schema), path, 1, "outcome")
    replace_batch(spark.createDataFrame([("r1", "a", "valid")], schema), path, 2, "outcome")
    look = lambda: sorted((str(r.run_id), r.document_id, r.outcome, r.epoch) for r in sinks.read_silver(spark, path).collect())
    before = look()
    assert before == [("None", "c", "valid", 1), ("r1", "a", "valid", 2), ("r1", "b", "valid", 1)]
    sinks.compact_silver(spark, path)
    assert look() == before
    assert sorted(map(str, sinks.current(spark.read.parquet(path)).select("document_id").collect())) == sorted(
        map(str, sinks.read_silver(spark, path).select("document_id").collect())
    )
    states, schema = str(tmp_path / "status"), "invoice_id string, run_id string, status string, updated_at string"
    sinks.write_status(spark.createDataFrame([("i", "r", "Processing", "2"), ("j", "r", "Uploaded", "1")], schema), states, 1)
    sinks.write_status(spark.createDataFrame([("i", "r", "Uploaded", "1")], schema), states, 2)  # an older event comes late
    for _ in range(2):
        assert sorted((r.invoice_id, r.status) for r in sinks.read_status(spark, states).collect()) == [("i", "Processing"), ("j", "Uploaded")]
        sinks.compact_status(spark, states)
    asked = spark.createDataFrame([("j",)], "invoice_id string")
    assert [r.status for r in sinks.read_status(spark, states, asked).collect()] == ["Uploaded"]


def sequential_marks(batch, history):
    """One batch as a walk: history without the batch's documents, then the batch, in order."""
    own = {r[:3] for r in batch}
    prints, keys, out = {}, {}, {}
    for late, rows in ((False, [r for r in history if r[:3] not in own]), (True, batch)):
        for r in sorted(rows, key=lambda r: (r[5], r[0], r[1], r[2])):
            exact, business = prints.get(r[3]), keys.get(r[4]) if r[4] is not None else None
            if late:
                out[r[:3]] = ("exact_fingerprint", exact) if exact else ("business_key", business) if business else ("none", None)
            prints.setdefault(r[3], r[1])
            if r[4] is not None:
                keys.setdefault(r[4], r[1])
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_batches_against_history(spark, seed):
    rng = random.Random(seed)
    rows = [
        (f"r{rng.randrange(2)}", f"d{i}", f"k{i}", rng.choice(["hot"] * 6 + [f"f{rng.randrange(12)}"] * 6), rng.choice([None, "b1", "b2", f"b{i}"]), rng.randrange(50))
        for i in range(60)
    ]
    schema = "run_id string, document_id string, source_s3_key string, document_fingerprint string, business_key string, seq int"
    history = spark.createDataFrame(rows, schema)
    batches = {f"batch-{b}": rng.sample(rows, n) for b, n in enumerate((1, 5, 20, 60, 9))}  # a document may stand in several
    listed = spark.createDataFrame([(b, *r) for b, rs in batches.items() for r in rs], "batch_id string, " + schema)
    got = {
        (r.batch_id, r.run_id, r.document_id): (r.duplicate_strategy, r.duplicate_of_document_id)
        for r in mark_batches(listed, history, ["seq"]).collect()
    }
    want = {(b, r[0], r[1]): m for b, rs in batches.items() for r, m in ((q, sequential_marks(rs, rows)[q[:3]]) for q in rs)}
    assert got == want and IDENTITY == ["run_id", "document_id", "source_s3_key"]


def test_retry_ledger_sets_each_message_aside_once(spark, tmp_path):
    rng = random.Random(5)
    events = [(i, f"m{rng.randrange(6)}", rng.random() < 0.7) for i in range(60)]
    source, schema = str(tmp_path / "in"), "at int, message string, failed boolean"
    for start in range(0, 60, 15):
        spark.createDataFrame(events[start : start + 15], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("error", F.concat(F.lit("e"), "at"))
    ledger, letters = str(tmp_path / "ledger"), str(tmp_path / "letters")
    work = ingest.retry_ledger(ledger, letters, ["message"], ["at"], limit=3, buckets=4, compact_every=2)
    run_to_end(stream, work, str(tmp_path / "cp"))
    want, seen = {}, {}
    for part in (events[i : i + 15] for i in range(0, 60, 15)):
        before = dict(seen)
        for at, message, failed in part:
            if failed:
                seen[message] = (seen.get(message, (0, 0))[0] + 1, at)
        for m, (n, at) in seen.items():
            if before.get(m, (0, 0))[0] < 3 <= n:
                want[m] = (n, f"e{at}")
    got = [(r.message, r.failures, r.last_error) for r in spark.read.parquet(letters).collect()]
    assert sorted(got) == sorted((m, n, e) for m, (n, e) in want.items())
    last = spark.createDataFrame(events[45:], schema).withColumn("error", F.concat(F.lit("e"), "at"))
    work(last, 3)  # the last micro-batch again
    assert sorted((r.message, r.failures, r.last_error) for r in spark.read.parquet(letters).collect()) == sorted(got)
