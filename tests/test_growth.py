"""What grows with the input is spread over tasks, files and batches."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from docpipe.operators import skew
from docpipe.plans import sinks
from docpipe.streaming import gold as gold_stream
from tests.conftest import SF
from tests.test_streaming import silver_rows
from workload import inputs, queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_key_are_dealt_by_the_spread(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 1000)).alias("key"))
    right = left.filter("key is not null").groupBy("key").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("_n"), F.lit(20_000).alias("_total"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side in (right, right.drop("_n", "_total")):
            joined = skew.join_unique(left, side, "key", ["id"], counted="_n" in side.columns)
            assert re.search(r"hashpartitioning\(key#\d+, _spread#\d+", plan(joined))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_derived_inputs_are_dealt_by_hash_and_only_once(spark, monkeypatch):
    """Given tables are dealt by hash while they are narrow; inputs made from a stored one stay where it lies."""
    kind, calls = type(spark.range(1)), []
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *by: calls.append((by[1:], df.columns)) or real(df, *by))
    monkeypatch.setattr(inputs, "_TABLES", {})
    for name in ("bronze", "enrichment", "attempts", "envelopes"):
        inputs.STORED[name](spark, SF)
        assert len(calls) == 1 and calls[0][0] and len(calls.pop()[1]) <= 4
    for name in ("extracted", "evidence", "candidates"):
        assert inputs.STORED[name](spark, SF).count() == 1500 - (name == "candidates") * inputs.evidence(spark, SF).filter("status <> 'success'").count()
    assert not calls


def test_manifests_of_many_batches_share_files(spark, tmp_path):
    path = str(tmp_path / "m")
    made = spark.range(0, 500, 1, 4).select(F.concat(F.lit("b"), "id").alias("batch_id"), F.lit("completed").alias("status"), F.array(F.lit("r")).alias("run_ids"))
    for _ in range(2):
        sinks.write_manifest(made, path)
    again = made.filter("batch_id in ('b1', 'b2')").withColumn("status", F.lit("redone"))
    sinks.write_manifest(again, path)
    got = {r.batch_id: (r.status, r.run_ids) for r in sinks.read_manifests(spark, path, made.schema).collect()}
    assert got == {f"b{i}": ("redone" if i in (1, 2) else "completed", ["r"]) for i in range(500)}
    assert sinks.read_manifests(spark, path, made.schema).count() == 500
    assert sum(len(folders) for _, folders, _ in os.walk(path)) == 3  # one a write
    sinks.write_manifest(made.limit(1).withColumn("status", F.lit("last")), path, 3)  # a delivery again replaces itself
    assert sorted(r.status for r in sinks.read_manifests(spark, path, made.schema).collect())[-1] == "last"


def test_history_of_a_micro_batch_is_stored(spark, tmp_path, monkeypatch):
    seen = []
    real = gold_stream.mark_against_history
    monkeypatch.setattr(gold_stream, "mark_against_history", lambda now, past, order: seen.append(plan(past)) or real(now, past, order))
    silver = silver_rows(spark, 30)
    work = gold_stream.gold_batches(str(tmp_path / "gold"), str(tmp_path / "index"), ["seq"])
    work(silver.filter("seq < 20"), 0)
    work(silver.filter("seq >= 20"), 1)
    assert len(seen) == 1 and "Join" not in seen[0] and "Exchange" not in seen[0]


def test_parts_of_several_files_are_one_micro_batch_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 50, raising=False)
    rows = spark.range(0, 1000, 1, 4).withColumn("x", F.col("id") * 2)
    path = str(tmp_path / "in")
    files = queries.in_parts(rows, "id", 4, path, whole=True)
    assert files == 5
    sizes = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    queries.run_to_end(stream, lambda batch, epoch: sizes.append(tuple(batch.agg(F.min("id"), F.max("id"), F.count("x")).first())), str(tmp_path / "cp"))
    assert sizes == [(0, 249, 250), (250, 499, 250), (500, 749, 250), (750, 999, 250), (0, 999, 1000)]
    # A part without rows leaves one file a part, as do small parts.
    gap = rows.filter("id < 250 or id >= 750")
    assert queries.in_parts(gap, "id", 4, str(tmp_path / "gap")) == 1


def test_text_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    n = queries.bronze_text_scan(spark, SF).count()
    folder = tmp_path / "bronze-text"
    names = [f for f in os.listdir(folder) if f.endswith(".txt") and os.path.getsize(folder / f)]
    assert len(names) == n and len({re.match(r"part-(\d+)", f).group(1) for f in names}) > 1
