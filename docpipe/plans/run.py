"""A whole run: extracted texts to bronze, silver, gold, its manifest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.operators.metrics import run_summary
from docpipe.plans.gold import STORAGE_ORDER, build_gold, with_identity
from docpipe.plans.silver import silver_from_text
from docpipe.plans.sinks import append_run, read_silver, write_bronze_text, write_gold_by_run, write_silver


def run_all(extracted: DataFrame, as_of: dt.date, root: str, delivery: int, order: list[str] | None = None) -> DataFrame:
    """Take one delivery of extracted texts through all stages below ``root``; gives its runs' manifests.

    Every stage reads what the one before has written, and every write replaces what the same delivery wrote before, so
    a broken run is repeated as a whole. Gold marks the delivery's documents against all earlier silver; ``keep`` columns
    of the texts that ``order`` names are carried along.
    """
    spark, order = extracted.sparkSession, order or STORAGE_ORDER
    keep = [c for c in order if c not in STORAGE_ORDER]
    texts = extracted.select(F.col("raw_text").alias("text"), "source_file_name", F.col("source_s3_key").alias("source_path"))
    write_bronze_text(texts, f"{root}/bronze", delivery)
    silver = silver_from_text(extracted, as_of, keep=[*keep, "duration_seconds"])
    write_silver(with_identity(silver), f"{root}/silver", delivery)
    everything = read_silver(spark, f"{root}/silver")
    now = everything.filter(F.col("epoch") == delivery)
    valid = everything.filter(F.col("outcome") == "valid")
    past = valid.filter(F.col("epoch") < delivery)
    gold = build_gold(valid.filter(F.col("epoch") == delivery), history=past, order=order, keep=keep)
    write_gold_by_run(gold, f"{root}/gold", delivery)
    stored = spark.read.parquet(f"{root}/gold").filter(F.col("epoch") == delivery)
    rows = stored.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("gold_rows"), F.count_if("is_duplicate").alias("gold_duplicates")
    )
    summary = run_summary(now).join(rows, "run_id", "left").fillna(0, ["gold_rows", "gold_duplicates"])
    append_run(summary, f"{root}/runs", delivery)
    return spark.read.parquet(f"{root}/runs").filter(F.col("epoch") == delivery).drop("epoch")
