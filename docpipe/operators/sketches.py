"""Distinct counts from mergeable sketches that are kept per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 12  # 4096 registers: a relative standard error of 1.04 / 64 = 0.016


def distinct_sketches(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row per group: its row count and one sketch per value column (null if it has no value)."""
    sketches = [F.hll_sketch_agg(F.col(v), F.lit(LOG_K)).alias(f"{v}_sketch") for v in values]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *sketches)


def united_distinct(sketches: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Distinct counts of coarser groups, from their sketches alone; the rows are not read again."""

    def count(v: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{v}_sketch")), F.lit(0)).cast("bigint")

    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *[count(v).alias(f"{v}_distinct") for v in values])
