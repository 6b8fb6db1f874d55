"""Declarative transform jobs: a SQL text, an output contract, a check, a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.operators.skew import key_counts


@dataclass(frozen=True)
class TransformJob:
    name: str
    sql: str
    dataset: str
    primary_key: tuple[str, ...]
    columns: tuple[str, ...]


CURATED_ORDERS = TransformJob(
    name="orders_curated",
    sql="""
        SELECT order_id, customer_id, order_total, order_date
        FROM bronze_orders
        WHERE order_total IS NOT NULL
    """,
    dataset="curated.orders",
    primary_key=("order_id",),
    columns=("order_id", "customer_id", "order_total", "order_date"),
)


def run_transform(spark: SparkSession, job: TransformJob, inputs: dict[str, DataFrame]) -> DataFrame:
    """The job's result; its inputs are bound by name, its column list is checked."""
    for name, df in inputs.items():
        df.createOrReplaceTempView(name)
    result = spark.sql(job.sql)
    if tuple(result.columns) != job.columns:
        raise ValueError(f"{job.name}: columns {result.columns} differ from the contract {list(job.columns)}")
    return result


def key_violations(result: DataFrame, job: TransformJob) -> DataFrame:
    """One row: rows with a null key, keys that occur more than once."""
    key = F.struct(*job.primary_key)
    complete = F.lit(True)
    for name in job.primary_key:
        complete = complete & F.col(name).isNotNull()
    keyed = result.withColumn("_key", F.when(complete, key))
    repeated = key_counts(keyed, "_key").agg(F.count_if(F.col("_n") > 1)).scalar()
    return keyed.agg(F.count_if(F.col("_key").isNull()).alias("null_keys")).withColumn("repeated_keys", repeated)
