"""The gold table in the session's catalog, with its batches as partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe import schemas


def create_gold_table(spark: SparkSession, name: str, location: str) -> None:
    """An external table over a folder of gold batches; its partitions are found, its schema is declared."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.GOLD.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch_id STRING) USING parquet PARTITIONED BY (batch_id) LOCATION '{location}'")
    refresh_partitions(spark, name)


def refresh_partitions(spark: SparkSession, name: str) -> None:
    """Register batches that landed since."""
    spark.sql(f"MSCK REPAIR TABLE {name}")


def batches(spark: SparkSession, name: str) -> DataFrame:
    """The batches by their partition names; no file is opened."""
    names = spark.sql(f"SHOW PARTITIONS {name}").select(F.substring_index("partition", "=", -1).alias("batch_id"))
    return names.filter(~F.col("batch_id").isin("__HIVE_DEFAULT_PARTITION__", "null"))


def latest_batch(spark: SparkSession, name: str) -> str | None:
    return batches(spark, name).agg(F.max("batch_id")).first()[0]


def batch_rows(spark: SparkSession, name: str, batch_id: str | None) -> DataFrame:
    """One batch's rows: the scan lists that partition only."""
    return spark.table(name).filter(F.col("batch_id") == F.lit(batch_id))
