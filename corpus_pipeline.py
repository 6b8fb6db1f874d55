"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Every stage reads what the stage before it kept, as stored Parquet. All but the last return the columns of documents.
The verdicts of the stages are estimates and hashes that SQL cannot express, so there is no oracle. Tests hold the near-duplicate
and decontamination stages against brute force, and the rules' statistics, the spans and the packing's places; the outlier
verdicts and learnt secrets are tested for their effects only.

An empty table stays empty. A null text has no words and fails the quality rules; null ids, languages and sources are values like
any other; rows that repeat are judged each for itself but by the near-duplicate stage, where one of them stays. Columns of other
names pass through the first four stages, also where an operator uses the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import fresh, stage, table
from docpipe.llm.grammar_secrets import redact
from docpipe.llm.hyperminhash import near_duplicates
from docpipe.llm.mcd_rules import verdicts
from docpipe.llm.packing import pack_documents
from docpipe.llm.phrase_index import decontaminate
from docpipe.llm.queries import tokenizer_path

NEAR = 0.8  # shingle similarity of the near-duplicate stage; the contract of op5 binds that query only


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go; each row is judged for itself."""
    judged, verdict = verdicts(docs)
    return judged.where(F.col(f"{verdict}.kept")).select(*docs.columns)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for every row, and that column's name.

    ``docs`` must give the same rows in the same partitions each time it is read (a scan of stored files does).
    """
    key = fresh(docs, "row_key")
    return docs.withColumn(key, F.monotonically_increasing_id()), key


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id; rows without an id and repeated ids are judged as any other."""
    keyed, key = with_row_key(docs)
    linked = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), threshold=NEAR)
    linked = stage(linked.select(F.col("doc_id").alias(key), "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("key"))
    stays = linked.join(keyed.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(order).getField("key").alias("stays"))
    marks = linked.join(stays, "component_id").where(F.col(key) != F.col("stays")).select(key)
    return keyed.join(marks, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are contaminated by the benchmark go, with an id or without; each row is judged for itself."""
    keyed, key = with_row_key(docs)
    judged = decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    marks = judged.where("contaminated").select(F.col("doc_id").alias(key))
    return keyed.join(marks, key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null texts too."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens; a null text is an empty one."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
