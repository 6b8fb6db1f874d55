"""Left join to a side that is unique per key, safe when one left key holds a third of the rows.

A window or a plain shuffle join would send every row of a hot key to one task,
and the runtime skew-join rule cannot split a join whose other side is an
aggregate on the same key. So hot keys take another way:

* a key is *hot* when it holds more than ``1 / HOT_SHARE`` of all rows. At most
  ``HOT_SHARE`` keys can, whatever the data, so broadcasting their right-hand
  rows has a fixed bound;
* every other key is smaller than an average partition of a ``HOT_SHARE``-way
  shuffle and joins by key;
* rows already served by the broadcast, and rows without a key, carry a non-zero
  ``_spread`` into the shuffle join. They match nothing there and, hashed
  together with the key, they spread over all partitions. The zero that the other
  side holds must not be a literal: the optimizer would put that into the join's
  condition, and rows would be dealt by the key alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 2000
_SPREAD = 4096


def key_counts(left: DataFrame, key: str) -> DataFrame:
    return left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))


def join_unique(
    left: DataFrame, right: DataFrame, key: str, row_id: list[str], counted: bool = False
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key``; ``right`` holds each key at most once.

    ``row_id`` names left columns that tell rows apart (used only for spreading).
    With ``counted`` the right side already has ``_n``, the left rows per key, and
    ``_total``, the scalar number of left rows; both are dropped from the result.
    """
    if counted:
        hot_test = F.col("_n") * HOT_SHARE > F.col("_total")
        weighted = right
    else:
        counts = key_counts(left, key)
        total = left.agg(F.count(F.lit(1))).scalar()
        hot_keys = counts.filter(F.col("_n") * HOT_SHARE > total).select(key)
        weighted = right.join(F.broadcast(hot_keys.withColumn("_hot", F.lit(True))), key, "left")
        hot_test = F.coalesce(F.col("_hot"), F.lit(False))
    payload = [c for c in right.columns if c not in (key, "_n", "_total")]
    sides = weighted.select(
        F.col(key).alias("_key"), F.struct(*payload).alias("_payload"), hot_test.alias("_is_hot")
    )
    hot = sides.filter("_is_hot").select(F.col("_key").alias("_hot_key"), F.col("_payload").alias("_hot_payload"))
    cold = sides.filter("not _is_hot").select(
        F.col("_key").alias("_cold_key"), F.col("_is_hot").cast("int").alias("_cold_spread"), F.col("_payload").alias("_cold_payload")
    )
    served = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_spread",
        F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*row_id), F.lit(_SPREAD)).cast("int") + 1
        ),
    )
    joined = served.join(
        cold, (F.col(key) == F.col("_cold_key")) & (F.col("_spread") == F.col("_cold_spread")), "left"
    )
    found = F.coalesce(F.col("_hot_payload"), F.col("_cold_payload"))
    return joined.select(*left.columns, *[found[c].alias(c) for c in payload])
