"""Exact positions and percentiles without one-task groups.

A window over a whole group sorts that group in one task. Here the rows are
range-partitioned by (group, order) instead, so a big group spans many
partitions, and pinned by a reliable checkpoint, so positions survive the loss
of executors. A row's position is then its place in its partition plus the rows
of the same group in earlier partitions, and that last sum runs over one row per
(group, partition) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.functions.keys import stem
from docpipe.session import checkpointed


def _pinned(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    keys = [F.col(c) for c in (*group, *order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pinned = checkpointed(ranged.withColumn("_pos", F.monotonically_increasing_id()))
    return pinned.withColumn("_part", F.shiftright("_pos", 33))


def _offsets(parts: DataFrame, group: list[str]) -> DataFrame:
    """``parts`` has one row per (group, partition) with ``_rows``; adds rows before and in all."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return parts.withColumns(
        {
            "_before": F.coalesce(
                F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "_total": F.sum("_rows").over(whole),
        }
    )


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Add each row's zero-based position within its group; ``order`` must be unique there."""
    pinned = _pinned(df, group, order)
    parts = pinned.groupBy(*group, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    starts = _offsets(parts, group).select(*group, "_part", "_first", "_before")
    return pinned.join(starts, [*group, "_part"]).select(
        *df.columns, (F.col("_pos") - F.col("_first") + F.col("_before")).alias(name)
    )


_NUMBERED = "^(?s)(.+)_([1-9][0-9]{0,17})$"


def _parts(name: Column) -> tuple[Column, Column]:
    bare = stem(name)
    return bare, F.substr(name, F.length(bare) + 1)


def collision_free_names(
    df: DataFrame, name: str = "file_name", order: str = "path", taken: DataFrame | None = None, taken_name: str = "name"
) -> DataFrame:
    """Add ``target_name``, different for every row and from every name in ``taken`` (a folder's contents).

    The first row of a name, in path order, keeps it unless the folder has it. Every other row takes the least number
    free for its stem, in path order: ``stem_1``, ``stem_2`` and so on, without those that another file or the folder
    is already called. A generated name is a stem and its last number, so names of other stems cannot meet it.

    Only rows without a name of their own are numbered. The ``k``-th of them takes the ``k``-th free number, which is
    ``k`` plus the held numbers passed on the way. The ``i``-th held number ``t`` is passed if ``t - i < k``, so rows and
    held numbers merged in that order give it by position, without a task per stem.
    """
    firsts = df.groupBy(F.col(name).alias("_name")).agg(F.min(order).alias("_first"))
    names = firsts.select("_name")
    if taken is None:
        held, firsts = names, firsts.withColumn("_free", F.lit(True))
    else:
        folder = taken.select(F.col(taken_name).alias("_name")).distinct()
        held = names.union(folder).distinct()
        firsts = firsts.join(folder.withColumn("_held", F.lit(True)), "_name", "left").select(
            "_name", "_first", F.col("_held").isNull().alias("_free")
        )
    own = firsts.filter("_free").select(F.col("_name").alias("_own"), F.col("_first").alias("_at"))
    met = df.join(own, (F.col(name) == F.col("_own")) & (F.col(order) == F.col("_at")), "left")
    keeps = met.filter(F.col("_own").isNotNull()).select(*df.columns, F.col(name).alias("target_name"))

    bare, tail = _parts(F.col(name))
    others = positions(met.filter(F.col("_own").isNull()).select(*df.columns), [name], [order], "_k")
    ranked = others.select(*df.columns, bare.alias("_stem"), tail.alias("_tail"), (F.col("_k") + 1).alias("_at"))
    bare, tail = _parts(F.col("_name"))
    numbered = held.select(bare.alias("_bare"), tail.alias("_tail")).filter(F.col("_bare").rlike(_NUMBERED)).select(
        F.regexp_extract("_bare", _NUMBERED, 1).alias("_stem"), "_tail",
        F.regexp_extract("_bare", _NUMBERED, 2).cast("bigint").alias("_number"),
    )
    wanted = numbered.join(ranked.select("_stem", "_tail").distinct(), ["_stem", "_tail"])
    passed = positions(wanted, ["_stem", "_tail"], ["_number"], "_i").select(
        "_stem", "_tail", (F.col("_number") - F.col("_i")).alias("_at"), F.lit(0).alias("_row"), F.col("_i").alias("_tie")
    )
    # A held number stands before the first row that passes it: t - i < k, with i counted from one.
    merged = ranked.withColumns({"_row": F.lit(1), "_tie": F.lit(0).cast("bigint")}).unionByName(passed, allowMissingColumns=True)
    placed = positions(merged, ["_stem", "_tail"], ["_at", "_row", "_tie"], "_place").filter("_row = 1")
    target = F.concat("_stem", F.lit("_"), (F.col("_place") + 1).cast("string"), "_tail")
    return keeps.unionByName(placed.select(*df.columns, target.alias("target_name")))


def nearest_rank(
    df: DataFrame, value: str, quantiles: dict[str, float], group: list[str] | None = None
) -> DataFrame:
    """Nearest-rank percentiles, maximum and mean per group.

    The value at index ``min(n - 1, round_half_even(q * (n - 1)))`` of the sorted
    values. Equal values are counted first, so a value that fills a third of the
    rows travels as one row per map task.
    """
    group = group or []
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    pinned = _pinned(counts, group, [value])
    parts = pinned.groupBy(*group, "_part").agg(F.sum("_n").alias("_rows"))
    offsets = _offsets(parts, group).select(*group, "_part", "_before", "_total")
    inside = Window.partitionBy(*group, "_part").orderBy("_pos")
    reach = pinned.withColumn("_upto", F.sum("_n").over(inside)).join(offsets, [*group, "_part"])
    upto = F.col("_upto") + F.col("_before")
    picks = []
    for name, q in quantiles.items():
        index = F.least(
            F.col("_total") - 1, F.bround(F.lit(q) * (F.col("_total") - 1).cast("double"), 0).cast("bigint")
        )
        hit = (upto > index) & (upto - F.col("_n") <= index)
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return reach.groupBy(*group).agg(
        *picks,
        F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("avg"),
        F.sum("_n").alias("n"),
    )
