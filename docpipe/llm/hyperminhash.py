"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

A document is its set of distinct word shingles. Every bucket has a permutation of its own (so short documents leave no
bucket empty) and keeps the smallest value only as a leading-zero count (6 bits) and the mantissa bits behind it (10).

Equal sets are one class and are told apart no further. Between classes, registers are banded. Groups of copies of any
size cost a number of pairs in proportion to their members:

1. every class is compared with the smallest member it shares a band with (one pair a class), links are joined up;
2. then with the smallest members of its other bands, if those are still elsewhere;
3. then, only in bands that still hold several components, members of different components are compared by their
   registers, in blocks of bounded size, and those that may reach the threshold are confirmed in the same task.

So every pair that shares a band is either already connected or has been compared: nothing is capped. With 32 bands of 6
a pair at 0.85 shares none with probability 3e-7. A pair is confirmed on its full texts if the estimate, corrected for
registers equal by chance, is within five standard errors of the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, likely, lowered_words, mixed, shingle_hashes, signed, slices, stage
from .graph import components

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 32, 6, 0.85
MANTISSA = 10  # bits kept after the leading one
BLOCK = 400  # members of a band compared with each other at once
SLACK = 5.0  # standard errors
HELD = 8_000_000  # shingles of a block's texts that a task keeps at once


def _multipliers(buckets: int) -> np.ndarray:
    return mixed(np.arange(1, buckets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest permuted value of each bucket, as ``leading zeros << 10 | mantissa``.

    A float64 holds just these two parts: its exponent counts the leading zeros, its first bits are the mantissa.
    """
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(low, (shingles[at : at + 512, None] * multipliers).min(axis=0), out=low)
    bits = np.maximum(low, np.uint64(1)).astype(np.float64).view(np.uint64)
    zeros = np.uint64(1023 + 64) - (bits >> np.uint64(52))
    return ((zeros << np.uint64(MANTISSA)) | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    wide = regs.reshape(bands, -1).astype(np.uint64)
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(wide.shape[1]):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, k] + np.uint64(1))
    return keys


def estimate(equal, sizes_a, sizes_b, buckets: int):
    """Jaccard similarity from equal registers, less those expected to be equal by chance.

    Two smallest values of sets of n and m elements fall in the same cell, whose mean width is 0.7 * 2^-10 of the value,
    with probability 0.7 * 2^-10 * n m / (n + m)^2.
    """
    chance = buckets * 0.7 * 2.0**-MANTISSA * sizes_a * sizes_b / (sizes_a + sizes_b) ** 2
    return (equal - chance) / (buckets - chance)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= round(100 * threshold) * (len(a) + len(b) - both)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, regs, bands): k1, k2 name the shingle set; null for an empty one."""
    multipliers = _multipliers(bands * rows)

    def of_batch(batches):
        for batch in slices(batches):
            n, k1, k2, regs, keys = [], [], [], [], []
            for data in batch.column(1).to_pylist():
                unique = np.unique(shingle_hashes(lowered_words(data), shingle))
                n.append(len(unique))
                if not len(unique):
                    for out in (k1, k2, regs, keys):
                        out.append(None)
                    continue
                k1.append(int(signed(unique).sum()))
                k2.append(int(signed(mixed(unique ^ np.uint64(0xA5A5A5A5A5A5A5A5))).sum()))
                own = registers(unique, multipliers)
                regs.append(own.tobytes())
                keys.append(signed(band_keys(own, bands)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "regs", "bands"],
            )

    rows_in = docs.select("doc_id", binary("text").alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(of_batch, f"doc_id {kind}, n_shingles long, k1 long, k2 long, regs binary, bands array<long>")


def _may_link(pairs: DataFrame, classes: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """Pairs whose corrected estimate can still mean ``threshold``."""
    least = threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / buckets))
    side = lambda at: classes.select(F.col("node").alias(at), F.col("n").alias(f"n_{at}"), F.col("regs").alias(f"regs_{at}"))

    def of_batch(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b, r_a, r_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n_a", "n_b", "regs_a", "regs_b"))
            r_a, r_b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, buckets) for x in (r_a, r_b))
            near = estimate((r_a == r_b).sum(axis=1), n_a.to_numpy(False), n_b.to_numpy(False), buckets) >= least
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(near))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(of_batch, pairs.select("a", "b").schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs whose full shingle sets reach ``threshold``, as edges (u, v)."""

    def of_batch(batches):
        sets: dict = {}  # a smallest member recurs in a batch
        for batch in slices(batches):
            a, b, text_a, text_b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for x, y, s, t in zip(a, b, text_a, text_b):
                if (y, t) not in sets:
                    if len(sets) > 64:
                        sets.clear()
                    sets[y, t] = np.unique(shingle_hashes(lowered_words(t), shingle))
                keep.append(similar(np.unique(shingle_hashes(lowered_words(s), shingle)), sets[y, t], threshold))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in "ab"], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda at: texts.select(F.col("doc_id").alias(at), F.col("text").alias(f"text_{at}"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(of_batch, f"u {kind}, v {kind}")


def _joined_up(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, comp)`` after joining the components that ``edges`` (between nodes) connect."""
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = edges.join(at("u"), "u").join(at("v"), "v").select(F.col("comp_u").alias("u"), F.col("comp_v").alias("v"))
    merged = components(between)
    return stage(
        nodes.join(merged.select(F.col("node").alias("comp"), "component"), "comp", "left")
        .select("node", F.coalesce("component", "comp").alias("comp")),
        "members",
    )


def _blocks_of(rows: DataFrame, kind: str, bands: int, buckets: int, threshold: float, with_texts: bool, shingle: int) -> DataFrame:
    """Compare the members of every (band, p, q): block p with block q. See ``_across``.

    Without texts: the members that have a partner in another component whose estimate may reach the threshold, as
    (band, p, q, node). With texts: confirmed links (u, v).
    """
    least = threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / buckets))

    def of_group(key, frame):
        node, comp = frame.column("node").to_numpy(), frame.column("comp").to_numpy()
        n, block = frame.column("n").to_numpy(), frame.column("block").to_numpy()
        regs = np.frombuffer(b"".join(frame.column("regs").to_pylist()), np.uint16).reshape(-1, buckets)
        p, q, nth = key[1].as_py(), key[2].as_py(), frame.column("nth")[0].as_py()
        group = np.unique(comp, return_inverse=True)[1]  # components as joined so far in these blocks
        sets: dict[int, np.ndarray] = {}
        held = 0

        def shingles(i):
            nonlocal held
            if i not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[i] = np.unique(shingle_hashes(lowered_words(frame.column("text")[i].as_py()), shingle))
                held += len(sets[i])
            return sets[i]

        found, met = [], np.zeros(len(node), bool)
        right = np.flatnonzero(block == q)
        for i in np.flatnonzero(block == p):
            other = right[(group[right] != group[i]) & ((node[right] > node[i]) if p == q else True)]
            if not len(other):
                continue
            equal = regs[other] == regs[i]
            score = estimate(equal.sum(axis=1), n[i], n[other], buckets)
            near = (score >= least) & (equal.reshape(len(other), bands, -1).all(axis=2).argmax(axis=1) == nth)
            if not with_texts:
                met[other[near]] = True
                met[i] |= near.any()
                continue
            for j in other[near][np.argsort(-score[near], kind="stable")]:
                if group[i] != group[j] and similar(shingles(int(i)), shingles(int(j)), threshold):
                    found.append((node[i], node[j]))
                    group[group == group[j]] = group[i]
        if not with_texts:
            return frame.select(["band", "p", "q", "node"]).filter(pa.array(met))
        u, v = (np.array([pair[k] for pair in found], node.dtype) for k in (0, 1))
        return pa.table({"u": u, "v": v})

    schema = f"u {kind}, v {kind}" if with_texts else f"band long, p int, q int, node {kind}"
    return rows.groupBy("band", "p", "q").applyInArrow(of_group, schema)


def _across(members: DataFrame, texts: DataFrame, bands: int, buckets: int, threshold: float, shingle: int) -> DataFrame:
    """Links (u, v) that join components within a band.

    ``members``: (band, nth, node, comp, n, regs). A band with many members is cut in blocks, compared two at a time, by
    registers alone. A pair that shares several bands is compared in the first of them only. Only members with a partner
    whose estimate may reach the threshold are then met again with their texts and confirmed there, unless the links of
    the same blocks connect them already; so a task gives fewer links than it has members, however many pairs are alike.
    """
    kind = members.schema["node"].dataType.simpleString()
    mixed_bands = (
        members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
        .where("lo != hi").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    placed = stage(members.join(mixed_bands, "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "placed")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("p"), F.greatest(x, "block").alias("q")))
    dealt = placed.select("band", "nth", "node", "comp", "n", "regs", "block", F.explode(meets).alias("m"))
    dealt = dealt.select("band", "nth", "node", "comp", "n", "regs", "block", "m.p", "m.q")
    near = stage(_blocks_of(dealt, kind, bands, buckets, threshold, False, shingle), "near")
    again = near.join(placed.drop("blocks"), ["band", "node"]).join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    return _blocks_of(again, kind, bands, buckets, threshold, True, shingle)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id integer, text): doc_id, n_shingles, component_id, kept.

    Null and word-less texts are empty sets, linked with nothing. Rows of one doc_id are one document. A null doc_id is
    linked with nothing, has no component and is kept. An empty table gives no rows; other columns are ignored.
    """
    buckets = bands * rows
    signs = stage(signatures(docs, shingle, bands, rows), "signatures")
    usable = signs.where("doc_id IS NOT NULL AND k1 IS NOT NULL")
    copies = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    classes = stage(
        usable.join(copies.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("node").alias("doc_id")), "doc_id")
        .where("k1 = x1 AND k2 = x2").dropDuplicates(["k1", "k2"])
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "regs", "bands"),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("nth", "band"))
    lowest = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    stars = stage(banded.join(lowest, "band").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    involved = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    involved = stage(involved, "involved")
    texts = likely(docs.select("doc_id", binary("text").alias("text")), involved, ["doc_id"])
    texts = stage(texts.join(involved, "doc_id", "left_semi").distinct(), "texts")
    nodes = classes.select("node", F.col("node").alias("comp")).distinct()

    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    nodes = _joined_up(nodes, _confirmed(_may_link(first, classes, buckets, threshold), texts, shingle, threshold))

    at = lambda c: nodes.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    apart = stars.join(at("a"), "a").join(at("b"), "b").where("comp_a != comp_b").select("a", "b")
    apart = apart.join(first, ["a", "b"], "left_anti")
    nodes = _joined_up(nodes, _confirmed(_may_link(apart, classes, buckets, threshold), texts, shingle, threshold))

    members = banded.join(lowest.select("band"), "band", "left_semi").join(nodes, "node").join(classes.select("node", "n", "regs"), "node")
    nodes = _joined_up(nodes, _across(members, texts, bands, buckets, threshold, shingle))

    of_class = copies.join(nodes, "node").select("k1", "k2", "comp")
    linked = signs.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
