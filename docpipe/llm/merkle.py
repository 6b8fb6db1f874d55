"""Merkle manifest of a dataset: a hash per document, a tree per group, a tree over the groups, and a proof per document.

Places of leaves come from a bitmap-rank index, so leaves are never sorted. The ids of a group are gathered into 64-bit
words (``bit_or``, merged map-side before the shuffle; words without ids are not stored, which is the compression). A
directory of row counts stands above the words: nodes of ``FAN`` children each, as many levels as the ids span, with
sums of the earlier siblings. The place of a leaf is its word's start plus the set bits below its own.

Trees are then reduced by keyed slot arrays: ``SLOTS`` neighbouring nodes meet in one group by ``place / SLOTS`` and
give one node of the level eight above. Paths come down the same blocks. No group is larger than ``SLOTS`` or ``FAN``.

Defined results. A null in a hashed column counts as ``-``. A null group comes first, a null id first in its group. Rows
that repeat an id of their group stand in the order of their leaf hashes (equal rows one after another); only words that
hold such rows are ordered by a range partitioning. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.operators.ranks import positions

from .common import stage

SLOTS = 256  # nodes of one block; eight tree levels
_STEPS = 8
FAN_BITS = 8  # a directory node has 256 children
_NO_ID = -(1 << 57) - 1  # word of null ids, below every real word
TAMPERED_EVERY = 7

_NODE = "g string, pos bigint, n bigint, node binary"
_PATH = "g string, pos bigint, path binary, subroot binary, root binary, group_pos bigint, groups bigint"
_RESULT = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "leaf_index bigint, group_leaves bigint"
)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """Group key, id, leaf digest, and the digest with ``n_chars + 1`` where the row is to be tampered with."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    head = [F.col("doc_id"), F.col("source"), F.col("lang")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("g"),  # "-" sorts before "=", as null before all
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _digest(*head, F.col("n_chars"), F.col("text")).alias("leaf"),
        F.when(hit & F.col("n_chars").isNotNull(), _digest(*head, more, F.col("text"))).alias("tampered"),
    )


def _word() -> Column:
    return F.coalesce(F.shiftright("doc_id", 6), F.lit(_NO_ID)).alias("word")


def _bit() -> Column:
    return F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit")


def rank_index(rows: DataFrame) -> DataFrame:
    """Per group and word: its bitmap, its rows, the rows before it in the group, and the group's rows."""
    words = stage(
        rows.select("g", _word(), _bit())
        .groupBy("g", "word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bitmap"), F.count(F.lit(1)).alias("rows")),
        "merkle-words",
    )
    low, high = words.where(F.col("word") != _NO_ID).agg(F.min("word"), F.max("word")).first()
    levels, span = [words.select("g", F.col("word").alias("k"), "rows")], 0
    while low is not None and span < 64 and (low >> span) != (high >> span):
        levels.append(levels[-1].groupBy("g", F.shiftright("k", FAN_BITS).alias("k")).agg(F.sum("rows").alias("rows")))
        span += FAN_BITS

    def before(group: list) -> Column:
        earlier = Window.partitionBy(*group).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("rows").over(earlier), F.lit(0))

    # On top a group has its one node, the one of null ids, and the negative one at most.
    index = levels[-1].select("g", "k", before(["g"]).alias("start"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    for level in reversed(levels[:-1]):
        parent = F.shiftright("k", FAN_BITS)
        index = index.select("g", F.col("k").alias("parent"), F.col("start").alias("above"), "n")
        index = (
            level.select("g", "k", parent.alias("parent"), before(["g", parent]).alias("start"))
            .join(index, ["g", "parent"])
            .select("g", "k", (F.col("start") + F.col("above")).alias("start"), "n")
        )
    return stage(words.join(index.withColumnRenamed("k", "word"), ["g", "word"]), "merkle-index")


def placed(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Every leaf with its place in its group (``pos``) and the group's size (``n``)."""
    repeats = F.col("rows") > F.bit_count("bitmap")
    met = rows.select("*", _word(), _bit()).join(index, ["g", "word"])
    lower = F.expr("bit_count(bitmap & ~shiftleft(-1L, bit))")
    ranked = met.where(~repeats).select("g", (F.col("start") + lower).alias("pos"), "n", "doc_id", "leaf", "tampered")
    if index.where(repeats).isEmpty():
        return ranked
    same = ["g", "word", "start", "n", "doc_id", "leaf", "tampered"]
    copies = met.where(repeats).groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    each = copies.select(*same, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    ordered = positions(each, ["g", "word"], ["doc_id", "leaf", "copy"], "place")
    return ranked.unionByName(ordered.select("g", (F.col("start") + F.col("place")).alias("pos"), "n", "doc_id", "leaf", "tampered"))


def _parent(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _block(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of one block, lowest first; a group of ``n`` nodes needs no more of them than lead to one node."""
    levels = [nodes]
    for _ in range(min(_STEPS, (n - 1).bit_length())):
        last = levels[-1]
        levels.append([_parent(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def _by_place(table: pa.Table) -> dict[str, list]:
    return table.sort_by("pos").to_pydict()


def _reduce_block(table: pa.Table) -> pa.Table:
    rows = _by_place(table)
    n = rows["n"][0]
    node = _block([x.hex() for x in rows["node"]], n)[-1][0]
    return pa.table({
        "g": rows["g"][:1], "pos": pa.array([rows["pos"][0] // SLOTS], pa.int64()), "n": pa.array([-(-n // SLOTS)], pa.int64()),
        "node": pa.array([bytes.fromhex(node)], pa.binary()),
    })


def _siblings(levels: list[list[str]], slot: int) -> str:
    found = []
    for level in levels[:-1]:
        other = slot ^ 1
        if other < len(level):
            found.append(level[other])
        slot >>= 1
    return "".join(found)


def _descend_block(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of a block's nodes: their siblings here, then the path of the block."""
    rows, up = _by_place(nodes), above.to_pylist()[0]
    levels = _block([x.hex() for x in rows["node"]], rows["n"][0])
    count = len(rows["pos"])
    paths = [bytes.fromhex(_siblings(levels, p % SLOTS)) + up["path"] for p in rows["pos"]]
    fixed = {k: pa.array([up[k]] * count, above.schema.field(k).type) for k in ("subroot", "root", "group_pos", "groups")}
    return pa.table({"g": rows["g"], "pos": pa.array(rows["pos"], pa.int64()), "path": pa.array(paths, pa.binary()), **fixed})


def fold(leaf: str, siblings: str, pos: int, n: int) -> tuple[str, str]:
    """The root of a tree of ``n`` leaves from one leaf, and the siblings (64 letters each) that were not used."""
    while n > 1:
        if pos % 2 or pos + 1 < n:
            other, siblings = siblings[:64], siblings[64:]
            leaf = _parent(other, leaf) if pos % 2 else _parent(leaf, other)
        else:
            leaf = _parent(leaf)
        pos, n = pos // 2, -(-n // 2)
    return leaf, siblings


def _prove_block(nodes: pa.Table, above: pa.Table) -> pa.Table:
    rows, up = _by_place(nodes), above.to_pylist()[0]
    leaves_, n = [x.hex() for x in rows["leaf"]], rows["n"][0]
    levels = _block(leaves_, n)
    tail, root, subroot = up["path"].hex(), up["root"].hex(), up["subroot"].hex()
    proofs, folded = [], []
    for pos, leaf, other in zip(rows["pos"], leaves_, rows["tampered"], strict=True):
        path = _siblings(levels, pos % SLOTS) + tail
        proofs.append(hashlib.sha256(path.encode()).hexdigest())
        top, rest = fold(leaf if other is None else other.hex(), path, pos, n)
        folded.append(fold(top, rest, up["group_pos"], up["groups"])[0])
    count = len(leaves_)
    return pa.table({
        "doc_id": pa.array(rows["doc_id"], pa.int64()), "leaf": leaves_, "subroot": [subroot] * count, "root": [root] * count,
        "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded],
        "leaf_index": pa.array(rows["pos"], pa.int64()), "group_leaves": pa.array(rows["n"], pa.int64()),
    })


def _block_of() -> Column:
    return F.expr(f"pos div {SLOTS}").alias("block")


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The stored levels from ``nodes`` (``g, pos, n, node``) up to one node a group, eight tree levels apart."""
    levels = [nodes]
    while True:
        levels.append(stage(levels[-1].groupBy("g", _block_of()).applyInArrow(_reduce_block, _NODE), "merkle-level"))
        if most <= SLOTS:
            return levels
        most = -(-most // SLOTS)


def _meet(nodes: DataFrame, paths: DataFrame, function, schema: str) -> DataFrame:
    left = nodes.groupBy("g", _block_of())
    return left.cogroup(paths.groupBy("g", F.col("pos").alias("block"))).applyInArrow(function, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, group root, root and proof of every row, and the root folded from a tampered leaf (one row in seven).

    Columns read: doc_id (integer), source, lang, n_chars, text. See the module for nulls, repeats and empty tables.
    """
    spark = docs.sparkSession
    rows = stage(leaves(docs), "merkle-leaves")
    index = rank_index(rows)
    most = index.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], _RESULT)
    base = stage(placed(rows, index), "merkle-placed")
    levels = _climb(base.select("g", "pos", "n", F.col("leaf").alias("node")), most)
    subroots = levels[-1].select("g", F.col("node").alias("subroot"))

    groups = subroots.count()
    ranked = stage(positions(subroots, [], ["g"], "pos"), "merkle-groups")
    whole = ranked.select(F.lit("").alias("g"), "pos", F.lit(groups).cast("bigint").alias("n"), F.col("subroot").alias("node"))
    tops = _climb(whole, groups)
    paths = tops[-1].select(
        "g", "pos", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"),
        F.lit(0).cast("bigint").alias("group_pos"), F.lit(groups).cast("bigint").alias("groups"),
    )
    for level in reversed(tops[:-1]):
        paths = _meet(level, paths, _descend_block, _PATH)
    paths = (
        paths.drop("g", "subroot").join(ranked, "pos")
        .select("g", F.lit(0).cast("bigint").alias("pos"), "path", "subroot", "root", F.col("pos").alias("group_pos"), "groups")
    )
    for level in reversed(levels[1:-1]):
        paths = _meet(level, paths, _descend_block, _PATH)
    return _meet(base, paths, _prove_block, _RESULT)
