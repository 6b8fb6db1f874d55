"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

1. Training texts become word arrays, stored once (the forward lists of the index).
2. Their postings (term, row, position) are stored once, for the terms of the benchmark's windows.
3. Every window is ordered from its rarest term. The lists of its ``RARE`` rarest terms are moved back by the terms' places
   in the window and intersected, in cells of ``2 * SLOP`` words.
4. Only for the cells that are left, the lists of the other terms are looked up and moved as well. A window stands where
   all its moved postings have one start (exact phrase), or lie in one cell (proximity: every word within about ``SLOP``
   words of its place, in any order). A window with a term that no text has can stand nowhere.

The benchmark is the query set. Its terms and windows are broadcast in blocks of at most ``BLOCK_WINDOWS`` windows of
``WINDOW`` words (some 2 KB each, 40 MB a block); more windows mean more passes, never a cut list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely, small, stage

WINDOW = 13
RARE = 3  # terms of a window whose lists are intersected before the others are looked up
SLOP = 5
WINDOW_TERMS = 1 << 30  # all the terms that a window has
BLOCK_WINDOWS = 20_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of ``text`` with A-Z lower-cased; none for null.

    Whole texts in ASCII take the fast ``lower``; others only have A-Z changed, as ``lower`` would change É too.
    """
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def forward_lists(docs: DataFrame, id_column: str = "doc_id", label: str = "words") -> DataFrame:
    """(row, id, words): one stored row per row of ``docs``; ``row`` is unique even where ids repeat."""
    words = docs.select(F.col(id_column).alias("id"), words_of(F.col("text")).alias("words"))
    return stage(words.withColumn("row", F.monotonically_increasing_id()), label)


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, words, items): distinct windows of ``window`` words, and the ids of the items they stand in.

    An item of fewer words is one window; one of none has no window.
    """
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    grouped = each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stage(grouped.withColumn("win", F.monotonically_increasing_id()), "windows")


def _blocks(rows: DataFrame, name: str, block: int) -> list[DataFrame]:
    """The rows in parts of about ``block`` values of ``name``, each small enough to broadcast."""
    parts = -(-rows.select(name).distinct().count() // block)
    return [rows.where(F.pmod(F.xxhash64(name), F.lit(parts)) == k) for k in range(parts)]


def _united(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return empty if out is None else out


def vocabulary(windows: DataFrame) -> DataFrame:
    """(term, term_id): the distinct words of the windows."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    return stage(terms.withColumn("term_id", F.monotonically_increasing_id()), "terms")


def store_postings(texts: DataFrame, terms: DataFrame, block: int = BLOCK_WINDOWS * WINDOW) -> DataFrame:
    """(term_id, row, pos): the stored places of the terms in the training texts."""
    tokens = texts.select("row", F.posexplode("words").alias("pos", "term"))
    found = [tokens.join(F.broadcast(part), "term").select("term_id", "row", "pos") for part in _blocks(terms, "term_id", block)]
    return stage(_united(found, tokens.limit(0).selectExpr("0L term_id", "row", "pos")), "postings")


def query_plans(windows: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(win, length, terms): each window's (n, offset, term_id) from the rarest on, ties by offset.

    A window with a term that no text has is left out: it occurs nowhere.
    """
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    spread = windows.select("win", F.posexplode("words").alias("offset", "term")).join(terms, "term").join(counts, "term_id", "left")
    each = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term_id")
    listed = spread.groupBy("win").agg(F.sort_array(F.collect_list(each)).alias("terms"))  # at most WINDOW of them
    return stage(listed.where(F.col("terms")[0]["n"] > 0).select("win", F.size("terms").alias("length"), "terms"), "plans")


def _cells(start: Column, slop: int) -> Column:
    """The two overlapping cells of ``2 * slop`` words that a start lies in."""
    even = F.floor(start / (2 * slop)) * 2
    return F.array(even, F.floor((start + slop) / (2 * slop)) * 2 + 1)


def _all_there(places: DataFrame, wanted: str, window: int) -> DataFrame:
    """Groups of the columns but ``offset`` in which ``wanted`` different offsets below ``window`` stand.

    Offsets are bits of longs, joined before rows move: one shuffle, and repeated offsets cost nothing.
    """
    keys = [c for c in places.columns if c != "offset"]
    bits = [F.bit_or(F.expr(f"CASE WHEN offset DIV 64 = {k} THEN shiftleft(1L, offset % 64) ELSE 0L END")).alias(f"bits_{k}") for k in range(-(-window // 64))]
    n = " + ".join(f"bit_count(bits_{k})" for k in range(len(bits)))
    return places.groupBy(*keys).agg(*bits).where(f"{n} = {wanted}").select(*keys)


def rarest_lists(postings: DataFrame, plans: DataFrame, rare: int = RARE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """(row, win, offset, start, parts): the moved lists of the ``rare`` rarest terms of each window."""
    each = plans.select("win", F.least(F.lit(rare), "length").alias("parts"), F.explode(F.slice("terms", 1, rare)).alias("t"))
    each = each.select("win", "parts", "t.term_id", "t.offset")
    found = [
        postings.join(F.broadcast(part), "term_id").select("row", "win", "offset", (F.col("pos") - F.col("offset")).alias("start"), "parts")
        for part in _blocks(each, "win", block)
    ]
    return _united(found, postings.limit(0).selectExpr("row", "0L win", "0 offset", "pos start", "0 parts"))


def moved_lists(postings: DataFrame, plans: DataFrame, rare: int = RARE, slop: int = SLOP, block: int = BLOCK_WINDOWS, window: int = WINDOW) -> DataFrame:
    """(row, win, length, offset, start): all moved postings in cells where a window's rarest terms meet."""
    lists = stage(rarest_lists(postings, plans, rare, block), "lists")
    celled = lists.select("row", "win", "parts", "offset", F.explode(_cells(F.col("start"), slop)).alias("cell"))
    met = stage(_all_there(celled, "parts", window).select("row", "win", "cell"), "cells")
    asked = []
    for part in _blocks(plans, "win", block):
        others = part.select("win", F.explode(F.slice("terms", rare + 1, WINDOW_TERMS)).alias("t")).select("win", "t.term_id", "t.offset")
        asked.append(met.join(F.broadcast(others), "win"))
    asked = _united(asked, met.limit(0).selectExpr("win", "row", "cell", "0L term_id", "0 offset"))
    start = F.col("pos") - F.col("offset")
    there = likely(postings, asked, ["row", "term_id"]).join(asked, ["row", "term_id"])
    others = there.where(F.array_contains(_cells(start, slop), F.col("cell"))).select("row", "win", "offset", start.alias("start")).distinct()
    own = lists.join(met.select("row", "win").distinct(), ["row", "win"], "left_semi").select("row", "win", "offset", "start")
    lengths = plans.select("win", "length")
    return stage(own.unionByName(others).join(small(lengths), "win"), "moved")


def phrase_matches(moved: DataFrame) -> DataFrame:
    """(row, win, start, length): starts that the moved lists of all terms have in common."""
    met = moved.where("start >= 0").groupBy("row", "win", "start", "length").agg(F.count("*").alias("n"))
    return met.where("n = length").select("row", "win", "start", "length")


def proximity_matches(moved: DataFrame, slop: int = SLOP, window: int = WINDOW) -> DataFrame:
    """(row, win): windows with a moved posting of every term in one cell. Exact matches are among them."""
    celled = moved.select("row", "win", "length", "offset", F.explode(_cells(F.col("start"), slop)).alias("cell"))
    return _all_there(celled, "length", window).select("row", "win").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near: one row per row of ``docs``.

    A word is hit if it lies in any occurrence of a benchmark window; ``n_near`` counts the items with a window whose words
    stand there exactly or in proximity. Null and empty texts have no words, no hit, and the
    SHA-256 of nothing. Repeated ids are separate rows. Items without words match nothing; a null item id is left out.
    An empty benchmark contaminates nothing. Other columns are ignored.
    """
    texts = forward_lists(docs)
    windows = windows_of(benchmark.where("item_id IS NOT NULL"), window)
    terms = vocabulary(windows)
    postings = store_postings(texts, terms)
    moved = moved_lists(postings, query_plans(windows, terms, postings), window=window)
    matches = stage(phrase_matches(moved), "matches")
    near = proximity_matches(moved, window=window).join(windows.select("win", "items"), "win").select("row", F.explode("items").alias("item")).distinct()
    near = near.groupBy("row").agg(F.count("*").alias("n_near"))
    covered = matches.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = matches.select("row", "win").distinct().join(windows.select("win", "items"), "win").select("row", F.explode("items").alias("item")).distinct()
    listed = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = near.join(covered.join(listed, "row"), "row", "left")  # an exact match is a near one
    hit, words = F.coalesce("n_hit", F.lit(0)), F.size("words").cast("long")
    return texts.select("row", F.col("id").alias("doc_id"), words.alias("n_words")).join(marks, "row", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
