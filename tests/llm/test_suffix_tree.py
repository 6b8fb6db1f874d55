"""The suffix tree of whole texts against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from docpipe.llm import suffix_tree
from tests.llm.test_llm import ODD, documents, prose


def symbols(text: str | None) -> bytes:
    words = suffix_tree.lowered_words((text or "").encode())
    return b" " + b"".join(w.replace(b"\0", b"\1") + b" " for w in words) + b"\xff"


def brute_grams(texts) -> Counter:
    counts: Counter = Counter()
    for text in map(symbols, texts):
        for at in range(1, len(text)):
            counts[text[max(0, at - suffix_tree.DEPTH) : at + 1]] += 1
    return counts


def test_contexts_cross_words(spark):
    rng = random.Random(3)
    texts = [*ODD, "a b", "a\0b c", *(prose(rng, 80, 30) for _ in range(20))]
    rows = suffix_tree.grams(documents(spark, texts).selectExpr("coalesce(cast(text as binary), X'') as text")).collect()
    got = {(r.gram % 2**64).to_bytes(8, "big").lstrip(b"\0"): r.n for r in rows}
    assert got == brute_grams(texts) and got[b" a \x62"] >= 1


def test_model_gives_the_scores_of_the_tree(spark):
    rng = random.Random(4)
    texts = [*ODD, "x\0y", *(prose(rng, 120, 40) for _ in range(40))]
    scored = {r.doc_id: r.score for r in suffix_tree.score(documents(spark, texts)).collect()}
    rows = documents(spark, texts).selectExpr("doc_id", "coalesce(cast(text as binary), X'') as text")
    train = rows.where(suffix_tree.remainder("doc_id", 7) != 2)
    kept = [(r.context, r.symbol, r.n) for r in suffix_tree.states(train).select("context", "symbol", "n").collect()]
    tree = suffix_tree.Tree(kept)
    assert any(b" " in c[1:] for c in tree.next)  # a state that reaches over a word
    for i, text in enumerate(texts):
        assert math.isclose(scored[i], tree.sequence(symbols(text)[1:]), rel_tol=1e-9, abs_tol=1e-9)
    model = suffix_tree.Model(*(np.array(x) for x in zip(*kept)))
    ordered = texts[-1].split()
    assert abs(model.score([[w.encode() for w in ordered]])[0] - model.score([[w.encode() for w in sorted(ordered)]])[0]) > 0.01


def test_contexts_are_counted_level_by_level(spark):
    rng = random.Random(5)
    texts = [*ODD, "a\0b c", *(prose(rng, 90, 30) for _ in range(30))]
    rows = documents(spark, texts).selectExpr("coalesce(cast(text as binary), X'') as text")
    counts: Counter = Counter()
    for gram, n in brute_grams(texts).items():
        for d in range(len(gram)):
            counts[gram[len(gram) - d - 1 :]] += n
    total: Counter = Counter()
    for gram, n in counts.items():
        total[gram[:-1]] += n
    share = 0.002
    want = {g: (n, total[g[:-1]]) for g, n in counts.items() if total[g[:-1]] >= share * total[b""]}
    got = {r.context.to_bytes(7, "big").lstrip(b"\0") + bytes([r.symbol]): (r.n, r.total) for r in suffix_tree.frequent_contexts(rows, share).collect()}
    assert got == want and 0 < len(got) < len(counts)
    assert {len(g) - 1 for g in got} == set(range(8))


def test_contexts_with_a_rare_part_are_not_moved(spark):
    texts = ["abcd " * 50 + "xbcd yabc"]
    rows = documents(spark, texts).selectExpr("cast(text as binary) as text")
    key = lambda b: int.from_bytes(b, "big")
    known = np.array([key(c) for c in (b"abc", b"bcd")], np.uint64).byteswap()
    got = {(r.gram % 2**64).to_bytes(8, "big").lstrip(b"\0"): (r.n, r.total) for r in suffix_tree.grams(rows, range(4, 5), known).collect()}
    # of the contexts that end in a known part, b"xbcd" and b"yabc" lie over a rare one
    assert got == {b"abcd ": (50, 50)}


def test_model_of_many_bytes_gives_the_scores_of_the_tree(spark):
    rng = random.Random(6)
    letters = [chr(c) for c in (*range(0x21, 0x41), *range(0x5B, 0x7F), *range(0xC0, 0x250), *range(0x391, 0x450), *range(0x4E00, 0x9000, 97), *range(0x1F300, 0x1F400))]
    texts = ["".join(rng.choice([*letters, " ", " "]) for _ in range(400)) for _ in range(30)]
    rows = documents(spark, texts).selectExpr("cast(text as binary) as text")
    kept = [(r.context, r.symbol, r.n) for r in suffix_tree.states(rows, 0.0005).select("context", "symbol", "n").collect()]
    model, tree = suffix_tree.Model(*(np.array(x) for x in zip(*kept))), suffix_tree.Tree(kept)
    assert model.bits == 8
    asked = [*texts[:3], "plain words", "", "\x7f unseen"]
    for text, score in zip(asked, model.score([suffix_tree.lowered_words(t.encode()) for t in asked])):
        assert math.isclose(score, tree.sequence(symbols(text)[1:]), rel_tol=1e-9, abs_tol=1e-9)
