"""Language filters, whitening and the Merkle manifest against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docpipe.llm import language_filters, merkle, whitening
from tests.conftest import SF

ROW = "doc_id long, lang string, source string, n_chars long, text string"


def brute_language(rows):
    """Known runs without any filter: sets instead of bits."""

    def runs(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        line = f" {' '.join(letters)} "
        return [line[k : k + 3] for k in range(len(line) - 2)] + [c for c in line if c != " "] if letters else []

    counts: dict = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            for r in runs(text):
                per = counts.setdefault(lang, ({}, {}))[len(r) == 1]
                per[r] = per.get(r, 0) + 1
    sets = {k: {r for per in v for r, c in per.items() if c >= 1e-4 * sum(per.values())} for k, v in counts.items()}
    order = sorted(sets, key=lambda k: (-sum(sum(p.values()) for p in counts[k]), k))
    out = {}
    for doc_id, text, _ in rows:
        own = runs(text or "")
        share = [sum(r in sets[k] for r in own) / len(own) for k in order] if own and order else []
        out[doc_id] = (order[int(np.argmax(share))], max(share)) if share else ("und", 0.0)
    return out


def test_language_matches_sets(spark):
    rng = random.Random(4)
    makers = {"aa": "bcdaeo", "bb": "xyzuio", "cc": "éßñaou"}
    rows = [
        (k, " ".join("".join(rng.choice(makers[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 80))) + "! 1", lang)
        for k, lang in enumerate(rng.choice(list(makers)) for _ in range(300))
    ]
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "1 2 …", "bb"), (303, "bade", None), (304, "\x00 bade \x00", "aa"), (305, "Bade" * 700_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("run", F.lit(1)).withColumn("n", F.lit("x"))
    want = brute_language(rows)
    got = {r.doc_id: r for r in language_filters.identify(docs).collect()}
    assert set(got) == set(want)
    for k, (lang, score) in want.items():
        assert got[k].lang_pred == lang and abs(got[k].score - score) < 0.15, (k, lang, score, got[k])
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_filters_hold_every_run_and_few_others():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 62, 40_000).astype(np.uint64)
    slices = np.zeros((language_filters.SLOTS, 2), np.uint64)  # 70 languages: two words a slot
    of = np.arange(20_000) % 70
    for k in range(70):
        for slots in language_filters._probes(keys[:20_000][of == k]):
            slices[slots, k // 64] |= np.uint64(1 << k % 64)
    met = language_filters.masks(keys, slices)
    inside = np.array([language_filters._bits(met[i : i + 1], of[i])[0] for i in range(20_000)])
    assert inside.all()
    assert np.mean([language_filters._bits(met[20_000:], k).mean() for k in range(70)]) < 0.01


def test_language_held_out_and_no_use_of_the_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_filters.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")))
    pick = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in language_filters.identify(d).collect())
    assert pick(docs) == pick(hidden.drop("source"))


def test_language_without_training(spark):
    docs = spark.createDataFrame([(None, "a text", "en"), (0, "a text", None), (0, None, "en")], "doc_id long, text string, lang string")
    assert all(r.lang_pred == "und" and r.score == 0 for r in language_filters.identify(docs).collect())
    assert language_filters.identify(docs.limit(0)).count() == 0


def brute_whitening(vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    order = [k for k in np.argsort(-e)[:components] if e[k] > 1e-12 * e.max()]
    return n, np.square((n * x - sums).astype(object)).sum(axis=1), c @ q[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("kind", ["scaled", "wide", "thin"])
def test_whitening_matches_eigenvectors(spark, kind):
    rng = np.random.default_rng(7)
    rows, dims = (300, 9) if kind != "wide" else (80, 40)
    vectors = rng.normal(size=(rows, dims)) * (np.geomspace(1, 50, dims) if kind != "wide" else np.linspace(1, 3, dims))
    if kind == "thin":
        vectors[:, 4] = 2.5  # no variance
    vectors = vectors.astype(np.float32)
    data = [(k, v.tolist()) for k, v in enumerate(vectors)]
    bad = [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("inf")] + [0.0] * (dims - 1)), (904, [1.0])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("component", F.lit("c"))
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = brute_whitening(vectors)
    k = white.shape[1]
    table = got["whitened"].to_numpy().reshape(rows, k)
    assert set(got["n"]) == {n} and got["component"].tolist() == list(range(1, k + 1)) * rows
    assert got["deviation"].to_numpy().reshape(rows, k)[:, 0].tolist() == deviation.tolist()
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * signs).max() < 1e-6
    assert np.allclose(got["explained"].to_numpy()[:k], explained, rtol=1e-9) and got["identity_error"].max() < 1e-9


def test_whitening_of_equal_deviations_ties_and_nothing(spark):
    cube = [(k, [float(k >> b & 1) for b in range(5)] + [0.25]) for k in range(32)] * 3 + [(None, [0.0] * 5 + [0.25])] * 32
    df = spark.createDataFrame(cube, "vec_id int, embedding array<float>")
    got = whitening.whiten(df).toPandas()
    assert len(got) == 128 * 5 and got["identity_error"].max() < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id int, embedding array<float>")).count() == 0


def test_bidiagonalisation_stops_early_only_when_nothing_is_missed():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 60)) @ np.diag([50, 50, 50, 20, 10, *[1e-3] * 55])
    steps = []

    def product(z):
        steps.append(1)
        t = x @ z
        return t @ t, x.T @ t

    sigma, axes = whitening.bidiagonalise(product, 60, float(np.square(x).sum()), 5)
    assert np.allclose(sigma[:5], np.linalg.svd(x)[1][:5], rtol=1e-12) and len(steps) <= 60
    assert np.allclose(axes[:5] @ axes[:5].T, np.eye(5), atol=1e-12)


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, add=0):
        n = None if r["n_chars"] is None else r["n_chars"] + add
        return _hash(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_hash(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for p, r in enumerate(groups[x]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            siblings, node = [], leaf(r, 1 if hit else 0)
            for levels, q in ((trees[x], p), (top, g)):
                for level in levels[:-1]:
                    run = level[q // 2 * 2 : q // 2 * 2 + 2]
                    siblings += [v for k, v in enumerate(run) if k != q % 2]
                    run[q % 2] = node
                    node, q = _hash(*run), q // 2
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], root, _hash(*siblings), node, node == root))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


def test_manifest_with_nulls_repeats_and_extreme_ids(spark):
    rng = random.Random(3)
    ids = [None, -5, -(2**63), 2**63 - 1, 0, 7, 63, 64, 65, 4096]
    rows = [
        (
            rng.choice(ids + [rng.randrange(-(10**6), 10**6) for _ in range(100)] + [rng.randrange(-(2**62), 2**62) for _ in range(40)]),
            rng.choice(["a", None, "ü", ""]), rng.choice(["en", None, "", "-", "="]), rng.choice([None, 1, 2**40]), rng.choice(["", "x", None, "日本"]),
        )
        for _ in range(1500)
    ] + [(1, "a", "en", 3, "same")] * 600
    docs = spark.createDataFrame(rows, ROW).withColumn("g", F.lit(1)).withColumn("pos", F.lit("p"))
    assert as_rows(merkle.manifest(docs)) == brute_manifest([dict(zip(ROW.replace(" long", "").replace(" string", "").split(", "), r)) for r in rows])


@pytest.mark.parametrize("count", [0, 1, 2, 257])
def test_manifest_of_one_group(spark, count):
    rows = [(3 * k, "en", "s", k, "t" * k) for k in range(count)]
    docs = spark.createDataFrame(rows, ROW)
    assert as_rows(merkle.manifest(docs)) == (brute_manifest([r.asDict() for r in docs.collect()]) if rows else [])


def test_manifest_of_many_groups(spark):
    rows = [(k, f"l{k % 300}", "s", 1, None) for k in range(900)]
    docs = spark.createDataFrame(rows, ROW)
    assert as_rows(merkle.manifest(docs)) == brute_manifest([r.asDict() for r in docs.collect()])


def test_fold_uses_exactly_the_siblings():
    nodes = [_hash(str(k)) for k in range(11)]
    levels = merkle._block(nodes, 11)
    for k in range(11):
        top, rest = merkle.fold(nodes[k], merkle._siblings(levels, k), k, 11)
        assert (top, rest) == (levels[-1][0], "")
    assert math.prod(len(x) for x in levels) == 11 * 6 * 3 * 2 * 1
