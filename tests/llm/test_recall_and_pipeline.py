"""Recall of near-equal passages against all pairs by brute force; the pipeline on empty, null and clashing tables."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from docpipe.llm import compact_windows, phrase_index
from pyspark.sql import functions as F
from tests.conftest import SF


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_recall_of_near_equal_passages(spark):
    rng = random.Random(3)
    vocabulary, weights = [f"w{k}" for k in range(3000)], [1 / (k + 5) for k in range(3000)]
    prose = lambda n: rng.choices(vocabulary, weights, k=n)
    texts, planted = [], []
    for k in range(100):
        first = prose(rng.randint(60, 160))
        second = list(first)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(second))
            second[at : at + 1] = rng.choice([[f"x{rng.randrange(10**6)}"], [second[at], f"y{rng.randrange(10**6)}"], []])
        before = prose(rng.randint(20, 200)), prose(rng.randint(20, 200))
        texts += [before[0] + first + prose(60), before[1] + second + prose(60)]
        a, b = shingles(first), shingles(second)
        if len(a & b) >= 0.8 * len(a | b) and min(len(first), len(second)) >= 50:
            planted.append((2 * k, 2 * k + 1, len(before[1]), len(before[1]) + len(second)))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in compact_windows.near_duplicate_passages(df).collect():
        found.setdefault((r.first_doc_id, r.doc_id), []).append((r.start_word, r.end_word))
    caught = sum(any(min(e, end) - max(s, start) >= 0.8 * (end - start) for s, e in found.get((a, b), [])) for a, b, start, end in planted)
    assert len(planted) > 60 and caught >= 0.95 * len(planted)
    assert all(a // 2 == b // 2 for a, b in found)  # nothing else repeats


def test_variants_of_one_passage_are_linked_to_each_other(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    first = prose(100)
    variants = [first] + [[*first[:k], "new", *first[k + 1 :]] for k in (20, 50, 80)]
    kinds = [0, 1, 2, 3, 0, 2, 2]  # the last three are copies of passages in documents 0 and 2
    texts = [prose(70) + variants[k] + prose(70) for k in kinds]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = compact_windows.near_duplicate_passages(df).collect()
    pairs = {(r.first_doc_id, r.doc_id) for r in rows}
    assert {(a, b) for b in range(4) for a in range(b)} <= pairs and {(0, 4), (2, 5), (2, 6)} <= pairs
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 for r in rows)
    assert (1, 4) not in pairs and (5, 6) not in pairs  # copies stand with the passage that they repeat


def test_classes_join_variants_by_few_rows(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    first, other = prose(120), prose(60)
    changed = lambda k: [*first[:k], f"new{k}", *first[k + 1 :]]
    texts = [prose(70) + changed(3 * k) + prose(70) for k in range(40)] + [prose(60) + other + prose(60) for _ in range(2)]
    # Centres of a third passage stand in an earlier text that has 30 words of it; two later ones repeat each other.
    third = prose(60)
    texts += [prose(80) + third[15:45] + prose(80), *(prose(80) + third + prose(70) for _ in range(2)), texts[7]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = compact_windows.near_duplicate_passages(df, classes=True).collect()
    assert len(rows) < 4 * 40  # not a row for every two variants: 780
    of = {}
    for r in rows:
        assert r.similarity >= 0.8 and min(r.end_word - r.start_word, r.first_end - r.first_start) >= 50 and r.first_doc_id < r.doc_id
        for doc in (r.doc_id, r.first_doc_id):
            of.setdefault(doc, set()).add((r.class_doc, r.class_start, r.class_end))
    copy = of.pop(45)
    assert copy == {(7, 0, len(texts[7]))} and copy < of[7]
    of[7] -= copy
    assert set(of) == {*range(42), 43, 44} and all(len(c) == 1 for c in of.values())
    assert [len({next(iter(of[d])) for d in docs}) for docs in (range(40), (40, 41), (43, 44))] == [1, 1, 1] and len(set().union(*of.values())) == 3
    assert {c[0] for c in set().union(*of.values())} == {0, 40, 43}
    empty = compact_windows.near_duplicate_passages(df.limit(0), classes=True)
    assert empty.count() == 0 and empty.columns[-3:] == ["class_doc", "class_start", "class_end"]


def test_all_links_lie_in_one_class(spark):
    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [prose(90) for _ in range(5)]
    line = prose(12)

    def varied(words):
        words = list(words)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return words

    texts = [sum((prose(rng.randrange(40)) + line + varied(p) for p in rng.sample(passages, 2)), []) + prose(30) for _ in range(40)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sides = {}
    for r in compact_windows.near_duplicate_passages(df, classes=True).collect():
        for doc, start, end in ((r.doc_id, r.start_word, r.end_word), (r.first_doc_id, r.first_start, r.first_end)):
            sides.setdefault(doc, []).append((start, end, (r.class_doc, r.class_start)))
    of = lambda doc, start, end: {c for s, e, c in sides.get(doc, ()) if min(e, end) - max(s, start) >= 50}
    links = compact_windows.near_duplicate_passages(df).collect()
    assert len(links) > 100 and all(of(r.doc_id, r.start_word, r.end_word) & of(r.first_doc_id, r.first_start, r.first_end) for r in links)


def test_dense_is_never_false_for_passages_alike():
    rng = np.random.default_rng(7)
    met = 0
    for _ in range(3000):
        a = rng.permutation(10**4)[:100].astype(np.uint32)
        b = np.concatenate([rng.integers(10**6, 2 * 10**6, rng.integers(0, 20)), a[rng.integers(0, 30) :]]).astype(np.uint32)
        new = rng.random(len(b)) < rng.choice([0, 0.1, 0.15, 0.2, 0.25])
        b[new] = 3 * 10**6 + np.flatnonzero(new)
        b = b[np.sort(np.unique(b, return_index=True)[1])]
        x, y = ({h: k for k, h in enumerate(z.tolist())} for z in (a, b))
        shared = sorted((x[h], y[h]) for h in x.keys() & y.keys())
        found = compact_windows.alike(a, b, 50, 5, 0.8)
        assert found == compact_windows.alike(a, b, 50, 5, 0.8, shared)
        fits = compact_windows.dense([i for i, _ in shared], 46, 1.6 / 1.8) or compact_windows.dense(sorted(j for _, j in shared), 46, 1.6 / 1.8)
        assert fits or not found
        met += bool(found)
    assert 300 < met < 2900


def test_many_places_meet_just_where_they_may_be_alike():
    rng = np.random.default_rng(8)
    line = rng.integers(0, 10**6, 24)  # all places have it, and most have nothing else in common
    places = []
    for k in range(90):
        before, after = rng.integers(0, 10**6, (2, 45))
        if k % 9 == 1:  # a variant of the one before
            new = rng.random(114) < rng.choice([0.02, 0.1, 0.2])
            places.append(np.where(new, rng.integers(0, 10**6, 114), places[-1]))
        elif k % 9 == 4:  # repeats in one place, also in one that is longer than the matrix
            places.append(np.concatenate([np.tile(rng.integers(0, 10**6, 12), 4 if k % 2 else 60), line, after]))
            places.append(np.concatenate([places[-1][6:], before]))
        else:
            places.append(np.concatenate([before, line, after]))
    places = [x.astype(np.uint32) for x in places]
    label = np.arange(len(places)) // 30
    met = {(k, n) for k, others in compact_windows.meeting(places, [label], 46, 0.8) for n in others}
    pairs = [(k, n) for k in range(len(places)) for n in range(k) if label[k] != label[n]]
    assert met <= set(pairs)
    met = {(k, n) for k, others in compact_windows.meeting(places, [], 46, 0.8) for n in others}
    alike = {(k, n) for k in range(len(places)) for n in range(k) if compact_windows.alike(places[k], places[n], 50, 5, 0.8)}
    assert len(alike) > 10 and alike <= met
    short = lambda rows: sum(len(places[k]) <= compact_windows.LONG and len(places[n]) <= compact_windows.LONG for k, n in rows)
    assert short(met) < 3 * short(alike)


def test_windows_of_several_texts_at_once():
    rng = np.random.default_rng(9)
    texts = [compact_windows.mixed(rng.integers(1, rng.choice([4, 10**6]), n).astype(np.uint64)) for n in (46, 300, 45, 47, 1, 120)]
    begins = np.cumsum([0, *[len(x) + 1 for x in texts]])
    joined = np.concatenate([x for text in texts for x in (text, np.zeros(1, np.uint64))])
    alone = [compact_windows.compact_windows(x, 46) + b for x, b in zip(texts, begins)]
    assert (compact_windows.compact_windows(joined, 46, begins[1:] - 1) == np.concatenate(alone)).all()


def test_centres_that_repeat_within_a_grid_on_both_sides():
    # Windows of two functions with one true offset; one side's centre was taken from an earlier place, on both sides apart.
    windows = [(0, 60, 0, 5, 0, 105 - 60, 160), (0, 60, 1, 5, 0, 105 + 60, 220)]
    assert compact_windows.clusters(windows, 2) == [(0, 60, 0, 220)]


def test_offsets_of_a_cell_are_counted_in_one_shuffle(spark):
    rows = [(1, 3, k) for k in (0, 63, 64, 64)] + [(2, 3, k) for k in (0, 5, 5)] + [(3, 1, 129)]
    met = phrase_index._all_there(spark.createDataFrame(rows, "win long, parts int, offset int"), "parts", 130)
    assert sorted(r.win for r in met.collect()) == [1, 3]
    assert met._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # combined before one shuffle, and after it


def run_stages(spark, docs, folder):
    out = []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        made = function(spark, docs, SF)
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [d.count() for d in run_stages(spark, docs, str(tmp_path))] == [0] * 5


def test_pipeline_with_nulls_and_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.unionByName(docs.limit(3)).withColumns({
        "doc_id": F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")), "lang": F.when(F.col("doc_id") % 3 != 0, F.col("lang")),
        "source": F.when(F.col("doc_id") % 4 != 0, F.col("source")), "text": F.when(F.col("doc_id") % 11 != 0, F.col("text")),
        "row_key": F.lit(1), "verdict": F.lit("v"), "words": F.lit("w"),
    })
    rows.write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    stages = run_stages(spark, rows, str(tmp_path / "out"))
    assert all(s.columns == rows.columns for s in stages[:-1])
    counts = [rows.count(), *[s.count() for s in stages[:-1]]]
    assert all(a >= b for a, b in zip(counts, counts[1:])) and counts[3] == counts[4] > 0  # secrets are replaced, nothing goes
    assert stages[0].where("text IS NULL").count() == 0  # a null text has no words
    assert stages[1].where("doc_id IS NULL").count() > 0  # rows without an id are judged as any other
    pieces = stages[-1]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert pieces.where("piece = 0").count() == counts[4]


def test_workers_take_few_rows_of_a_batch_at_a_time():
    import pyarrow as pa

    from docpipe.llm.common import slices

    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (1203, 0, 500)]
    parts = list(slices(batches))
    assert [p.num_rows for p in parts] == [500, 500, 203, 500]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(1203), *range(500)]
