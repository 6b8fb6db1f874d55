"""Set operators against brute force on small skewed fixtures."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from docpipe.operators import contracts, duplicates, matching, quality, ranks, skew, status
from docpipe.plans import silver as silver_plan

AS_OF = dt.date(2020, 6, 30)


SCHEMA = "run_id string, document_id string, source_s3_key string, document_fingerprint string, business_key string, seq long"


def make(rng, n, start, runs):
    rows = []
    for i in range(start, start + n):
        hot = rng.random() < 0.35  # one key holds a third of all rows
        key = None if rng.random() < 0.2 else ("hot" if hot else f"k{rng.randint(0, n)}")
        print_ = "hotprint" if rng.random() < 0.33 else f"f{rng.randint(0, n)}"
        rows.append((rng.choice(runs), f"d{i % (n // 2)}", f"s{i % (n // 2)}", print_, key, i))
    return rows


def marks(df):
    return {r.seq: (r.duplicate_strategy, r.duplicate_of_document_id, r.duplicate_confidence) for r in df.collect()}


def check_marks(history, current, got):
    """What marks mean, key by key: the first holder is free, all others are marked and point at the first."""
    again = {r[:3] for r in current}
    before = [r for r in history if r[:3] not in again]
    for at, name in ((3, "exact_fingerprint"), (4, "business_key")):
        first = {}
        for r in [*before, *current]:
            if r[at] and r[at] not in first:
                first[r[at]] = r
        for r in current:
            strategy, target, confidence = got[r[5]]
            leads = not r[at] or first[r[at]] is r
            if strategy == name:
                assert not leads and target == first[r[at]][1]
                assert confidence == {"exact_fingerprint": 1.0, "business_key": 0.85}[name]
            elif not leads:  # only the stronger reason may stand before this one
                assert name == "business_key" and strategy == "exact_fingerprint"
            elif strategy == "none":
                assert target is None and confidence == 0.0


def test_duplicates_against_history(spark):
    for seed in range(3):
        rng = random.Random(seed)
        history, current = make(rng, 3000, 0, ["r1", "r2", None]), make(rng, 1500, 10_000, ["r2", "r3", None])
        h, c = spark.createDataFrame(history, SCHEMA), spark.createDataFrame(current, SCHEMA)
        got = marks(duplicates.mark_against_history(c, h, ["seq"]))
        assert len(got) == len(current)
        check_marks(history, current, got)
        assert {s for s, _, _ in got.values()} == {"exact_fingerprint", "business_key", "none"}


def test_duplicates_within_one_table(spark):
    rng = random.Random(9)
    rows = make(rng, 4000, 0, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    check_marks([], rows, marks(duplicates.mark_duplicates(df, ["seq"])))


def test_equal_records_keep_one(spark):
    rows = [("r", "d", "s", "f", "k", 1)] * 5 + [("r", "e", "t", "g", None, 2)]
    marked = duplicates.mark_duplicates(spark.createDataFrame(rows, SCHEMA), ["run_id", "source_s3_key", "document_id"]).collect()
    assert sum(not r.is_duplicate for r in marked if r.document_id == "d") == 1
    assert not any(r.is_duplicate for r in marked if r.document_id == "e")


def test_join_unique_with_hot_and_null_keys(spark):
    left = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 900}") for i in range(9000)]
    right = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 900, 2)]
    l, r = spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(right, "key string, v long")
    got = {x.id: x.v for x in skew.join_unique(l, r, "key", ["id"]).collect()}
    table = dict(right)
    assert got == {i: table.get(k) for i, k in left}


def test_hot_keys_spread_over_partitions(spark):
    """With broadcasts off, rows of a key that fills the table still reach several partitions."""
    left = spark.range(20_000).select("id", F.lit("hot").alias("key"))
    right = spark.createDataFrame([("hot", 1), ("x", 2)], "key string, v long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [
            r["count"] for r in skew.join_unique(left, right, "key", ["id"]).groupBy(F.spark_partition_id()).count().collect()
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_positions_and_names(spark):
    rows = [("same.tif", f"p{i:05d}/same.tif") for i in range(2000)] + [(f"n{i}.pdf", f"q/n{i}.pdf") for i in range(500)]
    df = spark.createDataFrame(rows, "file_name string, path string").repartition(7)
    got = {r.path: r.target_name for r in ranks.collision_free_names(df).collect()}
    assert got["p00000/same.tif"] == "same.tif" and got["p01999/same.tif"] == "same_1999.tif"
    assert len(set(got.values())) == len(rows)


def test_nearest_rank(spark):
    rng = random.Random(5)
    rows = [("g1", 0.5 if rng.random() < 0.4 else rng.random() * 100) for _ in range(3000)]
    rows += [("g2", rng.random()) for _ in range(38)] + [("g3", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranks.nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95}, ["g"]).collect()}
    for g in ("g1", "g2", "g3"):
        ordered = sorted(v for k, v in rows if k == g)
        n = len(ordered)
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            assert got[g][name] == ordered[min(n - 1, round(q * (n - 1)))]
        assert got[g]["max"] == ordered[-1] and got[g]["n"] == n


GOOD = {
    "run_id": "r", "document_id": "d", "source_s3_key": "k", "source_file_name": "f", "extraction_engine": "e", "created_at": "c",
    "vendor_name": "Acme", "document_date": "2020-05-05", "total_amount": 5.5, "currency": "USD", "document_type": "invoice",
    "processing_status": "normalized", "rejection_reason": None, "quality_flags": [],
}
#: What differs from a good document -> processing status, quality status, score, flags, reason.
DECISIONS = [
    ({}, ("accepted", "accepted", 1.0, [], None)),
    ({"document_date": "2020-06-30"}, ("accepted", "accepted", 1.0, [], None)),
    ({"document_date": None}, ("accepted", "warning", 0.9, ["missing_document_date"], None)),
    ({"document_date": "2020-07-01"}, ("rejected", "rejected", 0.4, ["invalid_document_date"], "document_date_out_of_allowed_range")),
    ({"document_date": "1969-12-31"}, ("rejected", "rejected", 0.4, ["invalid_document_date"], "document_date_out_of_allowed_range")),
    ({"total_amount": None}, ("accepted", "warning", 0.9, ["missing_total_amount"], None)),
    ({"total_amount": 0.0}, ("accepted", "accepted", 1.0, [], None)),
    ({"total_amount": 1_000_000.0}, ("accepted", "accepted", 1.0, [], None)),
    ({"total_amount": -0.01}, ("rejected", "rejected", 0.4, ["amount_outlier"], "total_amount_exceeds_allowed_threshold")),
    ({"total_amount": 1_000_000.01}, ("rejected", "rejected", 0.4, ["amount_outlier"], "total_amount_exceeds_allowed_threshold")),
    ({"currency": None}, ("accepted", "warning", 0.9, ["currency_missing"], None)),
    ({"currency": "GBP"}, ("rejected", "rejected", 0.4, ["invalid_currency"], "currency_not_allowed")),
    ({"vendor_name": None}, ("accepted", "warning", 0.9, ["vendor_missing"], None)),
    ({"vendor_name": "X"}, ("accepted", "warning", 0.9, ["vendor_too_short"], None)),
    ({"vendor_name": " 12345 "}, ("rejected", "rejected", 0.4, ["invalid_vendor"], "vendor_name_not_usable")),
    ({"document_type": None}, ("accepted", "warning", 0.9, ["unknown_document_type"], None)),
    ({"document_type": "memo"}, ("rejected", "rejected", 0.4, ["invalid_document_type"], "invalid_document_type")),
    ({"quality_flags": ["note"]}, ("accepted", "warning", 0.9, ["note"], None)),
    ({"run_id": None}, ("rejected", "rejected", 0.4, ["missing_run_id"], "missing_required_fields")),
    ({"document_date": None, "total_amount": None}, ("accepted", "warning", 0.8, ["missing_document_date", "missing_total_amount"], None)),
]


def test_quality_decisions(spark):
    names = list(GOOD)
    rows = [tuple((GOOD | change | {"document_id": str(i)})[n] for n in names) for i, (change, _) in enumerate(DECISIONS)]
    schema = ", ".join(f"{n} {'double' if n == 'total_amount' else 'array<string>' if n == 'quality_flags' else 'string'}" for n in names)
    got = {r.document_id: r for r in quality.apply_quality_rules(spark.createDataFrame(rows, schema), AS_OF).collect()}
    for i, (change, want) in enumerate(DECISIONS):
        r = got[str(i)]
        assert (r.processing_status, r.quality_status, round(r.quality_score, 6), r.quality_flags, r.rejection_reason) == want, change


def test_one_outcome_per_input(spark):
    from tests.conftest import SF
    from workload import inputs

    made = inputs.silver(spark, SF)
    counts = made.groupBy("outcome").count().collect()
    assert {r.outcome for r in counts} == {"valid", "rejected", "failed"}
    assert sum(r["count"] for r in counts) == inputs.table(spark, SF, "orders").count()
    assert made.select("run_id", "document_id").distinct().count() == made.count()


def test_enrichment_prefer_existing(spark):
    base = "run_id string, document_id string, document_type string, vendor_name string, document_date string, total_amount string, currency string, quality_flags array<string>"
    rows = [("r", "d", "unknown", "Kept", None, None, None, [])]
    candidates = spark.createDataFrame(rows, base).withColumns(
        {c: F.lit(None).cast("double") for c in ("document_type_confidence", "vendor_confidence", "document_date_confidence",
                                                 "total_amount_confidence", "currency_confidence")}
    )
    response = '{"vendor_name": null, "currency": "USD", "confidence_summary": {"vendor_name": 0.5}}'
    answers = spark.createDataFrame([("r", "d", response)], "run_id string, document_id string, enrichment string")
    erased = matching.merge_enrichment(candidates, answers).first()
    kept = matching.merge_enrichment(candidates, answers, prefer_existing=True).first()
    assert (erased.vendor_name, erased.currency, erased.enrichment_completed_fields) == (None, "USD", ["currency"])
    assert erased.vendor_confidence == 0.5
    assert kept.vendor_name == "Kept"
    off = matching.merge_enrichment(candidates, answers, enabled=False).first()
    assert (off.enrichment_invoked, off.currency, off.quality_flags) == (False, None, [])


def test_forward_status_ignores_order_and_replays(spark):
    rows = [("a", "Uploaded", 1), ("a", "Consolidating", 2), ("a", "Processing", 3), ("a", "Completed", 4), ("a", "Uploaded", 5),
            ("b", "Processing", 2), ("b", "Uploaded", 3), ("c", "Failed", 1), ("c", "Processing", 2)]
    df = spark.createDataFrame(rows + rows[::-1], "invoice_id string, status string, at int")
    got = {r.invoice_id: r.status for r in status.forward_status(df, ["invoice_id"], ["at"]).collect()}
    assert got == {"a": "Completed", "b": "Processing", "c": "Failed"}


def test_contract_report_sees_missing_and_mistyped(spark):
    df = spark.range(5).select(F.lit("r").alias("run_id"), F.col("id").alias("document_id"), F.lit("odd").alias("status"), F.lit(1).alias("extra"))
    rows = {(r["check"], r["column"]): r["violations"] for r in contracts.conformance_report(df, contracts.BRONZE_CONTRACT).collect()}
    assert rows[("required", "textract_response")] == 5 and rows[("required", "run_id")] == 0
    assert rows[("type", "document_id")] == 5 and rows[("enum", "status")] == 5 and rows[("undeclared", "extra")] == 5


def test_filters_do_not_copy_the_rules(spark):
    """A filter on a rule result stays small: costly columns are generated once, not copied into it."""
    from tests.conftest import SF
    from workload import inputs

    plan = inputs.silver(spark, SF).filter("processing_status = 'failed'")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "_technical" in line]
    assert filters and all("regexp" not in line for line in filters)


def test_silver_template_defaults(spark):
    row = silver_plan.conform(spark.range(1), {}).first()
    assert (row.document_type, row.quality_score, row.duplicate_strategy, row.vendor_name) == ("unknown", 1.0, "none", None)


def test_repeated_responses_do_not_multiply(spark):
    rows = spark.createDataFrame([("r", "d", "a", 1), ("r", "d", "b", 2), ("r", "e", "c", 1)], "run_id string, document_id string, enrichment string, at int")
    got = {(x.document_id, x.enrichment) for x in matching.one_per_document(rows, ["enrichment"], "at").collect()}
    assert got == {("d", "b"), ("e", "c")}
