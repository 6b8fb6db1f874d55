"""Invoice status: latest state, forward-only transitions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States in order of progress; the last two are terminal.
STATUS_ORDER = {"Uploaded": 0, "Processing": 1, "Consolidating": 2, "Completed": 3, "Failed": 3}

DEFAULT_PAGE, MAX_PAGE = 20, 100


def progress(status: Column) -> Column:
    steps = F.create_map(*[F.lit(x) for pair in STATUS_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(steps, status), F.lit(-1))


def latest_status(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins per key; ``order`` breaks ties."""
    others = [c for c in events.columns if c not in key]
    latest = events.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return latest.select(*key, *[F.col(f"_last.{c}").alias(c) for c in others])


def forward_status(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """State after accepting only transitions that do not go backward.

    Taking transitions in order and refusing any to an earlier step ends at the
    latest event of the furthest step, which is one maximum: independent of
    arrival order, so replays change nothing.
    """
    others = [c for c in events.columns if c not in key]
    rank = F.struct(progress(F.col("status")).alias("step"), *[F.col(c) for c in order])
    best = events.groupBy(*key).agg(F.max_by(F.struct(*others), rank).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in others])


def _page_rows(latest: DataFrame, status: str | None, size: int, token: str | None) -> DataFrame:
    rows = latest if status is None else latest.filter(F.col("status") == status)
    if token is not None:
        rows = rows.filter(F.col("invoice_id") > token)
    return rows.orderBy("invoice_id").limit(size)


def status_page(latest: DataFrame, status: str | None = None, limit: int = DEFAULT_PAGE, token: str | None = None) -> DataFrame:
    """One page of at most ``MAX_PAGE`` rows in ``invoice_id`` order; filters apply before paging.

    The token of the next page is the last ``invoice_id`` of this one.
    """
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    return _page_rows(latest, status, limit, token)


def next_token(latest: DataFrame, status: str | None = None, limit: int = DEFAULT_PAGE, token: str | None = None) -> DataFrame:
    """One row: the token that continues after this page, null on the last page.

    One row more than the page is asked for; nothing else is read or counted.
    """
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    ids = F.array_sort(F.collect_list("invoice_id"))
    probe = _page_rows(latest.select("invoice_id", *(["status"] if status is not None else [])), status, limit + 1, token)
    return probe.agg(ids.alias("_ids")).select(F.when(F.size("_ids") > limit, F.get("_ids", F.lit(limit - 1))).alias("next_token"))


def status_from_outcome(outcome: Column, consolidated: Column) -> Column:
    """Status that follows from a document's outcome, so that no state is left hanging."""
    return (
        F.when(outcome.isin("rejected", "failed"), F.lit("Failed"))
        .when((outcome == "valid") & consolidated, F.lit("Completed"))
        .when(outcome == "valid", F.lit("Consolidating"))
        .otherwise(F.lit("Processing"))
    )
