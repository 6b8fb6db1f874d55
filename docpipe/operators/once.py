"""Evaluate costly columns exactly once per row.

Catalyst pushes a filter below the projection that computes its column by
copying the column's whole expression into the filter, at every level. With
parsing and regular expressions in there the copies cost more than the filter
saves. A one-element ``inline`` hands the values over as generated columns,
which filters are not pushed through; filters on the other columns still are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` as they are, plus ``columns``, each computed once per row."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
