"""Ordered, unique flag lists.

``array_except`` keeps first-seen order, removes repeats and drops the nulls of
rules that did not fire, all without a lambda, so the stage stays code-generated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(array() as array<string>)"


def no_flags() -> Column:
    return F.expr(EMPTY)


def flag(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def collect_flags(*candidates: Column) -> Column:
    return F.array_except(F.array(*candidates), F.array(F.lit(None).cast("string")))


def append_flags(flags: Column, *candidates: Column) -> Column:
    base = F.coalesce(flags, no_flags())
    return F.array_except(F.concat(base, F.array(*candidates)), F.array(F.lit(None).cast("string")))


def has_any(flags: Column, names) -> Column:
    return F.arrays_overlap(F.coalesce(flags, no_flags()), F.array(*[F.lit(n) for n in names]))


def coerce_flags(json_value: Column, invalid: str) -> Column:
    """Flags read from JSON as text: absent, one string, a list, or something else.

    ``json_value`` is the raw JSON text of the field (a list keeps its brackets,
    a string arrives without quotes).
    """
    text = F.btrim(json_value)
    return (
        F.when(json_value.isNull(), no_flags())
        .when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array(F.lit(invalid))))
        .when(text.startswith("{") | text.rlike(r"^(-?[0-9][0-9.eE+-]*|true|false)$"), F.array(F.lit(invalid)))
        .otherwise(F.array(json_value))
    )
