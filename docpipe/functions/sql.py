"""Words of the query surface that Spark's SQL does not know, as session functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Date letters of the query surface and the patterns they stand for.
DATE_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss"}


def date_pattern(text: str) -> str:
    """SQL for the Spark pattern of a ``%`` pattern; its plain letters are quoted, so that they stand for themselves."""
    marks = {letter: f"char({k + 1})" for k, letter in enumerate(DATE_LETTERS)}
    out = text
    for letter, mark in marks.items():
        out = f"replace({out}, '{letter}', {mark})"
    out = f"regexp_replace({out}, '([A-Za-z]+)', concat(char(39), '$1', char(39)))"
    for letter, pattern in DATE_LETTERS.items():
        out = f"replace({out}, {marks[letter]}, '{pattern}')"
    return out


def register_functions(spark: SparkSession) -> None:
    """Make ``date_parse(text, pattern)`` and ``approx_distinct(value)`` known to this session's SQL.

    ``date_parse`` is a SQL function, inlined into the query. ``approx_distinct`` is another name of the built-in
    approximate count at its default error, which is the one wanted.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION date_parse(value STRING, pattern STRING) RETURNS TIMESTAMP "
        f"RETURN to_timestamp(value, {date_pattern('pattern')})"
    )
    names = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    known = spark._jsparkSession.sessionState().functionRegistry()
    builtin = names("approx_count_distinct")
    known.registerFunction(names("approx_distinct"), known.lookupFunction(builtin).get(), known.lookupFunctionBuilder(builtin).get())
