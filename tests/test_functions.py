"""Column functions against tables of inputs and expected values."""

from __future__ import annotations

import datetime as dt
import pathlib
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from docpipe.functions import flags, keys, responses, text, values
from docpipe.sources.arrivals import decode_key


def apply(spark, inputs, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    out = rows.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1] if len(columns) == 1 else tuple(r)[1:] for r in out]


X = F.col("x")


def test_amount_known(spark):
    given = {"(500)": 500.0, "1.234,56": 1.23456, "1 234 56": 234.56, "12 345": 12345.0, "1e5": 15.0,
             "INV-2024": -2024.0, "": None, "n/a": None, "$1,234.50 USD": 1234.5, "12 50": 12.5}
    assert apply(spark, list(given), values.amount(X)) == list(given.values())
    assert apply(spark, [None], values.amount(X)) == [None]


def test_amount_other_blanks(spark):
    given = {"1\u202f234.56": 1234.56, "12\u00a034": 12.34, "7\t50": 7.5, "-3 20": 3.2, "[9,000]": 9000.0, "4.5.6": 4.5}
    given["1\u00a0234,00\u00a0$"] = 123400.0
    assert apply(spark, list(given), values.amount(X)) == list(given.values())


@pytest.mark.parametrize("raw,want", [
    ("2024-03-05", "2024-03-05"), ("2024/3/5", "2024-03-05"), ("due 2024.12.01.", "2024-12-01"),
    ("03/05/2024", "2024-03-05"), ("13/05/2024", "2024-05-13"), ("3-5-24", "2024-03-05"), ("1/2/49", "2049-01-02"),
    ("1/2/76", "1976-01-02"), ("1/2/75", "2075-01-02"), ("Mar 5, 2024", "2024-03-05"), ("5 March 2024", "2024-03-05"),
    ("5th of march, 2024", "2024-03-05"), ("SEPT. 1 2024", "2024-09-01"), ("20240305", "2024-03-05"),
    ("5-Mar-24", "2024-03-05"), ("2024-Mar-05", "2024-03-05"), ("5/Mar/2024", "2024-03-05"), ("5.Mar.76", "1976-03-05"),
    ("2024-03-05T10:00:00Z", "2024-03-05"), ("02/30/2024", None), ("2024-13-01", None), ("2024", None),
    ("", None), ("not a date", None), ("March 2024", None), ("12345678901", None),
])
def test_date(spark, raw, want):
    assert apply(spark, [raw], values.date(X, dt.date(2026, 1, 1))) == [want]


def test_clean_string(spark):
    given = {
        "  a  b\tc ": "a b c", "'quoted'": "quoted", '"x"': "x", "": None, "   ": None, "''": None,
        "Joe\u00e2\u20ac\u2122s": "Joe's", "Caf\u00c2 ": "Caf", "a\u00a0b": "a b", "a\n\nb": "a b",
    }
    assert apply(spark, list(given), text.clean_string(X)) == list(given.values())


def test_clean_lines(spark):
    def python_lines(s):
        return "\n".join(line for line in (p.strip() for p in s.splitlines()) if line)

    rng = random.Random(4)
    given = ["".join(rng.choice("ab \t\r\n\x0b\x0c\x1c\x85  　") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert apply(spark, given, text.clean_lines(X)) == [python_lines(s) for s in given]


def test_clean_lines_is_linear_on_long_runs(spark):
    run = " " * 200_000
    assert apply(spark, ["a" + run + "b" + run], text.clean_lines(X)) == ["a" + run + "b"]


def test_names(spark):
    given = ["a.pdf", "a.b.PDF", ".hidden", "noext", "a.", "x/y/z.tar.gz", "run.d/file", "..a", "a b.TIF"]
    got = apply(spark, given, keys.base_name(X), keys.stem(keys.base_name(X)), keys.suffix(keys.base_name(X)))
    for s, (name, stem, suffix) in zip(given, got):
        if s not in ("a.", "..a"):  # interpreters differ on a lone trailing dot
            p = pathlib.PurePosixPath(s)
            assert (name, stem, suffix) == (p.name, p.stem, p.suffix.lower()), s


def test_run_id(spark):
    given = {"raw/run_id=r1/a.pdf": "r1", "run_id= r 2 /a": "r 2", "raw/run_id=/run_id=r3/a": "r3", "raw/xrun_id=r/a": None, "": None}
    assert apply(spark, list(given), keys.run_id_from_key(X)) == list(given.values())


def test_safe_stem(spark):
    given = {"": "unknown_document", " a b ": "a_b", "..__..": "unknown_document", "x/y": "x_y", "\u00f1and\u00fa": "and", "ok-1.2": "ok-1.2"}
    assert apply(spark, [*given, None], keys.safe_stem(X)) == [*given.values(), "unknown_document"]


def test_decode_key(spark):
    given = ["a+b%20c.pdf", "100%.pdf", "50%25+x", "%zz%41", "a%C3%B1o", "plain", "%"]
    assert apply(spark, given, decode_key(X)) == [urllib.parse.unquote_plus(s) for s in given]


def test_currency(spark):
    given = ["cost 5 PEN", "ITEMS/QTY", "IS PENDING", "5 €", "in EUR", "$5", "5 USD", "none"]
    lax = apply(spark, given, values.currency(X, F.lit(None).cast("string"), F.lit(1.0)))
    assert lax == ["PEN", "PEN", "PEN", "EUR", "EUR", "USD", "USD", None]
    strict = apply(spark, given, values.currency(X, F.lit(" "), F.lit(1.0), strict=True))
    assert strict == ["PEN", None, None, "EUR", "EUR", "USD", "USD", None]
    assert apply(spark, ["$5"], values.currency(X, F.lit(None).cast("string"), F.lit(None).cast("double"))) == [None]
    assert apply(spark, ["$5"], values.currency(X, F.lit(" gbp "), F.lit(1.0))) == ["GBP"]


def test_flags(spark):
    got = apply(spark, [None, "low", '["a","b"]', '{"x":1}', "12", "true"], flags.coerce_flags(X, "invalid"))
    assert got == [[], ["low"], ["a", "b"], ["invalid"], ["invalid"], ["invalid"]]
    added = flags.append_flags(F.split(X, ","), flags.flag(F.lit(True), "b"), flags.flag(F.lit(False), "z"), flags.flag(F.lit(True), "c"))
    assert apply(spark, ["a,b", "c"], added) == [["a", "b", "c"], ["c", "b"]]


def test_responses(spark):
    given = ["```json\n{\"total_amount\": 1}\n``` tail", "x {\"total_amount\": 2} trailing", "no", "", "{\"total_amount\": ", "[1]"]
    body = responses.json_body(X)
    parsed = responses.parse_extraction(body)
    got = apply(spark, given, parsed["total_amount"], responses.extraction_flags(X, body, parsed))
    assert [g[0] for g in got[:2]] == ["1", "2"]
    assert [g[1] for g in got] == [[], [], ["invalid_json_response"], ["empty_llm_response"], ["invalid_json_response"], ["invalid_json_response"]]
    assert apply(spark, ["```sql\nSELECT 1\n```", "SELECT 2", "```open"], responses.statement_text(X)) == ["SELECT 1", "SELECT 2", "```open"]


def test_json_number_with_exponent(spark):
    body = ['{"total_amount": 1.5e3}', '{"total_amount": "1e5"}', '{"total_amount": 7}']
    parsed = responses.parse_extraction(X)
    total = values.amount(responses.json_number_text(X, "total_amount", parsed["total_amount"]))
    assert apply(spark, body, total) == [1500.0, 15.0, 7.0]
