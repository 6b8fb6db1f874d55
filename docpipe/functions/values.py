"""Amounts, dates and currencies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.functions.text import blank_to_null, strip

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_DAY = "[0-9]{1,2}(?:st|nd|rd|th)?"
_YEAR = "(?:[0-9]{4}|[0-9]{2})(?![0-9])"
_GAP = r"[\s/.-]+"
_NAMED_MONTH = (
    rf"(?i)(?<![a-z0-9])(?:{_MONTH_NAME}\.?{_GAP}{_DAY},?{_GAP}{_YEAR}"
    rf"|{_DAY}{_GAP}(?:of\s+)?{_MONTH_NAME}\.?,?{_GAP}{_YEAR}"
    rf"|[0-9]{{4}}{_GAP}{_MONTH_NAME}\.?,?{_GAP}{_DAY}(?![0-9]))"
)
#: One white space character, no-break and other Unicode spaces included.
_BLANK = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def amount(c: Column) -> Column:
    """Amount text to double.

    A number followed by exactly two spaced digits, in a text without a point, is
    read as units and cents. Then thousands commas, brackets, letters, ``$`` and
    white space (no-break spaces too) are dropped and the first signed decimal number is taken.
    """
    spaced = F.regexp_extract(c, rf"[0-9][0-9,]*{_BLANK}+[0-9]{{2}}(?![0-9])", 0)
    joined = F.regexp_replace(spaced, f"{_BLANK}+", ".")
    text = F.when(c.contains(".") | (spaced == ""), c).otherwise(joined)
    bare = F.regexp_replace(text, rf"[,\[\](){{}}A-Za-z$]|{_BLANK}", "")
    number = F.regexp_extract(bare, r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return blank_to_null(number).try_cast("double")


def _year_first(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?<![0-9])[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])", 0)
    return F.translate(found, "/.", "--").try_cast("date")


def _whole_year(parts: Column, as_of: dt.date) -> Column:
    """A two-digit year at the end of ``-`` separated parts becomes the one within fifty years of ``as_of``."""
    first_year = as_of.year - 50
    century, tens, ones = first_year // 100, first_year % 100 // 10, first_year % 10
    early = f"{tens}[{ones}-9]" + (f"|[{tens + 1}-9][0-9]" if tens < 9 else "")
    return F.regexp_replace(
        F.regexp_replace(parts, f"-({early})$", f"-{century}$1"), "-([0-9]{2})$", f"-{century + 1}$1"
    )


def _month_first(c: Column, as_of: dt.date) -> Column:
    """``M/D/Y``; when the first part cannot be a month it is the day.

    A two-digit year is the one within fifty years of ``as_of``. Which of the two
    centuries that is depends on the digits only, so it is settled by a pattern.
    """
    found = F.translate(
        F.regexp_extract(
            c, r"(?<![0-9])[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})(?![0-9])", 0
        ),
        "/.", "--",
    )
    whole = _whole_year(found, as_of)
    parts = "^([0-9]+)-([0-9]+)-([0-9]+)$"
    return F.coalesce(
        F.regexp_replace(whole, parts, "$3-$1-$2").try_cast("date"),
        F.regexp_replace(whole, parts, "$3-$2-$1").try_cast("date"),
    )


def _named_month(c: Column, as_of: dt.date) -> Column:
    """``Jan 5, 1997``, ``5th of January, 1997``, ``5-Mar-24``, ``5/Mar/2024``, ``2024-Mar-05``."""
    found = F.regexp_extract(c, _NAMED_MONTH, 0)
    name = F.lower(F.substring(F.regexp_extract(found, "[A-Za-z]{3,}", 0), 1, 3))
    month = F.floor((F.position(name, F.lit(_MONTHS)) + 2) / 3).cast("string")
    first, last = F.regexp_extract(found, "[0-9]+", 0), F.regexp_extract(found, "([0-9]+)[^0-9]*$", 1)
    turned = F.length(first) == 4
    day, year = F.when(turned, last).otherwise(first), F.when(turned, first).otherwise(last)
    whole = _whole_year(F.concat_ws("-", month, day, year), as_of)
    return F.when(found != "", F.regexp_replace(whole, "^([0-9]+)-([0-9]+)-([0-9]+)$", "$3-$1-$2").try_cast("date"))


def _compact(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?<![0-9])[0-9]{8}(?![0-9])", 0)
    return F.regexp_replace(found, "^(....)(..)(..)$", "$1-$2-$3").try_cast("date")


def date(c: Column, as_of: dt.date = dt.date(2000, 1, 1)) -> Column:
    """Date text to ISO text, or null.

    A ladder of explicit forms, tried in order: year first, numeric month first,
    named month, eight digits. Missing parts are never filled in from today.
    ``as_of`` only decides the century of two-digit years.
    """
    found = F.coalesce(_year_first(c), _month_first(c, as_of), _named_month(c, as_of), _compact(c))
    return found.cast("string")


def currency(text: Column, explicit: Column, total: Column, strict: bool = False) -> Column:
    """Explicit currency if any, else evidence in the text.

    ``strict`` asks for word boundaries, so that ``ITEMS/QTY`` or ``PENDING`` no
    longer count as evidence.
    """
    raw = F.coalesce(text, F.lit(""))
    upper = F.upper(raw)
    stated = blank_to_null(F.upper(strip(explicit)))
    if strict:
        pen, eur, usd = upper.rlike(r"\bPEN\b|\bS/|\bSOLES\b"), upper.rlike(r"\bEUR\b|€"), upper.rlike(r"\bUSD\b|\$")
    else:
        pen = upper.contains(" PEN") | upper.contains("S/") | upper.contains("SOLES")
        eur = upper.contains(" EUR") | raw.contains("€")
        usd = raw.contains("$") | upper.contains(" USD")
    return F.coalesce(
        stated,
        F.when(pen, F.lit("PEN")).when(eur, F.lit("EUR")).when(total.isNotNull() & usd, F.lit("USD")),
    )


def key_amount(total: Column) -> Column:
    """Two-decimal text for comparison keys (half up on the decimal value)."""
    return total.cast("decimal(38,2)").cast("string")
