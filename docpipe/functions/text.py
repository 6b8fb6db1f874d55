"""Text clean-up, classification and bronze-text rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
SPACES = "\t\x1f \xa0" + chr(0x1680) + "".join(map(chr, range(0x2000, 0x200B))) + "".join(map(chr, (0x202F, 0x205F, 0x3000)))
WHITESPACE = LINE_BREAKS + SPACES

_NL = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_SP = r"[\t\x1f \xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Mis-decoded punctuation and its repair, applied in this order.
MOJIBAKE = (
    ("Ã¢â‚¬Ëœ", "'"),
    ("Ã¢â‚¬â„¢", "'"),
    ("Ã¢â‚¬Å“", '"'),
    ("Ã¢â‚¬ï¿½", '"'),
    ("Ã‚Â®", ""),
    ("Ã‚", ""),
    ("â€˜", "'"),
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€\ufffd", '"'),
    ("Â®", ""),
    ("Â", ""),
)


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_string(c: Column) -> Column:
    """Repair mis-decoded characters, collapse white space, drop enclosing quotes.

    The twelve replacements all begin with one of three letters, so rows without
    those letters (nearly all of them) skip the chain.
    """
    repaired = reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, strip(c))
    text = F.when(c.rlike("[ÂÃâ]"), repaired).otherwise(strip(c))
    return blank_to_null(F.btrim(F.regexp_replace(text, f"{_WS}+", " "), F.lit(" '\"\t\r\n")))


def clean_lines(c: Column) -> Column:
    """Strip every line and drop the empty ones.

    Stripping lines and dropping empty ones equals collapsing each white-space
    run that holds a line break into one line feed. The run is matched from its
    first character with possessive quantifiers, so the cost stays linear.
    """
    collapsed = F.regexp_replace(c, f"(?<!{_SP}){_SP}*+{_NL}{_WS}*+", "\n")
    return strip(collapsed)


def key_text(c: Column) -> Column:
    """Lower-cased, white-space-collapsed comparison text; null when null or empty."""
    return F.when(c != "", F.regexp_replace(F.lower(strip(c)), f"{_WS}+", " "))


def document_type(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(lowered.contains("invoice"), F.lit("invoice"))
        .when(lowered.contains("contribution"), F.lit("contribution"))
        .otherwise(F.lit("unknown"))
    )


def render_markdown(text: Column, file_name: Column, path: Column) -> Column:
    """One bronze text document: metadata bullets, then the fenced text."""
    return F.concat(
        F.lit("# OCR Extract\n\n- Source file: `"), file_name,
        F.lit("`\n- Source path: `"), path,
        F.lit("`\n\n## OCR Text\n\n```text\n"), text, F.lit("\n```\n"),
    )


def _metadata_bullet(markdown: Column, label: str, default: Column) -> Column:
    found = F.regexp_extract(markdown, rf"- {label}:{_WS}*`([^`]+)`", 1)
    return F.coalesce(blank_to_null(found), default)


def metadata_file_name(markdown: Column, default: Column) -> Column:
    return _metadata_bullet(markdown, "Source file", default)


def metadata_path(markdown: Column, default: Column) -> Column:
    return _metadata_bullet(markdown, "Source path", default)
