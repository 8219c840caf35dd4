"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that end a line and the characters that are blank.
LINE_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Markers of unfinished work, and the identifier token.
MARKERS = ("TODO", "FIXME", "HACK", "XXX")
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"

VERY_SHORT_LINES = 5


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


# What is deleted from a model name, in this order.
NAME_CUTS = (r"(?s)^.*?--", r"-hf$", r"[-_v. ]", r"\d{8}$")


def normalise_name(name: Column) -> Column:
    """Organisation prefix, ``-hf``, separators and date stamps removed; lower case."""
    for pattern in NAME_CUTS:
        name = F.regexp_replace(name, pattern, "")
    return F.lower(name)


def line_count(text: Column) -> Column:
    """Newlines plus one."""
    return F.regexp_count(text, F.lit("\n")) + 1


def nonblank_lines(text: Column) -> Column:
    """One match per line holding a visible character: from that character to the line end."""
    return F.regexp_count(text, F.lit(f"[^{BLANKS}][^{LINE_ENDS}]*"))


def is_very_short(text: Column) -> Column:
    return (nonblank_lines(text) <= VERY_SHORT_LINES).cast("int")


def marker_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?iU)\b({'|'.join(MARKERS)})\b"))


def identifier_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(IDENTIFIER))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))


def parse_libs(libs: Column) -> Column:
    """Distinct names from a list literal; anything else gives an empty array."""
    no_trailing_comma = F.regexp_replace(libs, r",\s*\]\s*$", "]")
    parsed = F.from_json(
        no_trailing_comma, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"}
    )
    is_list = F.ltrim(libs).startswith("[")
    return F.array_distinct(
        F.coalesce(F.when(is_list, parsed), F.array().cast("array<string>"))
    )


def lib_coverage(required: Column, imported: Column) -> Column:
    """Share of the required libraries that are imported; 1 when none is required."""
    found = F.size(F.array_intersect(required, imported))
    return F.when(F.size(required) == 0, F.lit(1.0)).otherwise(
        F.round(found / F.size(required), 4)
    )


def missing_libs(required: Column, imported: Column) -> Column:
    return F.size(F.array_except(required, imported))


def length_ratio(code: Column, prompt: Column) -> Column:
    return F.round(
        F.length(text_or_empty(code)) / F.greatest(F.length(text_or_empty(prompt)), F.lit(1)), 4
    )
