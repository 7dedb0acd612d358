"""Numbers as scanned text holds them: prefixes, stray letters, commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.columns import let

#: Letters that are read for 0, 1, 1, 5 and 8.
MISREAD = "OIlSB"
_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match or if the group is empty."""
    return let(F.regexp_extract(text, pattern, group), lambda v: F.when(v != "", v))  # nullif would match twice


#: White space, as \s has it.
SPACE = " \t\n\x0b\f\r"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def parse_float(text: Column) -> Column:
    """The longest numeric prefix as a double, else null ('125.5x' is 125.5)."""
    return F.regexp_extract(text, _PREFIX, 1).try_cast("double")


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Halves go up, below zero too (-2.5 becomes -2)."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def repair_numeric(token: Column) -> Column:
    """Letters that scans put for digits; left alone where letters exceed digits by over two."""
    t = trim(token)
    digits, letters = (F.length(F.regexp_replace(t, kind, "")) for kind in ("[^0-9]", "[^A-Za-z]"))
    fixed = F.when(letters > digits + 2, t).otherwise(F.translate(t, MISREAD, "01158"))
    return F.when(token.rlike(f"[{MISREAD}]"), fixed).otherwise(t)


def parse_repaired(token: Column) -> Column:
    plain = token.rlike(r"^[0-9]+\.?[0-9]*\z")
    value = parse_float(repair_numeric(F.replace(token, F.lit(","), F.lit(""))))
    return F.when(plain, token.try_cast("double")).when(token.rlike(rf"^[\s,]*[+\-.0-9{MISREAD}]"), value)  # else it is no number


def to_number(text: Column) -> Column:
    """Commas dropped; null, empty and unreadable are 0."""
    return F.coalesce(parse_float(F.replace(text, F.lit(","), F.lit(""))), F.lit(0.0))


def shown(value: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.regexp_replace(value.cast("string"), r"\.0\z", "")


def currency(value: Column) -> Column:
    """Two decimals after the rupee sign; null and NaN count as 0."""
    return F.concat(F.lit("₹"), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).cast("decimal(18,2)").cast("string"))
