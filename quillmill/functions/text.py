"""Text and date functions of scanned bills."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.columns import let
from quillmill.functions.numbers import first, round_half_up, trim

# Misread words, what they stand for, and two letters that each of them has (in either case), in order.
REPAIRS = (
    (r"(?i)\bT0TAL\b", "TOTAL", "0T"), (r"(?i)\bGST\s*N0\b", "GST No", "N0"), (r"(?i)\bGSTNO\b", "GST No", "TN"), (r"\bNo\.", "No:", "o."),
    (r"(?i)\bG5T\b", "GST", "5T"),
)
FLAT_REPAIRS = (
    (r"(?i)\bT0TAL\b", "TOTAL", "0T"), (r"(?i)\bTOIAL\b", "TOTAL", "OI"), (r"(?i)\bTDTAL\b", "TOTAL", "TD"), (r"(?i)\bGST\s*N0\b", "GST No", "N0"),
    (r"(?i)\bGSTNO\b", "GST No", "TN"), (r"(?i)\bG5T\b", "GST", "5T"), (r"\bNo\.", "No:", "o."),
)


def _repaired(text: Column, pattern: str, own: str, pair: str) -> Column:
    cases = {a + b for a in (pair[0].upper(), pair[0].lower()) for b in (pair[1].upper(), pair[1].lower())}
    may = reduce(or_, [F.contains(text, F.lit(c)) for c in sorted(cases)])
    return F.when(may, F.regexp_replace(text, pattern, own)).otherwise(text)


def _repair(text: Column, repairs: Sequence[tuple[str, str, str]]) -> Column:
    """Patterns are looked for only in texts that have their two letters."""
    for repair in repairs:
        text = let(text, lambda t: _repaired(t, *repair))
    return text


def _one_space(text: Column) -> Column:
    return let(text, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t))


def normalize_lines(text: Column) -> Column:
    """Runs of spaces become one, line breaks stay, misread labels are repaired."""
    return _repair(trim(_one_space(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")))), REPAIRS)


def normalize_flat(text: Column) -> Column:
    """As normalize_lines, but all white space, line breaks too, becomes one space."""
    t = trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), r"\s+", " "))
    return _repair(t, FLAT_REPAIRS)


def mobile_normalize(text: Column) -> Column:
    return trim(F.regexp_replace(F.replace(text, F.lit("\n\n"), F.lit("\n")), " +", " "))


def mobile_flat(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\s+", " "))


def mobile_clean(text: Column) -> Column:
    """Blank lines and lines of digits go."""
    t = F.regexp_replace(text, r"\n{2,}", "\n")
    t = F.regexp_replace(t, r"(?<=\A|\n)\d+(?=\n|\z)", "")
    return trim(F.regexp_replace(t, r"\n{2,}", "\n"))


def joined_lines(lines: Column) -> Column:
    """The trimmed lines as one text."""
    return F.array_join(F.transform(lines, trim), "\n")


def top_part(text: Column, percent: float) -> Column:
    """The first ``percent`` of a text's characters, one at least."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(text) * (percent / 100.0))).cast("int"))


def spelt(pattern: str, whole: bool = True, exact: bool = False) -> str:
    """A pattern for what is ``pattern`` in capitals and without white space; the dotless i has the capital I.

    whole: from the first to the last character; exact: as it is written, not in either case.
    """
    def letter(m: re.Match) -> str:
        own = m[0].removesuffix("?").strip("[]")
        if not exact:
            own = "".join(c + c.lower() + ("\u0131" if c == "I" else "") if c.isalpha() else c for c in own)
        return rf"(?:[{own}]\s*)" + ("?" if m[0].endswith("?") else "")

    own = "(?:" + re.sub(r"(?:\[[^]]*\]|[A-Z])\??", letter, pattern) + ")"
    return rf"^\s*{own}\z" if whole else own


TOTAL, NET_TOTAL = spelt("T[O0D]?TAL|TOIAL"), spelt("NETT[O0D]?TAL")


def is_total(word: Column) -> Column:
    return F.coalesce(word, F.lit("")).rlike(TOTAL)


def is_net_total(word: Column) -> Column:
    return F.coalesce(word, F.lit("")).rlike(NET_TOTAL)


def iso_date(date: Column) -> Column:
    """d/m/y (two-digit years are 20yy) or y/m/d, split at / or -, as yyyy-mm-dd; ranges are not checked."""
    p = F.split(date, "[/-]")
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    two = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    year_first = F.concat_ws("-", a, two(b), two(c))
    day_first = F.concat_ws("-", F.when(F.length(c) == 2, F.concat(F.lit("20"), c)).otherwise(c), two(b), two(a))
    return F.when(F.size(p) == 3, F.when(F.length(a) == 4, year_first).otherwise(day_first))


def iso_date_strict(date: Column) -> Column:
    """Only d/m/yyyy with / . or - is turned; anything else stays as it is."""
    d, m, y = (F.regexp_extract(date, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\z", i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(date)


def form_date(date: Column) -> Column:
    """As the form shows it: unless the third part has four digits, the first one is taken as the year."""
    one, two = r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})", r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    g = [F.coalesce(first(date, one, i), first(date, two, i)) for i in (1, 2, 3)]
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    year = F.when(F.length(g[0]) == 2, F.concat(F.lit("20"), g[0])).otherwise(g[0])
    out = F.when(F.length(g[2]) == 4, F.concat_ws("-", g[2], pad(g[1]), pad(g[0]))).otherwise(F.concat_ws("-", year, pad(g[1]), pad(g[2])))
    return F.when(F.coalesce(date, F.lit("")) == "", F.lit("")).when(g[0].isNull(), date).otherwise(out)


def is_date(date: Column) -> Column:
    """Three whole numbers, day 1 to 31 and month 1 to 12."""
    part = lambda p, i: F.get(p, F.lit(i)).try_cast("int")
    return F.coalesce(
        let(F.split(date, "[/-]"), lambda p: (F.size(p) == 3) & part(p, 2).isNotNull() & part(p, 0).between(1, 31) & part(p, 1).between(1, 12)),
        F.lit(False),
    )


def image_hash(data_url: Column) -> Column:
    """SHA-256 in lower-case hex; empty without input."""
    return F.when(F.coalesce(data_url, F.lit("")) == "", F.lit("")).otherwise(F.sha2(data_url, 256))


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def spaced_label(name: Column) -> Column:
    return trim(F.regexp_replace(name, "([A-Z])", " $1"))


def two_decimals(confidence: Column) -> Column:
    return round_half_up(confidence, 2)


def page_dpi(width: Column, height: Column) -> Column:
    """struct(dpi, adequate) for an A4 page."""
    dpi = F.least(width / 8.27, height / 11.69)
    return F.struct(dpi.alias("dpi"), ((width >= 400) & (dpi >= 50)).alias("adequate"))


def resolution(width: Column, height: Column) -> Column:
    area = width.cast("long") * height
    return F.struct((area >= 250000).alias("adequate"), (area >= 1000000).alias("recommended"))


def heat_band(percent: Column) -> Column:
    return F.when(percent < 60, "red").when(percent < 80, "orange").otherwise("green")


def border_band(percent: Column) -> Column:
    """Null where nothing is marked."""
    return F.when(percent > 0, F.when(percent < 60, "red").when(percent < 85, "orange"))


def badge_band(percent: Column) -> Column:
    return F.when(percent >= 70, "high").when(percent >= 50, "medium").otherwise("low")


def rescale(value: Column, scale: Column, shown: Column, natural: Column) -> Column:
    return value / scale * shown / natural
