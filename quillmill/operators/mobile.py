"""Extraction of the four fields the mobile scanner keeps, each with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import let
from quillmill.functions.numbers import first, trim
from quillmill.functions.text import is_date, mobile_flat, mobile_normalize

NOT_FOUND = "Not Found"
AMOUNT = r"(\d{1,3}(?:,\d{3})*\.\d{2})"
NET = r"(?i)NET\s*TOTAL\s*[\s:]*(\d{1,3}(?:,\d{3})*\.\d{2})"
DATE = r"(\d{1,2}/\d{1,2}/\d{4})"


def _found(value: Column, confidence: Column | str) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), confidence.alias("confidence"))))


def _none() -> Column:
    return F.struct(F.lit(None).cast("string").alias("value"), F.lit("low").alias("confidence"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), trim)


def invoice_no(text: Column) -> Column:
    """struct(value, confidence).  Expects mobile_normalize'd text."""
    return let(_lines(text), lambda lines: let(mobile_flat(text), lambda flat: _invoice_no(lines, flat)))


def _invoice_no(lines: Column, n: Column) -> Column:
    def at(line: Column, i: Column) -> Column:
        v = first(line, r"(?i)No\s*:\s*(\d+)")
        near = F.array_join(F.slice(lines, i + 1, F.lit(3)), " ")
        same = F.when(F.length(v).between(3, 6), _found(v, F.when(near.rlike("(?i)Date"), "high").otherwise("medium")))
        below = F.when(line.rlike(r"(?i)^No\s*:?\s*\z"), _found(first(F.get(lines, i + 1), r"^(\d{3,6})\z"), "high"))
        return F.coalesce(same, below)

    by_line = F.get(F.filter(F.transform(lines, at), lambda x: x.isNotNull()), F.lit(0))
    numbers = F.regexp_extract_all(F.array_join(F.slice(lines, F.lit(1), F.lit(20)), " "), F.lit(r"\b(\d{3,6})\b"), F.lit(1))
    loose = F.get(F.filter(numbers, lambda v: (v != "446") & (F.length(v) < 5)), F.lit(0))
    return F.coalesce(
        by_line, _found(first(n, r"(?i)No\s*:\s*(\d{3,6})\s+.*?Date"), "high"), _found(first(n, r"(?i)No\s*:\s*(\d{3,6})"), "medium"),
        _found(first(n, r"(?i)No\s+(\d{3,6})"), "medium"), _found(loose, "medium"), _none(),
    )


def bill_date(text: Column) -> Column:
    return let(_lines(text), lambda lines: let(mobile_flat(text), lambda flat: _bill_date(lines, flat)))


def _bill_date(lines: Column, n: Column) -> Column:
    head = F.when(F.size(lines) > 25, F.lit(20)).otherwise(F.size(lines))
    good = lambda c: let(c, lambda x: F.when(is_date(x), x))

    def at(line: Column, i: Column) -> Column:
        hit = lambda: F.coalesce(good(first(line, DATE)), good(first(F.get(lines, i + 1), DATE)))
        return F.when((i < head) & line.rlike(r"(?i)Date\s*:?"), hit())

    by_line = F.get(F.filter(F.transform(lines, at), lambda x: x.isNotNull()), F.lit(0))
    some = F.get(F.filter(F.transform(F.slice(lines, F.lit(1), head), lambda l: good(first(l, DATE))), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(
        _found(by_line, "high"), _found(good(first(n, r"(?i)Date\s*:\s*" + DATE)), "high"),
        _found(good(first(n, r"(?i)Date\s*:?\s*\S*\s*" + DATE)), "medium"), _found(some, "medium"), _none(),
    )


def seller_gstin(text: Column) -> Column:
    """Only what starts before the first "To", or in the first quarter of the text, is the seller's."""
    to = F.regexp_instr(text, F.lit(r"(?i)\bTo\.?\b"))
    cutoff = F.when(to > 0, to - 1).otherwise(F.floor(F.length(text) * 0.25))

    def early(pattern: str, group: int) -> Column:
        """A match's first character stands before the cutoff; matches may reach beyond it."""
        pos = F.regexp_instr(text, F.lit(pattern))
        return F.when((pos > 0) & (pos - 1 < cutoff), first(text, pattern, group))

    return F.coalesce(
        _found(early(r"(?i)GSTIN\s*[:\-]?\s*([0-9A-Z]{15})", 1), "high"),
        _found(early(r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[A-Z0-9]{3}\b", 0), "high"),
        _found(F.replace(early(r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9\s]{3,5}\b", 0), F.lit(" "), F.lit("")), "medium"), _none(),
    )


def net_total(text: Column) -> Column:
    """The last "net total" line, else the largest amount over 1000 near the end."""
    return let(_lines(text), lambda lines: _net_total(lines, text))


def _net_total(lines: Column, text: Column) -> Column:

    def at(line: Column, i: Column) -> Column:
        hit = F.coalesce(first(line, NET), first(line, AMOUNT), first(F.get(lines, i + 1), AMOUNT))
        return F.when(F.contains(F.lower(line), F.lit("net total")), hit)

    by_line = F.try_element_at(F.filter(F.transform(lines, at), lambda x: x.isNotNull()), F.lit(-1))
    last = F.array_join(F.when(F.size(lines) > 25, F.slice(lines, F.lit(-20), F.lit(20))).otherwise(lines), " ")
    seen = F.concat(
        F.regexp_extract_all(last, F.lit(AMOUNT), F.lit(1)), F.regexp_extract_all(last, F.lit(r"\b(\d{4,}\.\d{2})\b"), F.lit(1))
    )
    valued = F.transform(seen, lambda s, i: F.struct(F.replace(s, F.lit(","), F.lit("")).cast("double").alias("v"), (-i).alias("o"), s.alias("s")))
    largest = F.array_max(F.filter(valued, lambda x: x["v"] > 1000))["s"]
    return F.coalesce(_found(by_line, "high"), _found(first(mobile_flat(text), NET), "high"), _found(largest, "medium"), _none())


def extract(bills: DataFrame, id_col: str = "bill_id", text_col: str = "text") -> DataFrame:
    """(id, invoice_no, date, gst, total), each a struct(value, confidence)."""
    t = F.col("_t")
    return bills.select(id_col, mobile_normalize(F.coalesce(text_col, F.lit(""))).alias("_t")).select(
        id_col, invoice_no(t).alias("invoice_no"), bill_date(t).alias("date"), seller_gstin(t).alias("gst"), net_total(t).alias("total")
    )


def gst_confidence(gst: Column) -> Column:
    good = gst.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[A-Z0-9]{3}\z")
    return F.when(F.coalesce(gst, F.lit("")).isin("", NOT_FOUND), "low").when(good, "high").otherwise("medium")


def date_confidence(date: Column) -> Column:
    good = date.rlike(r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\z")
    return F.when(F.coalesce(date, F.lit("")).isin("", NOT_FOUND), "low").when(good, "high").otherwise("medium")


def invoice_confidence(number: Column) -> Column:
    return F.when(F.coalesce(number, F.lit("")).isin("", NOT_FOUND), "low").when(F.length(number).between(2, 20), "high").otherwise("medium")


def total_confidence(total: Column) -> Column:
    v = F.replace(total, F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.coalesce(total, F.lit("")).isin("", NOT_FOUND) | v.isNull() | (v <= 0), "low").otherwise("high")
