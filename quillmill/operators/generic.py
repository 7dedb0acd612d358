"""Extraction from bills of unknown layout, by labels, with rules per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.numbers import first, parse_float, shown, trim
from quillmill.functions.text import iso_date

# The rules of the default company.
DEFAULT_RULES = {
    "company": "Default Template", "customer_name_rule": "AFTER:Bill To", "total_rule": "LABEL:Total", "gst_rule": "LABEL:GST",
    "bill_no_rule": "LABEL:Invoice No", "date_rule": "LABEL:Date",
}
_NUMBER = r"([\d,]+\.?\d*)"
_NAME = r"[\s:]+([A-Z][A-Za-z\s&]+?)(?:\n|GST|Date|Invoice|Total|\z)"


class Rules:
    """Rules by company; unknown companies get the default's, and new ones overlay it."""

    def __init__(self):
        self.companies = {"default": dict(DEFAULT_RULES), "new-goo-nits": DEFAULT_RULES | {"company": "New Goo Nits"}}

    def get(self, company: str = "default") -> dict:
        return self.companies.get(company, self.companies["default"])

    def set(self, company: str, rules: dict) -> None:
        self.companies[company] = {**self.companies["default"], **rules, "company": company}


def _labelled(rules: dict | None, key: str, kind: str, pattern: str) -> list[str]:
    rule = (rules or {}).get(key) or ""
    return ["(?i)(?:" + rule[len(kind) :].strip() + ")" + pattern] if rule.startswith(kind) else []


def _one(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[first(text, p) for p in patterns])


def bill_no(text: Column, rules: dict | None = None) -> Column:
    patterns = _labelled(rules, "bill_no_rule", "LABEL:", r"[\s#:]*([A-Z0-9\-]+)")
    return _one(text, [*patterns, r"(?i)(?:Invoice|Bill|INV)[\s#:]*No[.\s#:]*([A-Z0-9\-]+)", r"(?i)(?:Invoice|Bill)[\s#:]*([A-Z0-9\-]{4,})", r"(?i)No[.\s#:]*([A-Z0-9\-]+)"])


def bill_date(text: Column) -> Column:
    found = _one(text, [r"(?i)(?:Date|Dated?)[\s:]*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})", r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})", r"(\d{4}[/\-]\d{1,2}[/\-]\d{1,2})"])
    return iso_date(found)


def customer(text: Column, rules: dict | None = None) -> Column:
    patterns = _labelled(rules, "customer_name_rule", "AFTER:", _NAME)
    found = _one(text, [*patterns, r"(?i)(?:To|Customer|Bill\s*To)" + _NAME, r"(?i)(?:Customer\s*Name)" + _NAME])
    return F.substring(F.get(F.split(trim(found), "\n"), F.lit(0)), 1, 100)


def gst(text: Column, rules: dict | None = None) -> Column:
    patterns = _labelled(rules, "gst_rule", "LABEL:", r"[\s:]*[₹$]?[\s]*" + _NUMBER)
    return F.replace(_one(text, [*patterns, r"(?i)(?:GST|Tax)[\s:]*[₹$]?[\s]*" + _NUMBER, r"(?i)(?:GST\s*Amount)[\s:]*[₹$]?[\s]*" + _NUMBER]), F.lit(","), F.lit(""))


def total(text: Column, rules: dict | None = None) -> Column:
    """The labelled total, else the largest number of the text."""
    patterns = _labelled(rules, "total_rule", "LABEL:", r"[\s:]*[₹$]?[\s]*" + _NUMBER)
    labelled = _one(text, [*patterns, r"(?i)(?:Total|Grand\s*Total|Amount\s*Payable)[\s:]*[₹$]?[\s]*" + _NUMBER, r"(?i)(?:Total\s*Amount)[\s:]*[₹$]?[\s]*" + _NUMBER])
    numbers = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda n: parse_float(F.replace(n, F.lit(","), F.lit(""))))
    return F.coalesce(F.nullif(F.replace(labelled, F.lit(","), F.lit("")), F.lit("")), shown(F.array_max(F.filter(numbers, lambda v: v.isNotNull()))))


def extract(bills: DataFrame, rules: dict | None = None, id_col: str = "bill_id", text_col: str = "text") -> DataFrame:
    """(id, bill_no, date, customer, gst, total), null where nothing is found."""
    t = F.col(text_col)
    return bills.select(
        id_col, bill_no(t, rules).alias("bill_no"), bill_date(t).alias("date"), customer(t, rules).alias("customer"),
        gst(t, rules).alias("gst"), total(t, rules).alias("total"),
    )


FIELDS = ("bill_no", "date", "customer", "gst", "total")


def extract_any(
    bills: DataFrame, rules: dict | None = None, id_col: str = "bill_id", text_col: str = "text", words: DataFrame | None = None,
    scan_confidence: str | None = None,
) -> DataFrame:
    """(id, bill_no, date, customer, gst, total, confidence): bills of the known template by its own parser, all others by labels.

    confidence is a map from each field to 0-1.  Of the known template a field that is
    there has 0.9.  Else it is the mean of the words (id, text, confidence 0-100) that
    the value holds or is held by, without such words that of the scan (a column of
    bills, 0-100), or 0.5; a field that isn't there has 0.
    """
    from quillmill.operators.template import detect_template, parse_bills, to_generic
    from quillmill.operators.votes import field_confidence

    known = detect_template(F.col(text_col)).isNotNull()
    own = to_generic(parse_bills(bills.filter(known), id_col, text_col), id_col)
    own = own.select(id_col, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in FIELDS], "confidence")
    scanned = F.nullif(F.col(scan_confidence).cast("double"), F.lit(0.0)) if scan_confidence else F.lit(None).cast("double")
    t = F.col(text_col)
    values = (bill_no(t, rules), bill_date(t), customer(t, rules), gst(t, rules), total(t, rules))
    found = bills.filter(~F.coalesce(known, F.lit(False))).select(id_col, scanned.alias("_scan"), *[v.alias(c) for c, v in zip(FIELDS, values)])
    if words is None:
        sure = lambda c: F.when(trim(F.coalesce(c, F.lit(""))) == "", 0.0).otherwise(F.coalesce(F.col("_scan") / 100, F.lit(0.5)))
        return own.unionByName(found.select(id_col, *FIELDS, F.create_map(*[x for c in FIELDS for x in (F.lit(c), sure(F.col(c)))]).alias("confidence")))
    each = found.select(id_col, "_scan", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FIELDS])).alias("f"))
    rated = field_confidence(each.select(id_col, "_scan", "f.*"), words, F.col("_scan"), id_col).groupBy(id_col).agg(
        *[F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in FIELDS],
        F.map_from_entries(F.collect_list(F.struct("field", "confidence"))).alias("confidence"),
    )
    return own.unionByName(rated)


