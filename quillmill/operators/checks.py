"""Validation of bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.numbers import parse_float, to_number, trim

#: Tax rates in percent.
RATES = (5, 12, 18, 28)


def bill_errors(bill_no: Column, date: Column, customer: Column, total: Column, as_of: Column) -> Column:
    """array<string> of fields that are missing, not positive, or in the future of ``as_of`` (a date)."""
    blank = lambda c: trim(F.coalesce(c, F.lit(""))) == ""
    value = parse_float(total)
    found = F.array(
        F.when(blank(bill_no), "billNo: required"), F.when(blank(date), "date: required"), F.when(blank(customer), "customer: required"),
        F.when(F.coalesce(total, F.lit("")).isin("") | (value <= 0), "total: must be over 0"),
        F.when(F.try_to_date(date, "yyyy-MM-dd") > as_of, "date: in the future"),
    )
    return F.array_compact(found)


def bill_warnings(gst: Column, total: Column) -> Column:
    """array<string>: tax that is over 2 points from every rate, as a share of the total."""
    tax, whole = parse_float(gst), F.coalesce(parse_float(F.nullif(total, F.lit(""))), F.lit(1.0))
    percent = tax / F.nullif(whole, F.lit(0.0)) * 100
    off = F.array_min(F.array(*[F.abs(F.lit(float(r)) - percent) for r in RATES]))
    # The total less the tax and the tax again is the total, so that check of the two can only fail by rounding.
    again = F.abs(whole - ((whole - tax) + tax)) > 0.01
    return F.array_compact(F.array(F.when((tax > 0) & (off > 2), "gst: no standard rate"), F.when(again, "total: not subtotal and gst")))


def table_sum_ok(table_sum: Column, subtotal: Column) -> Column:
    return F.abs(F.coalesce(table_sum, F.lit(0.0)) - to_number(subtotal)) < 1


def gst_ok(subtotal: Column, cgst: Column, sgst: Column) -> Column:
    expected = to_number(subtotal) * 0.025
    return (F.abs(expected - to_number(cgst)) < 1) & (F.abs(expected - to_number(sgst)) < 1)


def net_total_ok(subtotal: Column, cgst: Column, sgst: Column, net: Column, rounded_off: Column) -> Column:
    expected = to_number(subtotal) + to_number(cgst) + to_number(sgst) + F.coalesce(to_number(rounded_off), F.lit(0.0))
    return F.abs(expected - to_number(net)) < 1


def validated(parsed: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, table_ok, gst_ok, net_ok, mismatch) of parsed bills with items."""
    total = F.aggregate(F.coalesce(F.col("items.amount"), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    t = lambda c: F.col(f"totals.{c}")
    out = parsed.select(
        id_col, table_sum_ok(total, t("subtotal")).alias("table_ok"), gst_ok(t("subtotal"), t("cgst"), t("sgst")).alias("gst_ok"),
        net_total_ok(t("subtotal"), t("cgst"), t("sgst"), t("net_total"), t("rounded_off")).alias("net_ok"),
    )
    return out.withColumn("mismatch", ~(F.col("table_ok") & F.col("gst_ok") & F.col("net_ok")))


def recalculated(items: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, subtotal, cgst, sgst, rounded_off, net_total) as decimals, from the amounts of the items."""
    money = "decimal(18,2)"
    out = items.groupBy(id_col).agg(F.sum(F.coalesce("amount", F.lit(0.0)).cast(money)).cast(money).alias("subtotal"))
    out = out.withColumn("cgst", F.round(F.col("subtotal") * F.lit("0.025").cast("decimal(4,3)"), 2).cast(money)).withColumn("sgst", F.col("cgst"))
    raw = (F.col("subtotal") + F.col("cgst") + F.col("sgst")).cast(money)
    whole = F.floor(raw + F.lit("0.5").cast("decimal(2,1)")).cast(money)
    return out.withColumn("rounded_off", (whole - raw).cast(money)).withColumn("net_total", whole)


def number_ok(text: Column) -> Column:
    """Empty, or a finite number that is not negative."""
    v = text.try_cast("double")
    return F.coalesce(text, F.lit("")).isin("") | F.coalesce((v >= 0) & (v < float("inf")) & ~F.isnan(v), F.lit(False))


def inline_status(field: str, text: Column) -> Column:
    """What a form says of a required field: ok, required, invalid date, or invalid amount.

    An amount is the longest numeric prefix, not negative; a date is an ISO date, as the form's field holds it.
    """
    v = trim(F.coalesce(text, F.lit("")))
    fails = {"date": (F.try_to_date(v, "yyyy-MM-dd").isNull(), "invalid date"), "total": (~F.coalesce(parse_float(v) >= 0, F.lit(False)), "invalid amount")}
    wrong, says = fails.get(field, (F.lit(False), ""))
    return F.when(v == "", "required").when(wrong, says).otherwise("ok")


def quality(resolution: Column, blur: Column, brightness: Column, contrast: Column, dpi: Column) -> Column:
    """struct(issues, poor) of five checks that are true where all is well; three issues are poor."""
    issues = sum((F.when(c, 0).otherwise(1) for c in (resolution, blur, brightness, contrast, dpi)), F.lit(0))
    return F.struct(issues.alias("issues"), (issues >= 3).alias("poor"))


def document_confidence(*regions: Column) -> Column:
    """The mean of the regions' confidences."""
    return sum(regions, F.lit(0.0)) / len(regions)
