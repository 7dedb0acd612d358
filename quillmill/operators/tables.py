"""Line items from the lines of a bill's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import let
from quillmill.functions.numbers import parse_float, parse_repaired, trim

# What marks header, total and closing lines.
TOTAL_LINE = r"(?i)T[O0D]TAL|TOTAL"
HEADER_LINE = r"(?i)S\.?\s*No|D\.?\s*C\.?|Fabric|Wt\.?\s*Kgs|Rate|Amount|GG|COUNTS|MILL|DIA"
END_LINE = r"(?i)T[O0D]TAL|TOTAL|CGST|SGST|NET\s*T"
ITEM = ("sl_no", "dc", "date", "gg", "fabric", "counts", "mill", "dia", "weight", "rate", "amount")
NUMERIC = r"[\d,]+\.?[\dA-Za-z]*"


def numeric_tokens(line: Column) -> Column:
    """array<struct<t,v>>: tokens that start with digits, and their numeric prefix."""
    tokens = F.transform(
        F.regexp_extract_all(line, F.lit(NUMERIC), F.lit(0)),
        lambda t: F.struct(t.alias("t"), F.coalesce(parse_float(F.replace(t, F.lit(","), F.lit(""))), parse_repaired(t)).alias("v")),
    )
    return F.filter(tokens, lambda x: x["v"].isNotNull())


def is_row(tokens: Column) -> Column:
    return let(tokens, lambda k: F.coalesce((F.size(k) >= 2) & F.try_element_at(k, F.lit(-1))["v"].between(5e-324, 1e10), F.lit(False)))


def row_backward(line: Column, tokens: Column) -> Column:
    """The item of a line, read from its end: amount, rate, weight, and before them the leading columns."""
    at = lambda k: F.try_element_at(tokens, F.lit(-k))
    mark = F.coalesce(at(3)["t"], at(2)["t"])
    start = trim(F.substring(line, F.lit(1), F.instr(line, mark) - 1))
    lead = F.when(start == "", F.array().cast("array<string>")).otherwise(F.split(start, r"\s+"))

    def item(lead: Column) -> Column:
        n = F.size(lead)
        one = lambda i: F.get(lead, F.lit(i))
        end = lambda k: F.when(n >= 7, F.try_element_at(lead, F.lit(-k)))
        fabric = F.when(n >= 8, F.nullif(F.array_join(F.slice(lead, F.lit(5), F.greatest(n - 7, F.lit(0))), " "), F.lit("")))
        return F.struct(
            one(0).alias("sl_no"), one(1).alias("dc"), one(2).alias("date"), one(3).alias("gg"), fabric.alias("fabric"),
            end(3).alias("counts"), end(2).alias("mill"), end(1).alias("dia"),
            at(3)["v"].alias("weight"), at(2)["v"].alias("rate"), at(1)["v"].alias("amount"),
        )

    return let(lead, item)


def _first_line(text: Column, pattern: str) -> Column:
    """The number of the first line with a match, found in the whole text, where the search ends at the first one; null without."""
    def line(at: Column) -> Column:
        above = F.substring(text, F.lit(1), at - 1)
        return F.when(at > 0, F.length(above) - F.length(F.replace(above, F.lit("\n"), F.lit(""))))

    return let(F.regexp_instr(text, F.lit(pattern.replace(r"\s", r"[^\S\n]"))), line)


def with_items(bills: DataFrame, text_col: str = "text", name: str = "items") -> DataFrame:
    """bills with ``name``: an array of line items (line_ix, sl_no, ..., amount), null if there is none.

    Items stand between the first header line and the first total line; a bill
    without any there is read again from its first line.
    """
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda l, i: F.struct(i.alias("i"), trim(l).alias("l")))
    at = lambda pattern: _first_line(F.col(text_col), pattern)
    of = bills.withColumn("_l", lines).withColumn("_t_ix", F.coalesce(at(TOTAL_LINE), F.size("_l"))).withColumn("_h_ix", at(HEADER_LINE))

    def rows_from(start: Column) -> Column:
        """Item lines, with their numbers, from start to the first line that ends the table."""
        part = F.filter("_l", lambda x: (x["i"] >= start) & (x["i"] < F.col("_t_ix")) & (x["l"] != ""))
        first_end = lambda p: F.coalesce(F.get(F.filter(p, lambda x: x["l"].rlike(END_LINE)), F.lit(0))["i"], F.col("_t_ix"))
        body = let(part, lambda p: let(first_end(p), lambda stop: F.filter(p, lambda x: x["i"] < stop)))
        return F.filter(F.transform(body, lambda x: F.struct(x["i"].alias("i"), x["l"].alias("l"), numeric_tokens(x["l"]).alias("k"))), lambda x: is_row(x["k"]))

    of = of.withColumn("_a", rows_from(F.coalesce(F.col("_h_ix") + 1, F.lit(0))))
    of = of.withColumn("_a", F.when(F.col("_h_ix").isNull() | (F.size("_a") > 0), F.col("_a")).otherwise(rows_from(F.lit(0))))

    def item(x: Column) -> Column:
        return let(row_backward(x["l"], x["k"]), lambda r: F.struct(x["i"].alias("line_ix"), *[r[c].alias(c) for c in ITEM]))

    return of.withColumn(name, F.when(F.size("_a") > 0, F.transform("_a", item))).drop("_l", "_t_ix", "_h_ix", "_a")


def table_rows(bills: DataFrame, id_col: str = "bill_id", text_col: str = "text") -> DataFrame:
    """One row per line item: (id, line_ix, sl_no, ..., amount)."""
    rows = with_items(bills.select(id_col, F.col(text_col).alias("_text")), "_text", "_items")
    # The outer explode: for the inner one Spark would put the whole expression into a filter before it as well.
    return rows.select(id_col, F.explode_outer("_items").alias("_i")).filter(F.col("_i").isNotNull()).select(id_col, "_i.*")


def table_rows_plain(bills: DataFrame, id_col: str = "bill_id", text_col: str = "text") -> DataFrame:
    """(id, line_ix, weight, rate, amount): the last three numbers of every line that has three; commas are not read."""
    line = bills.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line_ix", "_l"))
    line = line.select(id_col, "line_ix", F.regexp_extract_all("_l", F.lit(r"\d+\.\d+|\d+"), F.lit(0)).alias("_n")).filter(F.size("_n") >= 3)
    at = lambda k: F.element_at("_n", -k).cast("double")
    return line.select(id_col, "line_ix", at(3).alias("weight"), at(2).alias("rate"), at(1).alias("amount"))
