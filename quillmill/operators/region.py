"""Extraction where each part of a bill was scanned from its own region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import before, let
from quillmill.functions.numbers import first, parse_float, trim

# Shapes of registration numbers, telephones and mail addresses.
GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]"
PHONE = r"\b\d{10}\b|\b\d{5}[\s\-]?\d{5}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
TEMPLATE, UNKNOWN = "NEW_GOOD_NITS", "UNKNOWN"


def detect_template(text: Column) -> Column:
    hit = lambda up: F.contains(up, F.lit("NEW")) & F.contains(up, F.lit("GOOD")) & F.contains(up, F.lit("NITS"))
    own = F.coalesce(text, F.lit(""))
    return F.when(hit(own), TEMPLATE).when(let(F.upper(own), hit), TEMPLATE).otherwise(UNKNOWN)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), trim), lambda l: l != "")


def header(text: Column) -> Column:
    """struct(company_name, gstin, tin, pan, phones, address) of the seller."""
    return let(trim(F.coalesce(text, F.lit(""))), _header)


def _header(t: Column) -> Column:
    gstin = F.coalesce(first(t, r"(?i)\b(33[A-Z]{5}\d{4}[A-Z][0-9A-Z]{3}[A-Z0-9])\b"), first(t, r"(?i)\b(\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"))
    tin = F.coalesce(first(t, r"(?i)TIN\s*[:\-]?\s*(\d{9,15})"), first(t, r"\b(\d{9,12})\b"))
    pan = F.coalesce(first(t, r"(?i)PAN\s*[:\-]?\s*([A-Z]{5}\d{4}[A-Z])"), first(t, r"(?i)\b([A-Z]{5}\d{4}[A-Z])\b"))
    phones = F.transform(F.regexp_extract_all(t, F.lit(r"\b\d{5}[\s\-]?\d{5}\b"), F.lit(0)), lambda p: F.regexp_replace(p, r"\s", " "))
    def parts(lines: Column, gstin: Column, phones: Column) -> Column:
        known = F.get(F.filter(lines, lambda l: l.rlike(r"(?i)NEW\s*GOOD\s*NITS|KNITTING\s*INVOICE")), F.lit(0))

        def company(name: Column) -> Column:
            following = F.get(lines, F.array_position(lines, name).cast("int"))
            swap = name.rlike(r"(?i)^KNITTING\s*INVOICE") & following.rlike(r"(?i)NEW\s*GOOD")
            return F.coalesce(F.when(swap, F.regexp_replace(following, r"\s+", " ")).otherwise(name), F.get(lines, F.lit(0)))

        def ends(line: Column) -> Column:
            return F.coalesce(F.contains(line, gstin), F.lit(False)) | F.exists(phones, lambda p: F.contains(line, p))

        def address(name: Column) -> Column:
            after = F.slice(lines, F.array_position(lines, name).cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))
            marked = lambda a: F.get(F.filter(F.transform(a, lambda l, i: F.when(ends(l), i)), lambda i: i.isNotNull()), F.lit(0))
            upto = let(after, lambda a: F.slice(a, F.lit(1), F.coalesce(marked(a), F.size(a))))
            return F.when(name.isNotNull(), F.nullif(F.array_join(upto, ", "), F.lit("")))

        return let(let(F.regexp_replace(known, r"\s+", " "), company), lambda name: F.struct(
            name.alias("company_name"), gstin.alias("gstin"), tin.alias("tin"), pan.alias("pan"), phones.alias("phones"), address(name).alias("address")
        ))

    return let(_lines(t), lambda lines: let(gstin, lambda g: let(phones, lambda p: parts(lines, g, p))))


def bill_meta(text: Column) -> Column:
    """struct(bill_no, date, job_no, party_dc, invoice_type)."""
    dc = first(text, r"(?i)Party\s*DC\s*No\s*[:\-]?\s*(\S*)")
    return F.struct(
        first(text, r"No\s*[:\-]?\s*(\d{1,6})").alias("bill_no"),
        F.coalesce(first(text, r"\d{2}/\d{2}/\d{4}", 0), first(text, r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", 0)).alias("date"),
        first(text, r"(?i)Job\s*No\s*[:\-]?\s*(\d+)").alias("job_no"),
        F.when(dc != "-", dc).alias("party_dc"),
        first(text, r"(?i)(Tax\s*Invoice|Invoice|Bill|Receipt)").alias("invoice_type"),
    )


def customer(text: Column) -> Column:
    """struct(name, address, gst, state, phone, email); null where nothing is found."""
    gst = first(text, GSTIN, 0)
    lines = F.when(gst.isNotNull(), _lines(before(text, gst)))
    name = let(lines, lambda ls: F.when(F.size(ls) >= 3, F.try_element_at(ls, F.lit(-3))).otherwise(F.get(ls, F.lit(0))))
    part = let(lines, lambda ls: F.when(F.size(ls) >= 3, F.slice(ls, F.greatest(F.size(ls) - 2, F.lit(1)), F.lit(3))).otherwise(F.slice(ls, F.lit(2), F.lit(3))))
    state = F.coalesce(
        first(text, r"(?i)Tamil\s*Nadu\s*\((\d+)\)"), F.when(~text.rlike(r"(?i)Tamil\s*Nadu\s*\(\d+\)"), first(text, r"\((\d+)\)")),
        F.when(text.rlike(r"(?i)Tamil\s*Nadu"), F.lit("Tamil Nadu")),
    )
    return F.struct(
        name.alias("name"), F.nullif(F.array_join(part, " "), F.lit("")).alias("address"), gst.alias("gst"), state.alias("state"),
        F.regexp_replace(first(text, PHONE, 0), r"\s", "").alias("phone"), first(text, EMAIL, 0).alias("email"),
    )


def totals(text: Column) -> Column:
    """struct(subtotal, cgst, sgst, igst, rounded_off, net_total) of doubles: the last two decimals, and labelled taxes."""
    num = lambda c: parse_float(F.replace(c, F.lit(","), F.lit("")))
    values = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[\d,]+\.\d+"), F.lit(0)), num), lambda v: v < 1e8)
    tax = lambda w: num(first(text, r"(?i)" + w + r".*?([\d,]+\.\d+)"))
    # "Rounded Off" itself carries no number; only "Round Off" does.
    off = num(first(text, r"(?i)Rounded\s*Off|Round\s*Off.*?([\d,.\-]+)"))
    return F.struct(
        F.try_element_at(values, F.lit(-2)).alias("subtotal"), tax("CGST").alias("cgst"), tax("SGST").alias("sgst"), tax("IGST").alias("igst"),
        off.alias("rounded_off"), F.try_element_at(values, F.lit(-1)).alias("net_total"),
    )


def subtotal_check(table_sum: Column, subtotal: Column, tolerance: float = 5.0) -> Column:
    """True unless a subtotal is there and is further off than the tolerance."""
    return F.coalesce(F.abs(F.coalesce(table_sum, F.lit(0.0)) - subtotal) <= tolerance, F.lit(True))


def first_table(*tables: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """Of several tables of rows, in order of trust, each bill's rows from the first that has any."""
    both = None
    for rank, t in enumerate(tables):
        t = t.withColumn("source", F.lit(rank))
        both = t if both is None else both.unionByName(t, allowMissingColumns=True)
    best = both.groupBy(id_col).agg(F.min("source").alias("source"))
    return both.join(best, [id_col, "source"])


def form_fields(parsed: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, field, value) of all that a parsed region bill would fill into a form; empty values fill nothing."""
    from quillmill.functions.text import form_date

    values = {
        "billNo": F.col("bill_meta.bill_no"), "date": F.col("bill_meta.date"), "formDate": form_date(F.col("bill_meta.date")),
        "jobNo": F.col("bill_meta.job_no"), "partyDcNo": F.col("bill_meta.party_dc"), "invoiceType": F.col("bill_meta.invoice_type"),
        "customer": F.col("customer.name"), "customerAddress": F.col("customer.address"), "gst": F.col("customer.gst"),
        "customerState": F.col("customer.state"), "customerPhone": F.col("customer.phone"), "customerEmail": F.col("customer.email"),
        "subtotal": F.col("totals.subtotal"), "cgst": F.col("totals.cgst"), "sgst": F.col("totals.sgst"), "igst": F.col("totals.igst"),
        "roundedOff": F.col("totals.rounded_off"), "netTotal": F.col("totals.net_total"), "total": F.col("totals.net_total"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in values.items()])
    filled = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))
    return parsed.select(id_col, F.explode(filled).alias("p")).select(id_col, "p.field", "p.value")
