"""Extraction for the known bill template, from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.columns import before, let
from quillmill.functions.numbers import first, parse_float, shown, to_number, trim
from quillmill.functions.text import iso_date_strict, normalize_lines, top_part
from quillmill.operators.tables import with_items

# Fixed values.
TEMPLATE = "NEW_GOOD_NITS"
POSTAL = ("641", "602", "604")
SELLER = "(?i)^33AAFFN"
BLEED = r"(?i)TIN\s*:|PAN\s*:|NEW\s*GOOD\s*NITS|KNITTING\s*INVOICE|Manikandan\s*Nagar|Dharapuram\s*Road"
HEADER_NAME = r"(?i)TIN\s*:|PAN\s*:|NEW\s*GOOD\s*NITS|KNITTING\s*INVOICE"
GST_NO = r"(?i)GST\s*No\s*[:\-]?\s*([A-Z0-9]{15})"
TO = r"(?:To|T0|T\s*o|7o)\.?\s*"


def detect_template(text: Column) -> Column:
    def hit(up: Column) -> Column:
        has = lambda w: F.contains(up, F.lit(w))
        return (has("NEW") & has("GOOD") & has("NITS")) | (has("KNITTING") & has("INVOICE") & (has("GOOD") | has("NEW"))) | (
            has("GOOD") & has("NITS") & has("TIRUPUR")
        )

    # What is in capitals stays so; only other texts have to be turned into capitals, once.
    own = F.coalesce(text, F.lit(""))
    return F.when(hit(own), F.lit(TEMPLATE)).when(let(F.upper(own), hit), F.lit(TEMPLATE))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), trim), lambda l: l != "")


def _without(lines: Column, line: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(lines, lambda l: l != line), ", "), F.lit(""))


def customer(text: Column) -> Column:
    """struct(name, address, gst_no, state); null if there is no customer.  Expects normalized text."""
    return let(text, lambda t: let(trim(F.coalesce(t, F.lit(""))), lambda full: let(
        F.regexp_extract_all(full, F.lit(GST_NO), F.lit(1)), lambda gsts: _customer(t, full, gsts)
    )))


def _customer(text: Column, full: Column, gsts: Column) -> Column:
    bleed = full.rlike(BLEED)
    one, seller = F.get(gsts, F.lit(0)), F.get(gsts, F.lit(0)).rlike(SELLER)

    def record(name: Column, address: Column, gst: Column, state: Column) -> Column:
        return F.struct(
            name.alias("name"), F.coalesce(address, F.lit("")).alias("address"), gst.alias("gst_no"), state.alias("state")
        )

    # 1. Header lines in the text and two numbers: what stands between "To" and a number.
    theirs = F.when(seller, F.get(gsts, F.lit(1))).otherwise(F.element_at(gsts, -1))
    to_block = F.regexp_extract(full, "(?is)" + TO + r"(.*?)(?=GST\s*No\s*[:\-]?\s*[A-Z0-9]{15})", 1)
    found = full.rlike("(?is)" + TO + r".*?(?=GST\s*No\s*[:\-]?\s*[A-Z0-9]{15})")
    # The text before the number that was chosen.
    upto = F.regexp_replace(before(full, theirs), r"(?i)GST\s*No\s*[:\-]?\s*\z", "")
    lines = _lines(F.when(found, to_block).otherwise(upto))
    state_re = r"(?i)STATE\s*[:\-]?\s*[^,\n]*\s*\((\d+)\)|Tamil\s*Nadu\s*\((\d+)\)|\((\d+)\)"
    named = lambda lines: F.get(F.filter(lines, lambda l: l.rlike("[A-Z]{2,}") & (F.length(l) <= 60) & ~l.rlike(r"TIN|PAN|GSTIN|^\d") & ~l.rlike(r"(?i)^M/s\s*\z")), F.lit(0))
    trade = lambda lines: F.get(F.filter(lines, lambda l: l.rlike(r"(?i)GARMENTS|TEXTILES|TRADERS|PVT|LTD|CO\.")), F.lit(0))
    # A match of any of the three ends with its number in brackets.
    state1 = F.when(F.contains(full, F.lit("(")), first(F.regexp_extract(full, state_re, 0), r"\((\d+)\)\z"))
    case1 = let(lines, lambda ls: let(named(ls), lambda name: record(
        F.coalesce(name, trade(ls), F.get(ls, F.lit(0))), F.when(name.isNull(), F.array_join(ls, ", ")).otherwise(_without(ls, name)), theirs, state1
    )))
    # 2. The first number, and up to six lines above it.
    pos = F.regexp_instr(text, F.lit(GST_NO))
    above = _lines(F.substring(text, F.lit(1), pos - 1))
    last6 = let(above, lambda ls: F.slice(ls, F.greatest(F.size(ls) - 5, F.lit(1)), F.lit(6)))
    capital = lambda above: F.get(F.filter(above, lambda l: (F.length(F.regexp_replace(l, "[^A-Z]", "")) >= 2) & (F.length(l) <= 80) & ~l.rlike(HEADER_NAME)), F.lit(0))
    other = lambda above: F.get(F.filter(above, lambda l: ~l.rlike("(?i)TIN|PAN|GSTIN")), F.lit(0))
    state2 = F.coalesce(
        first(text, r"(?i)\((\d+)\)|Tamil\s*Nadu"), F.when(text.rlike(r"(?i)\((\d+)\)|Tamil\s*Nadu"), F.lit("Tamil Nadu"))
    )
    case2 = let(last6, lambda ls: let(capital(ls), lambda name: record(
        F.coalesce(name, other(ls), F.get(ls, F.lit(0))),
        F.when(name.isNotNull(), _without(ls, name)).otherwise(F.array_join(F.slice(ls, F.lit(2), F.lit(6)), ", ")),
        F.regexp_extract(text, GST_NO, 1), state2,
    )))
    # 3. Shorter or longer numbers after "To".
    loose = "(?is)" + TO + r"(.*?)GST\s*No\s*[:\-]?\s*([A-Z0-9]{10,20})"
    block = _lines(F.regexp_extract(text, loose, 1))
    gst3 = F.regexp_extract(text, loose, 2)
    case3 = let(block, lambda ls: record(
        F.get(ls, F.lit(0)), F.array_join(F.slice(ls, F.lit(2), F.greatest(F.size(ls), F.lit(1))), ", "),
        first(text, r"(?i)GST\s*No\s*[:\-]?\s*([A-Z0-9]{10,20})"), first(text, r"\((\d+)\)"),
    ))
    return (
        F.when(bleed & (F.size(gsts) >= 2), case1)
        .when(bleed & (F.size(gsts) == 1) & seller, None)
        .when(F.size(gsts) >= 1, F.when(~(one.rlike(SELLER) & bleed), case2))
        .when((gst3 != "") & ~(bleed & (F.length(gst3) >= 15) & gst3.rlike(SELLER)), case3)
    )


def bill_meta(text: Column) -> Column:
    """struct(bill_no, date, job_no, party_dc_no, ref).  Expects normalized text."""
    full = trim(F.coalesce(text, F.lit("")))
    top = top_part(full, 40)
    number = r"\bNo\s*[:\-]?\s*(\d{2,4})\b"
    ok = lambda n: F.when(~n.isin(*POSTAL), n)
    lines = F.filter(F.split(top, "\n", -1), lambda l: ~l.rlike("(?i)GST|TIN|PAN|UDYAM|Phone") & ~l.rlike(r"\d{5}\s*\d{5}"))
    by_line = F.get(F.filter(F.transform(lines, lambda l: ok(first(l, number))), lambda n: n.isNotNull()), F.lit(0))
    loose = r"\b(\d{2,4})\b"
    near = F.substring(top, F.lit(1), F.regexp_instr(top, F.lit(loose)) - 1 + 30)
    any_number = F.when(~near.rlike("(?i)GST|TIN|PAN"), ok(first(top, loose)))
    return F.struct(
        F.coalesce(ok(first(full, number)), by_line, any_number).alias("bill_no"),
        first(full, r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}", 0).alias("date"),
        first(full, r"(?i)Job\s*No\.?\s*[:\-]?\s*(\d+)").alias("job_no"),
        first(full, r"(?i)Party\s*DC\s*No\.?\s*[:\-]?\s*(\S*)").alias("party_dc_no"),
        first(full, r"(?i)Ref\.?\s*[:\-]?\s*(\S*)").alias("ref"),
    )


def totals(text: Column) -> Column:
    """struct(subtotal, cgst, sgst, rounded_off, net_total) of strings; labels first, then sizes of the numbers."""
    def around(start: Column, net: Column) -> Column:
        block = (
            F.when((start > 0) & (net > start), F.substring(text, start, net + 120 - start))
            .when(start > 0, F.substring(text, start, F.lit(800))).otherwise(F.lit(""))
        )
        return F.when(net > 0, F.concat(block, F.lit("\n"), F.substring(text, net, F.lit(80)))).otherwise(block)

    at = lambda pattern: F.regexp_instr(text, F.lit(pattern))
    block = let(at(r"(?i)T[O0D]TAL|TOTAL"), lambda start: let(at(r"(?i)NET\s*T[O0D]?TAL"), lambda net: around(start, net)))
    tax = lambda w: (
        r"(?i)" + w + r"\s*2\.?5%?\s*[:\-]?\s*[\d.]+\s+([\d,.]+)|" + w + r"\s*2\.?5%?\s*[:\-]?\s*([\d,.]+)"
    )
    plain = lambda c: F.replace(c, F.lit(","), F.lit(""))

    def found(block: Column, values: Column, small: Column) -> Column:
        label = lambda p, *g: F.coalesce(*[first(block, p, i) for i in g])
        n = F.size(small)
        least = F.coalesce(F.get(F.filter(values, lambda v: (v < 1) & (v != 0)), F.lit(0)), F.try_element_at(values, F.lit(-1)))
        at = lambda i: shown(F.get(values, F.lit(i)))
        return F.struct(
            F.coalesce(
                plain(first(block, r"T[O0D]?TAL\s*[:\-]?\s*[\d.]+\s+([\d,.]+)")), plain(first(block, r"T[O0D]?TAL\s*[:\-]?\s*([\d,.]+)")), at(1), at(0)
            ).alias("subtotal"),
            plain(F.coalesce(label(tax("CGST"), 1, 2), shown(F.get(small, F.greatest(n - 2, F.lit(0)))))).alias("cgst"),
            plain(F.coalesce(label(tax("SGST"), 1, 2), shown(F.try_element_at(small, F.lit(-1))))).alias("sgst"),
            plain(F.coalesce(label(r"(?i)Rounded\s*Off\s*[:\-]?\s*([\d,.\-]+)", 1), shown(F.when(F.abs(least) < 10, least)))).alias("rounded_off"),
            plain(F.coalesce(label(r"(?i)NET\s*T[O0D]?TAL\s*[:\-]?\s*([\d,.]+)", 1), at(0))).alias("net_total"),
        )

    def sizes(block: Column) -> Column:
        values = F.transform(F.regexp_extract_all(block, F.lit(r"[\d,]+\.\d+"), F.lit(0)), lambda t: parse_float(plain(t)))
        return F.sort_array(F.filter(values, lambda v: (v < 1e7) & (v >= 0)), asc=False)

    return let(block, lambda b: let(sizes(b), lambda v: let(F.filter(v, lambda x: (x < 1000) & (x > 0)), lambda s: found(b, v, s))))


def parse_bills(bills: DataFrame, id_col: str = "bill_id", text_col: str = "text") -> DataFrame:
    """(id, template, error, customer, bill_meta, totals, items): all parts of each bill; unknown templates have an error."""
    text = normalize_lines(F.col(text_col))
    known = bills.select(id_col, detect_template(F.col(text_col)).alias("template"), text.alias("_t"))
    of = lambda c: F.when(F.col("template").isNotNull(), c)
    parts = known.select(
        id_col, "template", F.when(F.col("template").isNull(), "Unsupported invoice format").alias("error"),
        of(customer(F.col("_t"))).alias("customer"), of(bill_meta(F.col("_t"))).alias("bill_meta"), of(totals(F.col("_t"))).alias("totals"), of(F.col("_t")).alias("_t"),
    )
    return with_items(parts, "_t").drop("_t")


def parse_regions(regions: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """The same parts where each comes from its own region's text: header, customer, bill_meta, table, totals."""
    from quillmill.operators.region import header

    names = ("header", "customer", "bill_meta", "totals", "table")
    t = regions.select(id_col, *[normalize_lines(F.col(c)).alias(c) for c in names])
    parts = t.select(
        id_col, header(F.col("header")).alias("header"), customer(F.col("customer")).alias("customer"),
        bill_meta(F.col("bill_meta")).alias("bill_meta"), totals(F.col("totals")).alias("totals"), "table",
    )
    return with_items(parts, "table").drop("table")


def to_generic(parsed: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, bill_no, date, customer, gst, total, confidence map) of parsed bills; a field that is there has 0.9."""
    gst = to_number(F.col("totals.cgst")) + to_number(F.col("totals.sgst"))
    flat = parsed.select(
        id_col, F.coalesce("bill_meta.bill_no", F.lit("")).alias("bill_no"),
        F.coalesce(iso_date_strict(F.col("bill_meta.date")), F.lit("")).alias("date"),
        trim(F.concat_ws(", ", F.nullif("customer.name", F.lit("")), F.nullif("customer.address", F.lit("")))).alias("customer"),
        F.when(gst > 0, shown(gst)).otherwise("").alias("gst"),
        F.coalesce(F.replace("totals.net_total", F.lit(","), F.lit("")), F.lit("")).alias("total"),
    )
    fields = ("bill_no", "date", "customer", "gst", "total")
    return flat.withColumn("confidence", F.create_map(*[x for f in fields for x in (F.lit(f), F.when(F.col(f) != "", 0.9).otherwise(0.0))]))


def from_generic(bills: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """The parts of a generic bill; the tax is halved into cgst and sgst."""
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    half = shown(parse_float(none("gst")) / 2)
    return bills.select(
        id_col,
        F.struct(none("customer").alias("name"), F.lit("").alias("address"), F.lit(None).cast("string").alias("gst_no"), F.lit(None).cast("string").alias("state")).alias("customer"),
        F.struct(none("bill_no").alias("bill_no"), none("date").alias("date"), F.lit(None).cast("string").alias("job_no"), F.lit(None).cast("string").alias("party_dc_no")).alias("bill_meta"),
        F.struct(
            F.lit(None).cast("string").alias("subtotal"), half.alias("cgst"), half.alias("sgst"), F.lit(None).cast("string").alias("rounded_off"),
            F.replace(none("total"), F.lit(","), F.lit("")).alias("net_total"),
        ).alias("totals"),
    )
