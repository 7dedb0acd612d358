"""The queries over bills, and the same results in DuckDB SQL.

The oracles of extraction queries compute the truth from the tables the bills
were rendered from; they see no extraction pattern.  Where a result depends on
the text itself, the text is rendered in SQL too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import numbers as N
from quillmill.functions import text as T
from quillmill.operators import checks, generic, images, layouts, mobile, region, spatial, tables, template, votes
from quillmill.sources import rendered as R
from quillmill.sources import scans
from quillmill.sources import store as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- what the oracles share
LINES = """li AS (SELECT l_orderkey bill_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) rn,
  l_partkey, strftime(l_shipdate, '%d/%m/%Y') ship, p_name, p_size, replace(p_brand, '#', '') brand, l_quantity::decimal(18,3) qty,
  p_retailprice::decimal(18,2) price, l_extendedprice::decimal(18,2) amount FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BILLS = LINES + """,
b0 AS (SELECT bill_id, count(*) n, sum(amount)::decimal(18,2) sub, sum(qty)::decimal(18,3) qty FROM li GROUP BY 1),
b1 AS (SELECT *, round(sub * 0.025::decimal(4,3), 2)::decimal(18,2) tax FROM b0),
b2 AS (SELECT *, (sub + tax + tax)::decimal(18,2) rawsum FROM b1),
b AS (SELECT b2.*, floor(rawsum + 0.5)::decimal(18,2) net, (floor(rawsum + 0.5) - rawsum)::decimal(18,2) off,
  (1000 + bill_id % 9000)::varchar bill_no, strftime(o_orderdate, '%d/%m/%Y') bill_date, strftime(o_orderdate, '%Y-%m-%d') iso,
  upper(replace(c_name, '#', ' ')) cname, c_mktsegment seg, '33ABCDE' || lpad((c_custkey % 10000)::varchar, 4, '0') || 'F1Z' || (c_custkey % 10)::varchar gstin
  FROM b2 JOIN orders ON bill_id = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _text(net: str) -> str:
    return BILLS + f""",
tx AS (SELECT bill_id, array_to_string(['NEW GOOD NITS', 'GST No: 33AAFFN1234A1Z5', 'No: ' || bill_no, 'Date: ' || bill_date, 'To.', cname, seg, 'GST No: ' || gstin,
  'Job No: ' || bill_id, 'Sl No Particulars Wt Kgs Rate Amount', body, 'TOTAL ' || b.qty || ' ' || sub, 'CGST 2.5% ' || tax, 'SGST 2.5% ' || tax, 'Rounded Off ' || off, '{net} ' || net], chr(10)) txt
  FROM b JOIN (SELECT bill_id, string_agg(concat_ws(' ', rn, 'D' || l_partkey, ship, '24GG', p_name, p_size || 'S', brand, p_size || 'D', qty, price, amount), chr(10) ORDER BY rn) body FROM li GROUP BY 1) USING (bill_id))"""


TEXT = _text("NET TOTAL")
WORDS = _text("NETTOTAL") + """,
wl AS (SELECT bill_id, unnest(range(0, len(string_split(txt, chr(10))))) j, unnest(string_split(txt, chr(10))) line FROM tx),
wk AS (SELECT bill_id, j, line, unnest(range(0, len(string_split(line, ' ')))) k, unnest(string_split(line, ' ')) w FROM wl),
w AS (SELECT bill_id, j, row_number() OVER (PARTITION BY bill_id ORDER BY j, k) - 1 word_ix, w AS text,
  10.0::double * coalesce(list_sum(list_transform(string_split(line, ' ')[1:k], lambda x: length(x) + 1)), 0) x0, 30.0::double * j y0 FROM wk),
ws AS (SELECT *, x0 + 10 * length(text) x1, y0 + 12 y1, ((bill_id * 31 + word_ix * 17) % 101)::double confidence FROM w)"""
STORE = """st AS (SELECT o_orderkey id, (1000 + o_orderkey % 9000)::varchar billNo, strftime(o_orderdate, '%Y-%m-%d') date, c_name customer,
  round(o_totalprice::decimal(18,2) * 0.05::decimal(3,2), 2)::decimal(18,2) gst, o_totalprice::decimal(18,2) total, o_orderdate createdAt, o_orderstatus = 'F' synced,
  sha256(c_name || '|' || (o_orderkey % 500)) invoiceHash FROM orders JOIN customer ON o_custkey = c_custkey)"""
PASSES = STORE + """,
p0 AS (SELECT id bill_id, unnest(['billNo', 'date', 'customer', 'total']) field, unnest([billNo, date, customer, total::varchar]) v FROM st),
p AS (SELECT bill_id, pass, field, CASE WHEN (bill_id * 31 + pass * 17 + length(field)) % 10 < 3 THEN translate(v, '0158', 'OISB')
  WHEN (bill_id * 31 + pass * 17 + length(field)) % 10 = 3 THEN ' ' ELSE v END AS value FROM p0, (VALUES (0), (1), (2)) t(pass))"""
REPAIR = """CASE WHEN length(regexp_replace(trim(value), '[^A-Za-z]', '', 'g')) > length(regexp_replace(trim(value), '[^0-9]', '', 'g')) + 2
  THEN trim(value) ELSE translate(trim(value), 'OIlSB', '01158') END"""


def query(name: str, sql: str | None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


# ---- text and scalar functions
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LABELS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)\bT0TAL\b', 'TOTAL', 'g'), '(?i)\bGST\s*N0\b', 'GST No', 'g'), '(?i)\bGSTNO\b', 'GST No', 'g'), '\bNo\.', 'No:', 'g'), '(?i)\bG5T\b', 'GST', 'g')"


@query("norm_ocr_text", "SELECT doc_id, " + _LABELS.format(_TRIM.format("regexp_replace(replace(coalesce(text, ''), chr(13), ''), ' +', ' ', 'g')")) + " AS norm FROM documents")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.normalize_lines(F.col("text")).alias("norm"))


@query("norm_flat_text", "SELECT doc_id, " + _LABELS.format(r"regexp_replace(regexp_replace(" + _TRIM.format(r"regexp_replace(replace(coalesce(text, ''), chr(13), ''), '\s+', ' ', 'g')") + r", '(?i)\bTOIAL\b', 'TOTAL', 'g'), '(?i)\bTDTAL\b', 'TOTAL', 'g')") + " AS norm FROM documents")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.normalize_flat(F.col("text")).alias("norm"))


@query("mobile_clean_text", "SELECT doc_id, " + _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(text, '\n{2,}', chr(10), 'g'), '(?m)^\d+$', '', 'g'), '\n{2,}', chr(10), 'g')") + " AS clean, " + _TRIM.format(r"regexp_replace(replace(text, chr(10) || chr(10), chr(10)), ' +', ' ', 'g')") + " AS lines, " + _TRIM.format(r"regexp_replace(text, '\s+', ' ', 'g')") + " AS flat FROM documents")
def _(spark, d):
    t = F.col("text")
    return R.table(spark, d, "documents").select("doc_id", T.mobile_clean(t).alias("clean"), T.mobile_normalize(t).alias("lines"), T.mobile_flat(t).alias("flat"))


@query("repair_numeric", f"WITH {PASSES} SELECT bill_id, pass, field, {REPAIR} AS repaired FROM p")
def _(spark, d):
    return R.passes(spark, d).select("bill_id", "pass", "field", N.repair_numeric(F.col("value")).alias("repaired"))


@query("parse_repaired_number", f"WITH {PASSES} SELECT bill_id, pass, field, try_cast(nullif(regexp_extract({REPAIR}, '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)'), '') AS double) AS num FROM p WHERE field IN ('billNo', 'total')")
def _(spark, d):
    return R.passes(spark, d).filter("field IN ('billNo', 'total')").select("bill_id", "pass", "field", N.parse_repaired(F.col("value")).alias("num"))


@query("sha256_doc", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE sha256(text) END AS hash FROM documents")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.image_hash(F.col("text")).alias("hash"))


@query("date_to_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') a, '20' || strftime(o_orderdate, '%y-%m-%d') b, strftime(o_orderdate, '%Y-%m-%d') c, strftime(o_orderdate, '%Y-%m-%d') e, '20' || strftime(o_orderdate, '%d-%m-%y') f, day(o_orderdate) <= 12 g FROM orders")
def _(spark, d):
    day = lambda p: F.date_format("o_orderdate", p)
    return R.table(spark, d, "orders").select(
        "o_orderkey", T.iso_date(day("d/M/yyyy")).alias("a"), T.iso_date(day("d-M-yy")).alias("b"), T.iso_date_strict(day("d.M.yyyy")).alias("c"),
        T.form_date(day("dd/MM/yyyy")).alias("e"), T.form_date(day("dd/MM/yy")).alias("f"), T.is_date(day("yy/d/yyyy").substr(4, 99)).isNotNull().alias("g0"),
        T.is_date(day("M/d/yyyy")).alias("g"),
    ).drop("g0")


@query("word_bands", f"WITH {WORDS} SELECT bill_id, word_ix, CASE WHEN confidence < 60 THEN 'red' WHEN confidence < 80 THEN 'orange' ELSE 'green' END heat, CASE WHEN confidence > 0 THEN CASE WHEN confidence < 60 THEN 'red' WHEN confidence < 85 THEN 'orange' END END border, CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END badge, x0 / 2 * 300 / 600 shown_x FROM ws")
def _(spark, d):
    c = F.col("confidence")
    return R.bills_words(spark, d).select(
        "bill_id", "word_ix", T.heat_band(c).alias("heat"), T.border_band(c).alias("border"), T.badge_band(c).alias("badge"),
        T.rescale(F.col("x0"), F.lit(2.0), F.lit(300.0), F.lit(600.0)).alias("shown_x"),
    )


@query("fuzzy_total_words", f"WITH {BILLS} SELECT bill_id, 1::bigint totals, 1::bigint nets FROM b")
def _(spark, d):
    return R.bills_words(spark, d).groupBy("bill_id").agg(
        F.count_if(T.is_total(F.col("text"))).alias("totals"), F.count_if(T.is_net_total(F.col("text"))).alias("nets")
    )


@query("page_geometry", "SELECT p_partkey, p_size * 40 w, p_size * 50 h, least(p_size * 40 / 8.27::double, p_size * 50 / 11.69::double) dpi, p_size * 40 >= 400 AND least(p_size * 40 / 8.27::double, p_size * 50 / 11.69::double) >= 50 ok, p_size * 2000 * p_size >= 250000 enough, p_size * 2000 * p_size >= 1000000 better FROM part")
def _(spark, d):
    p = R.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("w"), (F.col("p_size") * 50).alias("h"))
    dpi, res = T.page_dpi(F.col("w"), F.col("h")), T.resolution(F.col("w"), F.col("h"))
    return p.select("p_partkey", "w", "h", dpi["dpi"].alias("dpi"), dpi["adequate"].alias("ok"), res["adequate"].alias("enough"), res["recommended"].alias("better"))


@query("labels_and_currency", "SELECT o_orderkey, '₹' || o_totalprice::decimal(18,2) money, trim(regexp_replace('netTotal' || o_orderstatus, '([A-Z])', ' \\1', 'g')) label, replace(replace(replace(replace(o_orderpriority || '<&\">', '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') html FROM orders")
def _(spark, d):
    return R.table(spark, d, "orders").select(
        "o_orderkey", N.currency(F.col("o_totalprice")).alias("money"), T.spaced_label(F.concat(F.lit("netTotal"), "o_orderstatus")).alias("label"),
        T.html_escape(F.concat("o_orderpriority", F.lit('<&">'))).alias("html"),
    )


# ---- the known template, from text
def _normalized(spark, d) -> DataFrame:
    """Bills with their text normalized once, before the extraction that names it many times."""
    return R.bills_text(spark, d).select("bill_id", T.normalize_lines(F.col("text")).alias("text"))


@query("bill_meta", f"WITH {BILLS} SELECT bill_id, bill_no, bill_date AS date, bill_id::varchar job_no FROM b")
def _(spark, d):
    return _normalized(spark, d).select("bill_id", template.bill_meta(F.col("text")).alias("m")).select("bill_id", "m.bill_no", "m.date", "m.job_no")


@query("bill_totals", f"WITH {BILLS} SELECT bill_id, sub subtotal, tax cgst, tax sgst, abs(off)::decimal(18,2) rounded_off, net net_total FROM b")  # the label takes a minus as its own, as a colon
def _(spark, d):
    t = _normalized(spark, d).select("bill_id", template.totals(F.col("text")).alias("t"))
    money = [F.col(f"t.{c}").try_cast("decimal(18,2)").alias(c) for c in ("subtotal", "cgst", "sgst", "rounded_off", "net_total")]
    return t.select("bill_id", *money)


@query("bill_customer", f"WITH {BILLS} SELECT bill_id, cname AS name, seg AS address, gstin gst_no FROM b")
def _(spark, d):
    return _normalized(spark, d).select("bill_id", template.customer(F.col("text")).alias("c")).select("bill_id", "c.name", "c.address", "c.gst_no")


@query("bill_header", f"WITH {BILLS} SELECT bill_id, 'NEW GOOD NITS' company_name, '33AAFFN1234A1Z5' gstin, right(cname, 9) tin, 0 phones FROM b")
def _(spark, d):
    h = _normalized(spark, d).select("bill_id", region.header(F.col("text")).alias("h"))
    return h.select("bill_id", "h.company_name", "h.gstin", "h.tin", F.size("h.phones").alias("phones"))


_ITEM = "rn::varchar sl_no, 'D' || l_partkey dc, ship AS date, '24GG' gg, p_name fabric, p_size || 'S' counts, brand mill, p_size || 'D' dia, qty::double weight, price::double rate, amount::double amount"


@query("table_rows", f"WITH {LINES} SELECT bill_id, {_ITEM} FROM li")
def _(spark, d):
    return tables.table_rows(R.bills_text(spark, d)).drop("line_ix")


@query("table_sum", f"WITH {BILLS} SELECT bill_id, n::bigint n_items, sub table_sum FROM b")
def _(spark, d):
    rows = tables.table_rows(R.bills_text(spark, d))
    return rows.groupBy("bill_id").agg(F.count("*").alias("n_items"), F.sum(F.col("amount").cast(R.MONEY)).cast(R.MONEY).alias("table_sum"))


@query("table_rows_plain", f"WITH {TEXT}, l AS (SELECT bill_id, unnest(string_split(txt, chr(10))) l FROM tx), n AS (SELECT bill_id, regexp_extract_all(l, '\\d+\\.\\d+|\\d+') n FROM l) SELECT bill_id, n[-3]::double weight, n[-2]::double rate, n[-1]::double amount FROM n WHERE len(n) >= 3")
def _(spark, d):
    return tables.table_rows_plain(R.bills_text(spark, d)).drop("line_ix")


@query("detect_template", f"WITH {BILLS} SELECT 'NEW_GOOD_NITS' AS known, 'NEW_GOOD_NITS' AS plain, count(*) n FROM b UNION ALL SELECT NULL, 'UNKNOWN', count(*) FROM customer")
def _(spark, d):
    both = R.bills_text(spark, d).select("text").union(R.table(spark, d, "customer").select("c_name"))
    return both.groupBy(template.detect_template(F.col("text")).alias("known"), region.detect_template(F.col("text")).alias("plain")).agg(F.count("*").alias("n"))


@query("parse_bills", f"WITH {BILLS} SELECT bill_id, 'NEW_GOOD_NITS' AS template, NULL::varchar error, bill_no, cname, net net_total, n::int n_items FROM b")
def _(spark, d):
    p = template.parse_bills(R.bills_text(spark, d))
    return p.select("bill_id", "template", "error", "bill_meta.bill_no", F.col("customer.name").alias("cname"), F.col("totals.net_total").cast(R.MONEY).alias("net_total"), F.size("items").alias("n_items"))


@query("parse_regions", f"WITH {BILLS} SELECT bill_id, bill_no, gstin gst_no, n::int n_items, net net_total FROM b")
def _(spark, d):
    part = lambda a, b: F.regexp_extract("text", f"(?s){a}(.*?){b}", 1)
    regions = R.bills_text(spark, d).select(
        "bill_id", part(r"\A", r"\nNo: ").alias("header"), part(r"\nTo\.\n", r"\nJob").alias("customer"), part("(?=No: [0-9]+\nDate)", r"\nTo\.").alias("bill_meta"),
        part("(?=Sl No)", r"\nTOTAL").alias("table"), part(r"(?=\nTOTAL)", r"\z").alias("totals"),
    )
    p = template.parse_regions(regions)
    return p.select("bill_id", "bill_meta.bill_no", "customer.gst_no", F.size("items").alias("n_items"), F.col("totals.net_total").cast(R.MONEY).alias("net_total"))


@query("structured_to_generic", f"WITH {BILLS} SELECT bill_id, bill_no, iso AS date, cname || ', ' || seg customer, (tax + tax)::decimal(18,2) gst, net total, 4.5::double confidence FROM b")
def _(spark, d):
    g = template.to_generic(template.parse_bills(R.bills_text(spark, d)))
    total = F.aggregate(F.map_values("confidence"), F.lit(0.0), lambda a, x: a + x)
    return g.select("bill_id", "bill_no", "date", "customer", F.col("gst").cast(R.MONEY).alias("gst"), F.col("total").cast(R.MONEY).alias("total"), total.alias("confidence"))


@query("generic_to_structured", f"WITH {STORE} SELECT id bill_id, customer AS name, billNo bill_no, gst::double / 2 cgst, total net_total FROM st")
def _(spark, d):
    b = R.store(spark, d).select(F.col("id").alias("bill_id"), F.col("billNo").alias("bill_no"), "date", "customer", F.col("gst").cast("string").alias("gst"), F.col("total").cast("string").alias("total"))
    s = template.from_generic(b)
    return s.select("bill_id", "customer.name", "bill_meta.bill_no", F.col("totals.cgst").cast("double").alias("cgst"), F.col("totals.net_total").cast(R.MONEY).alias("net_total"))


# ---- bills of unknown layout
_NUM = r"([\d,]+\.?\d*)"
_GENERIC = "".join([
    "coalesce(nullif(regexp_extract(txt, '(?i)(?:Invoice No)[\\s#:]*([A-Z0-9\\-]+)', 1), ''), nullif(regexp_extract(txt, '(?i)(?:Invoice|Bill|INV)[\\s#:]*No[.\\s#:]*([A-Z0-9\\-]+)', 1), ''), ",
    "nullif(regexp_extract(txt, '(?i)(?:Invoice|Bill)[\\s#:]*([A-Z0-9\\-]{4,})', 1), ''), nullif(regexp_extract(txt, '(?i)No[.\\s#:]*([A-Z0-9\\-]+)', 1), '')) bill_no, ",
    "iso AS date, replace(nullif(regexp_extract(txt, '(?i)(?:GST)[\\s:]*[₹$]?[\\s]*" + _NUM + "', 1), ''), ',', '') gst0, ",
    "replace(regexp_extract(txt, '(?i)(?:Total)[\\s:]*[₹$]?[\\s]*" + _NUM + "', 1), ',', '') total, ",
    "substr(trim(string_split(trim(regexp_extract(txt, '(?i)(?:To|Customer|Bill\\s*To)[\\s:]+([A-Z][A-Za-z\\s&]+?)(?:\\n|GST|Date|Invoice|Total|$)', 1)), chr(10))[1]), 1, 100) who",
])


@query("generic_bill", f"WITH {TEXT} SELECT bill_id, bill_no, date, total, gst0 AS gst, nullif(who, '') customer FROM (SELECT tx.bill_id, {_GENERIC} FROM tx JOIN (SELECT bill_id, iso FROM b) USING (bill_id))")
def _(spark, d):
    return generic.extract(R.bills_text(spark, d), generic.Rules().get("new-goo-nits")).select("bill_id", "bill_no", "date", "total", "gst", "customer")


@query("extract_any", f"WITH {BILLS} SELECT bill_id, bill_no, iso AS date, net total FROM b UNION ALL SELECT -c_custkey, c_custkey::varchar, NULL, (c_custkey * 10)::decimal(18,2) FROM customer")
def _(spark, d):
    own = R.table(spark, d, "customer").select(
        (-F.col("c_custkey")).alias("bill_id"), F.concat(F.lit("Invoice No: "), "c_custkey", F.lit("\nGrand Total: "), F.col("c_custkey") * 10).alias("text")
    )
    out = generic.extract_any(R.bills_text(spark, d).union(own), generic.Rules().get())
    return out.select("bill_id", "bill_no", "date", F.col("total").cast(R.MONEY).alias("total"))


# ---- mobile
def _mobile(name: str, column: str, sql: str, **variant):
    @query(name, f"WITH {BILLS} SELECT bill_id, {sql} AS value, 'high' AS confidence FROM b")
    def _(spark, d):
        return mobile.extract(R.bills_text(spark, d, **variant)).select("bill_id", f"{column}.value", f"{column}.confidence")


_mobile("mobile_invoice_no", "invoice_no", "bill_no")
_mobile("mobile_date", "date", "bill_date")
_mobile("mobile_gstin", "gst", "'33AAFFN1234A1Z5'")
_mobile("mobile_net_total", "total", "format('{:,.2f}', net::double)", commas=True)


@query("mobile_confidence", f"WITH {BILLS} SELECT bill_id, 'high' g, 'high' dt, 'high' i, 'high' t, 'low' missing FROM b")
def _(spark, d):
    m = mobile.extract(R.bills_text(spark, d, commas=True))
    return m.select(
        "bill_id", mobile.gst_confidence(F.col("gst.value")).alias("g"), mobile.date_confidence(F.col("date.value")).alias("dt"),
        mobile.invoice_confidence(F.col("invoice_no.value")).alias("i"), mobile.total_confidence(F.col("total.value")).alias("t"),
        mobile.gst_confidence(F.lit(mobile.NOT_FOUND)).alias("missing"),
    )


# ---- regions
@query("region_meta", f"WITH {TEXT} SELECT bill_id, regexp_extract(txt, 'No\\s*[:\\-]?\\s*(\\d{{1,6}})', 1) bill_no, regexp_extract(txt, '\\d{{2}}/\\d{{2}}/\\d{{4}}') AS date, bill_id::varchar job_no FROM tx")
def _(spark, d):
    return R.bills_text(spark, d).select("bill_id", region.bill_meta(F.col("text")).alias("m")).select("bill_id", "m.bill_no", "m.date", "m.job_no")


@query("region_totals", f"WITH {BILLS} SELECT bill_id, abs(off)::double subtotal, 2.5::double sgst, net::double net_total, NULL::double rounded_off FROM b")
def _(spark, d):
    t = R.bills_text(spark, d).select("bill_id", region.totals(F.col("text")).alias("t"))
    return t.select("bill_id", "t.subtotal", "t.sgst", "t.net_total", "t.rounded_off")


@query("region_customer", f"WITH {BILLS} SELECT bill_id, 'To. ' || cname || ' ' || seg || ' GST No:' AS address, gstin gst, cname AS name FROM b")
def _(spark, d):
    t = F.regexp_extract("text", r"(?s)(To\..*?)\nJob", 1)
    c = R.bills_text(spark, d).select("bill_id", region.customer(t).alias("c"))
    return c.select("bill_id", F.concat_ws(" ", F.lit("To."), "c.address").alias("address"), "c.gst", "c.name")


@query("region_validation", f"WITH {BILLS} SELECT bill_id, bill_id % 2 = 0 AS valid FROM b")
def _(spark, d):
    rows = tables.table_rows(R.bills_text(spark, d)).groupBy("bill_id").agg(F.sum("amount").alias("s"))
    return rows.select("bill_id", region.subtotal_check(F.col("s"), F.col("s") + F.when(F.col("bill_id") % 2 == 0, 4.0).otherwise(6.0)).alias("valid"))


@query("first_table", f"WITH {BILLS} SELECT bill_id, source::int source, count(*) n FROM (SELECT bill_id, 0 source FROM li UNION ALL SELECT -1 - l_orderkey, 1 FROM lineitem) GROUP BY 1, 2")
def _(spark, d):
    text = R.bills_text(spark, d)
    smart = spatial.table_rows_by_column(spatial.normalize_words(R.bills_pages(spark, d))).select("bill_id", "amount")
    lines = R.rendered_lines(spark, d).select((-1 - F.col("bill_id")).alias("bill_id"), F.col("amount").cast("double"))
    plain = tables.table_rows(text).select("bill_id", "amount").union(lines)
    return region.first_table(smart, plain).groupBy("bill_id", "source").agg(F.count("*").alias("n"))


# ---- words on the page
@query("word_confidence_filter", f"WITH {WORDS} SELECT bill_id, count(*) n FROM ws WHERE confidence > 45 GROUP BY 1")
def _(spark, d):
    return spatial.confident_words(R.bills_words(spark, d)).groupBy("bill_id").agg(F.count("*").alias("n"))


@query("words_in_top", f"WITH {WORDS} SELECT bill_id, count(*) n FROM (SELECT bill_id, y0, max(y1) OVER (PARTITION BY bill_id) + 50 page FROM ws) WHERE y0 < page * 28 / 100 GROUP BY 1")
def _(spark, d):
    return spatial.page_part(spatial.normalize_words(R.bills_words(spark, d)), 28).groupBy("bill_id").agg(F.count("*").alias("n"))


@query("word_rows_cluster", f"WITH {WORDS} SELECT bill_id, word_ix::int word_ix, j::bigint row_ix FROM ws")
def _(spark, d):
    return spatial.word_rows(spatial.normalize_words(R.bills_pages(spark, d)))


@query("spatial_table_rows", f"WITH {LINES} SELECT bill_id, {_ITEM} FROM li")
def _(spark, d):
    return spatial.table_rows(spatial.normalize_words(R.bills_pages(spark, d))).drop("row_ix")


@query("spatial_rows_plain", f"WITH {LINES} SELECT bill_id, qty::double weight, price::double rate, amount::double amount FROM li")
def _(spark, d):
    rows = spatial.table_rows_plain(spatial.normalize_words(R.bills_pages(spark, d))).drop("row_ix")
    return rows.join(R.rendered_lines(spark, d).select("bill_id").distinct(), "bill_id", "left_semi")


#: Totals from words: the decimals between TOTAL and the net total by size; the last two under 2000 are the taxes.
_SUMS = WORDS + """,
an AS (SELECT bill_id, min(CASE WHEN text = 'TOTAL' THEN y0 END) t, max(CASE WHEN text = 'NETTOTAL' THEN y0 END) n FROM ws GROUP BY 1),
dv AS (SELECT bill_id, list_sort(list(try_cast(regexp_extract(text, '^[0-9]+[.][0-9]*') AS double)), 'DESC') v FROM ws JOIN an USING (bill_id)
  WHERE y0 >= t - 5 AND y1 <= n + 85 AND regexp_matches(text, '^[0-9]+[.]') GROUP BY 1),
sums AS (SELECT bill_id, v[1] net_total, v[2] subtotal, coalesce(sm[greatest(len(sm) - 1, 1)], NULL) cgst, sm[len(sm)] sgst
  FROM (SELECT bill_id, v, list_filter(v, lambda x: x < 2000 AND x > 0) sm FROM dv))"""


def _numbers_of(*names: str) -> list:
    return [F.col(n).cast("double").alias(n.split(".")[-1]) for n in names]


@query("spatial_totals", f"WITH {_SUMS} SELECT bill_id, net_total, subtotal, cgst, sgst FROM sums")
def _(spark, d):
    t = spatial.totals(spatial.normalize_words(R.bills_pages(spark, d)))
    return t.select("bill_id", *_numbers_of("net_total", "subtotal", "cgst", "sgst"))


@query("spatial_bill_no", f"WITH {WORDS} SELECT bill_id, coalesce(min(w2.text), NULL) bill_no FROM (SELECT bill_id, min_by(text, word_ix) text FROM (SELECT bill_id, word_ix, text, y0, max(y1) OVER (PARTITION BY bill_id) + 50 page FROM ws) WHERE y0 < page * 28 / 100 AND regexp_full_match(text, '\\d{{1,6}}') GROUP BY 1) w2 GROUP BY 1")
def _(spark, d):
    return spatial.bill_numbers(spatial.normalize_words(R.bills_pages(spark, d))).filter("bill_no IS NOT NULL")


@query("spatial_customer", f"WITH {BILLS} SELECT bill_id, 'NEW GOOD NITS' AS name, '' AS address, '33AAFFN1234A1Z5' gst_no FROM b")
def _(spark, d):
    return spatial.customers(spatial.normalize_words(R.bills_pages(spark, d))).select("bill_id", "name", "address", "gst_no")


@query(
    "spatial_merge",
    f"WITH {_SUMS} SELECT b.bill_id, bill_no, b.bill_id::varchar job_no, n::int n_items, 'NEW GOOD NITS' AS name, '33AAFFN1234A1Z5' gst_no, sums.net_total, sums.subtotal, "
    "sums.cgst, sums.sgst, NULL::double rounded_off FROM b JOIN sums USING (bill_id)",
)
def _(spark, d):
    m = spatial.merge(template.parse_bills(R.bills_text(spark, d)), R.bills_pages(spark, d))
    sums = _numbers_of(*[f"totals.{c}" for c in ("net_total", "subtotal", "cgst", "sgst", "rounded_off")])
    return m.select("bill_id", "bill_meta.bill_no", "bill_meta.job_no", F.size("items").alias("n_items"), "customer.name", "customer.gst_no", *sums)


#: Words in the order they were written.  "No:" is no label; the "No" of the heading "Sl No" is one where it lies in the top 28 %, in bills of many items.
_ZONES = WORDS + """,
an AS (SELECT bill_id, min(CASE WHEN text = 'TOTAL' THEN y0 END) t, max(CASE WHEN text = 'NETTOTAL' THEN y0 END) n,
  min_by(y0 + 6, word_ix) FILTER (regexp_full_match(text, '[0-9]{2}[A-Z][A-Z0-9]{10,14}')) g FROM ws GROUP BY 1),
tp AS (SELECT * FROM (SELECT *, max(y1) OVER (PARTITION BY bill_id) + 50 page FROM ws) WHERE y0 < page * 28 / 100),
ln AS (SELECT bill_id, j, string_agg(text, ' ' ORDER BY word_ix) line FROM tp GROUP BY 1, 2),
lb AS (SELECT bill_id, word_ix label, beside FROM (SELECT *, lead(word_ix) OVER (PARTITION BY bill_id, j ORDER BY x0) beside FROM tp) JOIN ln USING (bill_id, j)
  WHERE regexp_full_match(text, '(?i)(No[.]?|T0)') AND beside IS NOT NULL AND NOT regexp_matches(line, '(?i)GST[[:space:]]*No')
  QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY word_ix) = 1)"""


def _and_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of bills, and for each a further one whose number has a label of its own: "No." and the number, above a low total."""
    words = (("No.", 0.0, 0.0), ("1234", 50.0, 0.0), ("foot", 0.0, 600.0), ("TOTAL", 0.0, 300.0))
    for own in R.in_pages(batches):
        yield own
        kind = own.schema.field("words").type.value_type
        page = pa.array([{"word_ix": i, "text": t, "x0": x, "y0": y, "x1": x + 30, "y1": y + 12} for i, (t, x, y) in enumerate(words)], kind)
        at = np.arange(own.num_rows * len(words)) % len(words)
        off = np.arange(own.num_rows + 1) * len(words)
        ids = pc.subtract(pa.scalar(-1, own.column(0).type), own.column(0))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(off, pa.int32()), page.take(pa.array(at)))], own.schema.names)


@query(
    "spatial_zones",
    f"WITH {_ZONES} SELECT bill_id, 'customer' AS zone, NULL::bigint row_ix, x0, y0, x1, y1 FROM ws JOIN an USING (bill_id) WHERE y0 + 6 < g - 5 "
    "UNION ALL SELECT bill_id, 'totals', NULL, x0, y0, x1, y1 FROM ws JOIN an USING (bill_id) WHERE y0 >= t - 5 AND y1 <= n + 85 "
    "UNION ALL SELECT bill_id, 'table', j, x0, y0, x1, y1 FROM ws JOIN an USING (bill_id) WHERE y0 + 6 < t - 20 "
    "UNION ALL SELECT bill_id, 'bill_no', NULL, x0, y0, x1, y1 FROM ws JOIN lb USING (bill_id) WHERE word_ix IN (label, beside) "
    "UNION ALL SELECT -1 - bill_id, 'bill_no', NULL, k * 50.0, 0.0, k * 50.0 + 30, 12.0 FROM b, (VALUES (0), (1)) v(k) "
    "UNION ALL SELECT -1 - bill_id, 'table', 0, k * 50.0, 0.0, k * 50.0 + 30, 12.0 FROM b, (VALUES (0), (1)) v(k)",
)
def _(spark, d):
    found = spatial.zones(R.bills_text(spark, d, one_word_net=True), _and_further)
    return found.filter((F.col("bill_id") >= 0) | F.col("zone").isin("bill_no", "table"))


@query("text_of_words", "WITH " + _text("NETTOTAL") + " SELECT bill_id, txt AS text FROM tx")
def _(spark, d):
    return scans.text_of_words(R.bills_words(spark, d))


# ---- votes and confidences
_VOTED = PASSES + """,
vc AS (SELECT bill_id, field, value, count(*) n, min(pass) f, CASE WHEN regexp_full_match(value, '0|[1-9]\\d{0,9}') AND value::bigint < 4294967295 THEN value::bigint END num FROM p WHERE trim(value) <> '' GROUP BY 1, 2, 3),
vr AS (SELECT *, row_number() OVER (PARTITION BY bill_id, field ORDER BY n DESC, num IS NULL, num, f) r, sum(n) OVER (PARTITION BY bill_id, field) alln FROM vc),
v AS (SELECT a.bill_id, a.field, coalesce(value, '') AS value, coalesce(n::double / alln::double, 0) confidence FROM (SELECT DISTINCT bill_id, field FROM p) a LEFT JOIN (SELECT * FROM vr WHERE r = 1) USING (bill_id, field))"""


@query("vote_fields", f"WITH {_VOTED} SELECT * FROM v")
def _(spark, d):
    return votes.vote(R.passes(spark, d))


@query("vote_confidence", f"WITH {_VOTED} SELECT bill_id, round(avg(confidence), 9) overall FROM v GROUP BY 1")
def _(spark, d):
    return votes.vote_confidence(votes.vote(R.passes(spark, d))).withColumn("overall", F.round("overall", 9))


_RATED = _VOTED + ", rt AS (SELECT bill_id, field, value, confidence < 0.7 needs_review, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END status, floor(confidence * 100 + 0.5) / 100 confidence FROM v)"


@query("rated_fields", f"WITH {_RATED} SELECT * FROM rt")
def _(spark, d):
    return votes.rated(votes.vote(R.passes(spark, d)))


@query("field_lookup", f"WITH {_RATED} SELECT bill_id, field, coalesce(confidence, 0) confidence, coalesce(needs_review, true) needs_review, coalesce(status, 'unknown') status FROM (SELECT id bill_id, unnest(['total', 'gst']) field FROM st) a LEFT JOIN rt USING (bill_id, field)")
def _(spark, d):
    wanted = R.store(spark, d).select(F.col("id").alias("bill_id"), F.explode(F.array(F.lit("total"), F.lit("gst"))).alias("field"))
    return votes.looked_up(wanted, votes.rated(votes.vote(R.passes(spark, d))), ["bill_id", "field"])


@query("overall_confidence", f"WITH {_RATED}, o AS (SELECT bill_id, floor(avg(confidence) * 100 + 0.5) / 100 average, coalesce(string_agg(field, ',' ORDER BY field) FILTER (needs_review), '') low, count(*) FILTER (needs_review) k, count(*) total_fields FROM rt GROUP BY 1) SELECT bill_id, average, low, k > 0 needs_review, total_fields, average * 100 < 50 OR k >= 3 poor FROM o")
def _(spark, d):
    o = votes.overall(votes.rated(votes.vote(R.passes(spark, d))))
    return o.select("bill_id", "average", F.array_join("low_fields", ",").alias("low"), "needs_review", "total_fields", "poor")


@query("field_confidence", f"WITH {WORDS}, f AS (SELECT bill_id, unnest(['bill_no', 'name']) field, unnest([bill_no, cname]) v FROM b) SELECT f.bill_id, field, round(coalesce(avg(confidence) / 100, 0.5), 9) confidence FROM f LEFT JOIN ws ON f.bill_id = ws.bill_id AND (contains(lower(v), lower(text)) OR contains(lower(text), lower(v))) GROUP BY 1, 2")
def _(spark, d):
    own = R.table(spark, d, "orders").join(R.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fields = own.select(F.col("o_orderkey").alias("bill_id"), F.explode(F.array(
        F.struct(F.lit("bill_no").alias("field"), (1000 + F.col("o_orderkey") % 9000).cast("string").alias("value")),
        F.struct(F.lit("name").alias("field"), F.upper(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("value")),
    )).alias("f")).select("bill_id", "f.*")
    words = R.bills_words(spark, d)
    fields = fields.join(words.select("bill_id").distinct(), "bill_id", "left_semi")
    return votes.field_confidence(fields, words).select("bill_id", "field", F.round("confidence", 9).alias("confidence"))


# ---- checks
@query("validate_bill", f"WITH {STORE} SELECT id, concat_ws('; ', CASE WHEN id % 7 = 0 THEN 'customer: required' END, CASE WHEN total <= 0 THEN 'total: must be over 0' END, CASE WHEN date::date > DATE '1996-06-30' THEN 'date: in the future' END) AS errors FROM st")
def _(spark, d):
    s = R.store(spark, d).withColumn("customer", F.when(F.col("id") % 7 != 0, F.col("customer")))
    e = checks.bill_errors(F.col("billNo"), F.col("date"), F.col("customer"), F.col("total").cast("string"), F.to_date(F.lit("1996-06-30")))
    return s.select("id", F.array_join(e, "; ").alias("errors"))


@query("validate_gst_rate", f"WITH {STORE}, x AS (SELECT id, total::double t, gst::double * (1 + id % 5) g FROM st) SELECT id, g > 0 AND least(abs(5 - g / t * 100), abs(12 - g / t * 100), abs(18 - g / t * 100), abs(28 - g / t * 100)) > 2 off FROM x")
def _(spark, d):
    s = R.store(spark, d).withColumn("g", F.col("gst").cast("double") * (1 + F.col("id") % 5))
    return s.select("id", F.exists(checks.bill_warnings(F.col("g").cast("string"), F.col("total").cast("string")), lambda w: F.startswith(w, F.lit("gst"))).alias("off"))


@query("validate_parsed", f"WITH {BILLS} SELECT bill_id, true table_ok, true gst_ok, abs(sub::double + tax::double + tax::double + abs(off)::double - net::double) < 1 net_ok, NOT net_ok AS mismatch FROM b")
def _(spark, d):
    return checks.validated(template.parse_bills(R.bills_text(spark, d)))


@query("recalc_totals", f"WITH {BILLS} SELECT bill_id, sub subtotal, tax cgst, tax sgst, off rounded_off, net net_total FROM b")
def _(spark, d):
    return checks.recalculated(R.rendered_lines(spark, d))


@query("number_check", f"WITH {PASSES} SELECT bill_id, pass, field, try_cast(value AS double) IS NOT NULL AND coalesce(try_cast(value AS double), -1) >= 0 AS ok FROM p WHERE field = 'total'")
def _(spark, d):
    return R.passes(spark, d).filter("field = 'total'").select("bill_id", "pass", "field", checks.number_ok(F.col("value")).alias("ok"))


@query("inline_form", f"""WITH {PASSES}, t AS (SELECT bill_id, pass, field, trim(value) v FROM p)
SELECT bill_id, pass, field, CASE WHEN v = '' THEN 'required' WHEN field = 'date' AND try_strptime(v, '%Y-%m-%d') IS NULL THEN 'invalid date'
  WHEN field = 'total' AND NOT regexp_matches(v, '^[0-9.]') THEN 'invalid amount' ELSE 'ok' END AS status FROM t""")
def _(spark, d):
    fields = ("billNo", "date", "customer", "total")
    status = F.coalesce(*[F.when(F.col("field") == f, checks.inline_status(f, F.col("value"))) for f in fields])
    return R.passes(spark, d).select("bill_id", "pass", "field", status.alias("status"))


@query("document_confidence", f"WITH {WORDS}, q AS (SELECT bill_id, word_ix % 5 q, avg(confidence) / 100 c FROM ws GROUP BY 1, 2) SELECT bill_id, round(avg(c), 9) confidence FROM q GROUP BY 1")
def _(spark, d):
    w = R.bills_words(spark, d)
    q = w.groupBy("bill_id").agg(*[(F.avg(F.when(F.col("word_ix") % 5 == i, F.col("confidence"))) / 100).alias(f"c{i}") for i in range(5)])
    return q.select("bill_id", F.round(checks.document_confidence(*[F.col(f"c{i}") for i in range(5)]), 9).alias("confidence"))


# ---- stored records
@query("duplicate_bill_no", f"WITH {STORE} SELECT id FROM st WHERE billNo IN (SELECT billNo FROM st GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):
    return S.duplicates(R.store(spark, d), "billNo").select("id")


@query("duplicate_hash", f"WITH {STORE} SELECT id FROM st WHERE invoiceHash IN (SELECT invoiceHash FROM st GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):
    return S.duplicates(R.store(spark, d), "invoiceHash").select("id")


@query("dedup_keep_first", f"WITH {STORE} SELECT id, billNo FROM st QUALIFY row_number() OVER (PARTITION BY billNo ORDER BY createdAt, id) = 1")
def _(spark, d):
    return S.first_of_each(R.store(spark, d)).select("id", "billNo")


_UPSERT = STORE + """, old AS (SELECT * FROM st WHERE id % 3 <> 0), new AS (SELECT * FROM st WHERE id % 3 = 0),
clash AS (SELECT DISTINCT new.id FROM new JOIN old USING (billNo)), ok AS (SELECT * FROM new WHERE id NOT IN (SELECT id FROM clash) QUALIFY row_number() OVER (PARTITION BY billNo ORDER BY createdAt, id) = 1)"""


def _halves(spark, d):
    s = R.store(spark, d)
    return s.filter("id % 3 <> 0"), s.filter("id % 3 = 0")


@query("delete_bills", f"WITH {STORE} SELECT id FROM st WHERE id % 11 <> 0")
def _(spark, d):
    s = R.store(spark, d)
    return S.delete(s, s.filter("id % 11 = 0")).select("id")


@query("search_records", f"WITH {STORE} SELECT id FROM st WHERE contains(lower(billNo), '12') OR contains(lower(customer), '12') OR contains(strftime(date::date, '%-m/%-d/%Y'), '12')")
def _(spark, d):
    return S.search(R.store(spark, d), "12").select("id")


@query("filter_records", f"WITH {STORE} SELECT id FROM st WHERE (contains(billNo, '77') OR contains(customer, '77') OR contains(strftime(date::date, '%-m/%-d/%Y'), '77')) AND NOT synced")
def _(spark, d):
    return S.filtered(R.store(spark, d), "77", "pending").select("id")


@query("filter_sync", f"WITH {STORE} SELECT id FROM st WHERE synced")
def _(spark, d):
    return S.filter_sync(R.store(spark, d), "synced").select("id")


@query("recent_records", f"WITH {STORE} SELECT id FROM st ORDER BY createdAt DESC, id LIMIT 50")
def _(spark, d):
    return S.newest_first(R.store(spark, d), 50).select("id")


@query("export_projection", f"WITH {STORE} SELECT billNo AS \"Bill No\", date AS \"Date\", customer AS \"Customer\", gst AS \"GST\", total AS \"Total\", strftime(createdAt, '%Y-%m-%d %H:%M:%S') AS \"Created At\", CASE WHEN synced THEN 'Yes' ELSE 'No' END AS \"Synced\" FROM st")
def _(spark, d):
    return S.export_rows(R.store(spark, d))


@query("analytics_tiles", f"WITH {STORE} SELECT count(*) records, count(*) FILTER (synced) synced, count(*) FILTER (NOT synced) pending, '100%' success FROM st")
def _(spark, d):
    return S.tiles(R.store(spark, d))


# ---- layouts
_ANCHORS = WORDS + """, up AS (SELECT *, upper(text) u FROM ws), an AS (
SELECT bill_id, 'customer' AS anchor, max_by(x0, word_ix) x, max_by(y0, word_ix) y FROM up WHERE u = 'TO' GROUP BY 1
UNION ALL SELECT bill_id, 'total', max_by(x0, word_ix), max_by(y0, word_ix) FROM up WHERE contains(u, 'TOTAL') AND NOT contains(u, 'NET') GROUP BY 1
UNION ALL SELECT bill_id, 'netTotal', max_by(x0, word_ix), max_by(y0, word_ix) FROM up WHERE contains(u, 'TOTAL') AND contains(u, 'NET') GROUP BY 1
UNION ALL SELECT bill_id, 'billNo', min_by(x0, word_ix), min_by(y0, word_ix) FROM up WHERE u = 'NO' GROUP BY 1)"""


@query("anchors", f"WITH {_ANCHORS} SELECT * FROM an")
def _(spark, d):
    return layouts.anchors(R.bills_words(spark, d))


_LAYOUTS = _ANCHORS + """, hh AS (SELECT bill_id, max(y1) + 50 h FROM ws GROUP BY 1), cy AS (SELECT hh.bill_id, 0.18::double c,
  (SELECT y FROM an WHERE an.bill_id = hh.bill_id AND anchor = 'total') / h t FROM hh),
ly AS (SELECT bill_id, unnest(['header', 'customer', 'billMeta', 'table', 'totals']) region, unnest([0, c, c, c + 0.18, greatest(0.7, t - 0.05)]) y,
  unnest([c, 0.18, 0.18, greatest(0.35, (t - 0.05) - (c + 0.18)), least(0.2, 1 - (t - 0.05))]) h FROM cy)"""


def _learned(spark, d):
    words = R.bills_words(spark, d)
    heights = words.groupBy("bill_id").agg((F.max("y1") + 50).alias("height"))
    return layouts.layouts_of(layouts.anchors(words), heights)


@query("layout_from_anchors", f"WITH {_LAYOUTS} SELECT bill_id, region, round(y, 9) y, round(h, 9) h FROM ly")
def _(spark, d):
    return _learned(spark, d).select("bill_id", "region", F.round("y", 9).alias("y"), F.round("h", 9).alias("h"))


@query("average_layout", f"WITH {_LAYOUTS} SELECT region, round(avg(y), 6) y, round(avg(h), 6) h, CASE WHEN region = 'customer' THEN 0.0 WHEN region = 'billMeta' THEN 0.6 END::double x FROM ly GROUP BY 1")
def _(spark, d):
    words = R.bills_words(spark, d)
    heights = words.groupBy("bill_id").agg((F.max("y1") + 50).alias("height"))
    return layouts.train(words, heights).select("region", F.round("y", 6).alias("y"), F.round("h", 6).alias("h"), F.round("x", 6).alias("x"))


def _layout_values() -> str:
    return ", ".join(str(r) for r in layouts.CROP_LAYOUT)


@query("region_geometry", f"SELECT p_partkey, region, sx::int sx, sy::int sy, sw::int sw, sh::int sh FROM (SELECT p_partkey, region, floor(l * w + 0.5) sx, floor(t * h + 0.5) sy, floor((r - l) * w + 0.5) sw, floor((b - t) * h + 0.5) sh FROM (SELECT p_partkey, p_size * 40 w, p_size * 50 h FROM part), (SELECT region, t::double t, b::double b, l::double l, r::double r FROM (VALUES {_layout_values()}) v(region, t, b, l, r))) WHERE sw > 0 AND sh > 0")
def _(spark, d):
    pages = R.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 50).alias("height"))
    layout = spark.createDataFrame(list(layouts.CROP_LAYOUT), "region string, top double, bottom double, left double, right double")
    return layouts.crop_boxes(pages, layout).select("p_partkey", "region", "sx", "sy", "sw", "sh")


def _sql_rows(rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows) + ")"


@query("region_crops", f"""WITH pg AS (SELECT p_partkey, p_size * 41 w, p_size * 53 h FROM part),
a AS (SELECT region, t::double t, b::double b, l::double l, r::double r FROM {_sql_rows(layouts.PAGE_LAYOUT)} v(region, t, b, l, r)),
c AS (SELECT region, y::double y, hh::double hh, x::double x, ww::double ww FROM {_sql_rows(layouts.TRAINED)} v(region, y, hh, x, ww))
SELECT p_partkey, 'plain' AS how, region, coalesce(l * w, 0) sx, t * h sy, greatest(1, floor(coalesce(r * w, w) - coalesce(l * w, 0) + 0.5))::int out_w, greatest(1, floor(b * h - t * h + 0.5))::int out_h FROM pg, a
UNION ALL SELECT p_partkey, 'trained', region, coalesce(x * w, 0), y * h, CASE WHEN ww IS NULL THEN w ELSE greatest(1, floor(ww * w + 0.5)) END::int, greatest(1, floor(hh * h + 0.5))::int FROM pg, c""")
def _(spark, d):
    pages = R.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 41).alias("width"), (F.col("p_size") * 53).alias("height"))
    plain = layouts.crop_plain(pages, spark.createDataFrame(list(layouts.PAGE_LAYOUT), "region string, top double, bottom double, left double, right double"))
    trained = layouts.crop_trained(pages, spark.createDataFrame(list(layouts.TRAINED), layouts.LAYOUT))
    each = [x.select("p_partkey", F.lit(n).alias("how"), "region", "sx", "sy", "out_w", "out_h") for n, x in (("plain", plain), ("trained", trained))]
    return each[0].union(each[1])


@query("route_words", f"WITH {WORDS}, pg AS (SELECT bill_id, max(x1) + 50 w, max(y1) + 50 h FROM ws GROUP BY 1), v AS (SELECT region, t::double t, b::double b, l::double l, r::double r FROM (VALUES {_layout_values()}) v(region, t, b, l, r)) SELECT ws.bill_id, region, count(*) n FROM ws JOIN pg USING (bill_id) JOIN v ON (y0 + y1) / 2 / h >= t AND (y0 + y1) / 2 / h < b AND (x0 + x1) / 2 / w >= l AND (x0 + x1) / 2 / w < r GROUP BY 1, 2")
def _(spark, d):
    words = R.bills_words(spark, d)
    pages = words.groupBy("bill_id").agg((F.max("x1") + 50).alias("width"), (F.max("y1") + 50).alias("height"))
    layout = spark.createDataFrame(list(layouts.CROP_LAYOUT), "region string, top double, bottom double, left double, right double")
    return layouts.route_words(words, pages, layout).groupBy("bill_id", "region").agg(F.count("*").alias("n"))


# ---- pixels
PIXELS = """px AS (SELECT p_partkey AS id, y, x, ((x * p_size + y * 7 + p_partkey) % 256)::int v
  FROM part, (SELECT unnest(range(12)) y), (SELECT unnest(range(16)) x))"""


def _otsu(pixels: str) -> str:
    """ot (id, otsu): of a table of pixels (id, v), 192 of each picture."""
    return f"""hi AS (SELECT i.id, t, count(v) h FROM (SELECT DISTINCT id FROM {pixels}) i CROSS JOIN (SELECT unnest(range(256)) t) LEFT JOIN {pixels} p ON p.id = i.id AND v = t GROUP BY 1, 2),
cu AS (SELECT id, t, (sum(h) OVER w)::double under, (sum(h * t) OVER w)::double mass, (sum(h * t) OVER (PARTITION BY id))::double whole FROM hi WINDOW w AS (PARTITION BY id ORDER BY t)),
va AS (SELECT id, t, CASE WHEN under > 0 AND under < 192 THEN (under * (192 - under)) * ((mass / under - (whole - mass) / (192 - under)) * (mass / under - (whole - mass) / (192 - under))) ELSE -1 END b FROM cu),
ot AS (SELECT id, greatest(1, least(254, t))::int otsu FROM va QUALIFY row_number() OVER (PARTITION BY id ORDER BY b DESC, t) = 1)"""


def _sharp(factor: float) -> str:
    """sh (id, y, x, v): gray pixels after contrast and sharpening."""
    return f"""gy AS (SELECT id, y, x, floor(v * 0.3::double + (v // 2) * 0.59::double + (255 - v) * 0.11::double + 0.5) v FROM px),
co AS (SELECT id, y, x, floor(greatest(0, least(255, (v - 128) * {factor}::double + 128)) + 0.5)::int v FROM gy),
sh AS (SELECT id, y, x, CASE WHEN y IN (0, 11) OR x IN (0, 15) THEN v ELSE greatest(0, least(255, 5 * v - lag(v) OVER r - lead(v) OVER r - lag(v) OVER c - lead(v) OVER c)) END v
  FROM co WINDOW r AS (PARTITION BY id, y ORDER BY x), c AS (PARTITION BY id, x ORDER BY y))"""


_HASH = "sha256(unhex(string_agg(repeat(printf('%02x', v::int), 3) || 'ff', '' ORDER BY y, x)))"
_MEASURES = PIXELS + ", " + _otsu("px") + """, gr AS (SELECT id, y, x, (255 + v // 2)::double / 3 g FROM px),
ed AS (SELECT id, y, x, abs(g * 2 - lead(g) OVER (PARTITION BY id, y ORDER BY x) - lead(g) OVER (PARTITION BY id, x ORDER BY y)) e FROM gr),
m1 AS (SELECT id, var_pop(e) variance FROM ed WHERE y % 2 = 1 AND x % 2 = 1 AND y < 11 AND x < 15 GROUP BY 1),
m2 AS (SELECT id, avg(g) mean, max(g) - min(g) span FROM gr WHERE x % 4 = 0 GROUP BY 1),
me AS (SELECT id AS image_id, variance, variance < 50 AS blurry, mean, mean BETWEEN 40 AND 235 AS bright_ok, span, span >= 50 AS contrast_ok, otsu FROM m1 JOIN m2 USING (id) JOIN ot USING (id))"""


@query("image_measures", f"WITH {_MEASURES} SELECT * REPLACE (round(variance, 6) AS variance, round(mean, 6) AS mean, round(span, 6) AS span) FROM me")
def _(spark, d):
    return images.measured(R.images(spark, d)).withColumns({c: F.round(c, 6) for c in ("variance", "mean", "span")})


@query("image_preprocess", f"WITH {PIXELS}, {_sharp(1.3)}, {_otsu('sh')}, bw AS (SELECT id, y, x, CASE WHEN v > otsu THEN 255 ELSE 0 END v FROM sh JOIN ot USING (id)) SELECT id AS image_id, {_HASH} AS pixels FROM bw GROUP BY 1")
def _(spark, d):
    return images.preprocess(R.images(spark, d)).select("image_id", F.sha2("rgba", 256).alias("pixels"))


@query("image_enhance", f"""WITH {PIXELS}, {_sharp(1.4)},
s3 AS (SELECT id, y, x, v, v + lag(v) OVER r + lead(v) OVER r AS t FROM sh WINDOW r AS (PARTITION BY id, y ORDER BY x)),
bl AS (SELECT id, y, x, CASE WHEN y IN (0, 11) OR x IN (0, 15) THEN v ELSE floor((t + lag(t) OVER c + lead(t) OVER c)::double / 9 + 0.5)::int END v FROM s3 WINDOW c AS (PARTITION BY id, x ORDER BY y)),
av AS (SELECT id, y, x, v, avg(v) OVER (PARTITION BY id) a FROM bl),
ev AS (SELECT id, y, x, CASE WHEN a < 1 THEN v ELSE floor(least(255, v * (128 / a)) + 0.5)::int END v FROM av) SELECT id AS image_id, {_HASH} AS pixels FROM ev GROUP BY 1""")
def _(spark, d):
    return images.enhance(R.images(spark, d)).select("image_id", F.sha2("rgba", 256).alias("pixels"))


@query("image_quality", f"""WITH {_MEASURES} SELECT image_id, issues, issues >= 3 AS poor FROM (SELECT image_id, (1 + CASE WHEN blurry THEN 1 ELSE 0 END + CASE WHEN bright_ok THEN 0 ELSE 1 END + CASE WHEN contrast_ok THEN 0 ELSE 1 END + 1)::int issues FROM me)""")
def _(spark, d):
    m = images.measured(R.images(spark, d))
    m = m.join(R.images(spark, d).select("image_id", "width", "height"), "image_id")
    size = (F.col("width"), F.col("height"))
    q = checks.quality(T.resolution(*size)["adequate"], ~F.col("blurry"), F.col("bright_ok"), F.col("contrast_ok"), T.page_dpi(*size)["adequate"])
    return m.select("image_id", q["issues"].alias("issues"), q["poor"].alias("poor"))
