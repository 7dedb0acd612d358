"""Extraction from bills that are damaged on purpose, so that every fallback is reached, and the same results in DuckDB SQL.

Each order gives a text whose ``kind`` is told by its number; the oracle states per kind what must be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import checks, generic, layouts, mobile, region, spatial, tables, template
from quillmill.plans.bill_queries import _LAYOUTS, BILLS, ORACLES, QUERIES, query
from quillmill.sources import rendered as R
from quillmill.sources import scans
from quillmill.sources import store as S

#: The seller's registration number.
SELLER = "33AAFFN1234A1Z5"


def _orders(spark: SparkSession, d: str, kinds: int) -> DataFrame:
    """(bill_id, kind, k, no, gstin): k and no are texts that the damaged bills are made with."""
    key = F.col("o_orderkey")
    return R.table(spark, d, "orders").select(
        key.alias("bill_id"), (key % kinds).alias("kind"), key.cast("string").alias("k"), (1000 + key % 9000).cast("string").alias("no"),
        F.concat(F.lit("29ABCDE"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("F1Z"), (key % 10).cast("string")).alias("gstin"),
        F.lpad((key % 1000000).cast("string"), 6, "0").alias("six"),
    )


def _sql(kinds: int) -> str:
    return f"""o AS (SELECT o_orderkey bill_id, o_orderkey % {kinds} kind, o_orderkey::varchar k, (1000 + o_orderkey % 9000)::varchar AS no,
  '29ABCDE' || lpad((o_orderkey % 10000)::varchar, 4, '0') || 'F1Z' || (o_orderkey % 10)::varchar gstin, lpad((o_orderkey % 1000000)::varchar, 6, '0') six FROM orders)"""


def _text(kinds: list[str]) -> Column:
    """The text of each kind; {k}, {no}, {gstin} and {six} are filled in."""
    def filled(form: str) -> Column:
        parts, out = form, []
        while "{" in parts:
            head, _, rest = parts.partition("{")
            name, _, parts = rest.partition("}")
            out += [F.lit(head), F.col(name)]
        return F.concat(*out, F.lit(parts)) if out else F.lit(parts)

    return F.get(F.array(*[filled(k) for k in kinds]), F.col("kind").cast("int"))


def _by_kind(*values: str) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_CUSTOMERS = [
    f"NEW GOOD NITS\nGST No: {SELLER}\nTo.\nM/s\nFIRM {{k}}\nRoad {{no}}\nSTATE: Tamil Nadu (33)\nGST No: {{gstin}}",  # a block after "To"
    f"NEW GOOD NITS\nGST No: {SELLER}\nFIRM {{k}}\nGST No: {{gstin}}",  # no such block
    f"TIN: 1\nGST No: {{gstin}}\nT0\nthe firm {{k}}\nlane {{no}}\n(33)\nGST No: {SELLER}",  # the seller's number is the second
    "the buyer\nFIRM {k}\nlane {no}\nTamil Nadu\nGST No: {gstin}",  # one number and no seller
    "FAR {k}\nbb\ncc\ndd\nee\nff\nlane {no}\nGST No: {gstin}",  # a name too far above it
    "To. buyer {k}\nlane {no}\n(29)\nGST No: 33ABCDE12345",  # a number cut short
    f"NEW GOOD NITS\nGST No: {SELLER}\nlane {{no}}",  # the seller alone
    "nothing of {k}",
]


@query("damaged_customer", f"""WITH {_sql(len(_CUSTOMERS))} SELECT bill_id,
{_by_kind("'FIRM ' || k", "'NEW GOOD NITS'", "'the firm ' || k", "'FIRM ' || k", "'bb'", "'buyer ' || k")} AS name,
{_by_kind("'M/s, Road ' || no || ', STATE: Tamil Nadu (33)'", f"'GST No: {SELLER}, FIRM ' || k", "'the firm ' || k || ', lane ' || no || ', (33)'", "'the buyer, lane ' || no || ', Tamil Nadu'", "'cc, dd, ee, ff, lane ' || no", "'lane ' || no || ', (29)'")} AS address,
{_by_kind("gstin", "gstin", f"'{SELLER}'", "gstin", "gstin", "'33ABCDE12345'")} AS gst_no, {_by_kind("'33'", "NULL", "'33'", "'Tamil Nadu'", "NULL", "'29'")} AS state FROM o""")
def _(spark, d):
    text = T.normalize_lines(_text(_CUSTOMERS))
    return _orders(spark, d, len(_CUSTOMERS)).select("bill_id", text.alias("t")).select("bill_id", template.customer(F.col("t")).alias("c")).select("bill_id", "c.*")


_TAIL = "\n" + "wool " * 40
_METAS = [
    "No: 641\nNo: {no}\n1.2.1996\nJob No: {six}\nParty DC No: P{k}\nRef: R{k}" + _TAIL,  # a postal code first
    "Bill {no} of the day\n01-02-1996\nParty DC No -\nRef. {k}" + _TAIL,  # no label; a dash counts as a colon, so the next word is taken
    "GST {no} of the day\n01/02/96" + _TAIL,  # the number is another's
    "Phone No: {no}\nbox\nNo - 602\nRef" + _TAIL,
    "",
]


@query("damaged_meta", f"""WITH {_sql(len(_METAS))} SELECT bill_id, {_by_kind("no", "no", "NULL", "no", "NULL")} AS bill_no,
{_by_kind("'1.2.1996'", "'01-02-1996'")} AS date, {_by_kind("six")} AS job_no, {_by_kind("'P' || k", "'Ref.'")} AS party_dc_no, {_by_kind("'R' || k", "k", "NULL", "'wool'")} AS ref FROM o""")
def _(spark, d):
    text = T.normalize_lines(_text(_METAS))
    return _orders(spark, d, len(_METAS)).select("bill_id", text.alias("t")).select("bill_id", template.bill_meta(F.col("t")).alias("m")).select("bill_id", "m.*")


_TOTALS = [
    "TOTAL due is\n{no}.50\n30.25\n31.75\n9{no}.25\n0.25",  # no labels: by the sizes of the numbers
    "TDTAL: 12.5 {no}.50\nCGST 2.5%: 30.25\nSGST 25% 31.75\nRounded Off: -0.40\nNET TDTAL 9{no}.25",  # letters misread
    "TOTAL {no}.50\nCGST 2.5% 100 30.25\nSGST 2.5% 100 31.75\nNETTOTAL 9{no}.25",  # no rounding: the least number
    "no sums here 12.50",
]


@query("damaged_totals", f"""WITH {_sql(len(_TOTALS))} SELECT bill_id, {_by_kind("no || '.5'", "no || '.50'", "no || '.50'")} AS subtotal, {_by_kind("'30.25'", "'30.25'", "'30.25'")} AS cgst,
{_by_kind("'0.25'", "'31.75'", "'31.75'")} AS sgst, {_by_kind("'0.25'", "'-0.40'", "'2.5'")} AS rounded_off, {_by_kind("'9' || no || '.25'", "'9' || no || '.25'", "'9' || no || '.25'")} AS net_total FROM o""")
def _(spark, d):
    return _orders(spark, d, len(_TOTALS)).select("bill_id", _text(_TOTALS).alias("t")).select("bill_id", template.totals(F.col("t")).alias("s")).select("bill_id", "s.*")


#: Of each field of the mobile scanner: text, what is found, and how sure that is.
_MOBILE = {
    "invoice_no": [
        ("No: {no}\nDate 1", "no", "high"), ("No: {no}\nx\ny\nz", "no", "medium"), ("No :\n{no}", "no", "high"), ("x No\n{no} y", "no", "medium"), ("Bill {no}", "no", "medium"),
        ("446 then {no}", "no", "medium"), ("12", None, "low"), ("", None, "low"),
    ],
    "date": [
        ("Date: 05/06/1996", "'05/06/1996'", "high"), ("Date :\n5/6/1996", "'5/6/1996'", "high"), ("on 05/06/1996", "'05/06/1996'", "medium"),
        ("Date\nx\n05/06/1996", "'05/06/1996'", "medium"), ("Date: 45/13/1996", None, "low"), ("{no}", None, "low"), ("x", None, "low"), ("", None, "low"),
    ],
    "gst": [
        ("GSTIN: {gstin}\nTo. x", "gstin", "high"), ("{gstin}\nTo x", "gstin", "high"), ("29ABCDE1234F1 Z5 x\nTo x", "'29ABCDE1234F1Z5'", "medium"), ("To. x\nGSTIN: {gstin}", None, "low"),
        ("a\nb\nc\nd\ne\nf\ng\nh GSTIN {gstin}", None, "low"), ("GSTIN - {gstin}" + " wool" * 20, "gstin", "high"), ("x", None, "low"), ("", None, "low"),
    ],
    "total": [
        ("NET TOTAL 1,234.00", "'1,234.00'", "high"), ("Net Total\n2,345.00", "'2,345.00'", "high"), ("a 1{no}.25\nb 2,000.00", "'1' || no || '.25'", "medium"), ("NET\nTOTAL : 1,111.00", "'1,111.00'", "high"),
        ("Sum 999.99", None, "low"), ("NET TOTAL none", None, "low"), ("x", None, "low"), ("", None, "low"),
    ],
}


def _mobile_sql(field: str) -> str:
    rows = _MOBILE[field]
    return f"{_by_kind(*[r[1] or 'NULL' for r in rows])} AS {field}, {_by_kind(*[repr(r[2]) for r in rows])} AS {field}_level"


@query("damaged_mobile", f"WITH {_sql(8)} SELECT bill_id, {', '.join(map(_mobile_sql, _MOBILE))} FROM o")
def _(spark, d):
    read = dict(invoice_no=mobile.invoice_no, date=mobile.bill_date, gst=mobile.seller_gstin, total=mobile.net_total)
    texts = _orders(spark, d, 8).select("bill_id", *[T.mobile_normalize(_text([r[0] for r in rows])).alias(f) for f, rows in _MOBILE.items()])
    found = texts.select("bill_id", *[read[f](F.col(f)).alias(f) for f in _MOBILE])
    return found.select("bill_id", *[c for f in _MOBILE for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.confidence").alias(f"{f}_level"))])


_LEVELS = (("29ABCDE1234F1Z5", "1/2/96", "12", "1,234.00"), ("29ABCDE1234", "1.2.96", "1", "0.00"), ("", "", "", ""), ("Not Found", "Not Found", "Not Found", "Not Found"), ("x", "x", "x" * 21, "x"), (None, None, None, None))


@query("damaged_confidence", """SELECT o_orderkey bill_id, """ + ", ".join(
    f"CASE o_orderkey % 6 {' '.join(f'WHEN {i} THEN {v!r}' for i, v in enumerate(levels))} END {name}"
    for name, levels in (("g", ("high", "medium", "low", "low", "medium", "low")), ("dt", ("high", "medium", "low", "low", "medium", "low")),
                         ("i", ("high", "medium", "low", "low", "medium", "low")), ("t", ("high", "low", "low", "low", "low", "low")))
) + " FROM orders")
def _(spark, d):
    at = lambda c: F.get(F.array(*[F.lit(r[c]) for r in _LEVELS]), (F.col("bill_id") % 6).cast("int"))
    rules = (("g", mobile.gst_confidence), ("dt", mobile.date_confidence), ("i", mobile.invoice_confidence), ("t", mobile.total_confidence))
    return _orders(spark, d, 6).select("bill_id", *[rule(at(c)).alias(name) for c, (name, rule) in enumerate(rules)])


_WORDS = ("TOTAL", "T0TAL", "tdtal", "T O T A L", "TTAL", "TOIAL", "TOTALS", "NET TOTAL", "NETT0TAL", "nettdtal", "NET", "", None)
_IS_TOTAL, _IS_NET = (0, 1, 2, 3, 4, 5), (7, 8, 9)


@query("damaged_total_words", f"SELECT o_orderkey bill_id, o_orderkey % {len(_WORDS)} IN {_IS_TOTAL} AS total, o_orderkey % {len(_WORDS)} IN {_IS_NET} AS net FROM orders")
def _(spark, d):
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), F.col("kind").cast("int"))
    return _orders(spark, d, len(_WORDS)).select("bill_id", T.is_total(word).alias("total"), T.is_net_total(word).alias("net"))


@query("subtotal_tolerance", f"WITH {BILLS} SELECT bill_id, bill_id % 7 = 0 OR bill_id % 11 <= 5 AS valid FROM b")
def _(spark, d):
    """The table's sum against subtotals that are off by 0 to 10, or missing."""
    rows = tables.table_rows(R.bills_text(spark, d)).groupBy("bill_id").agg(F.round(F.sum("amount"), 2).alias("s"))
    off = F.when(F.col("bill_id") % 2 == 0, 1).otherwise(-1) * (F.col("bill_id") % 11)
    return rows.select("bill_id", region.subtotal_check(F.col("s"), F.when(F.col("bill_id") % 7 != 0, F.round(F.col("s") + off, 2)), 5.001).alias("valid"))


@query("first_table_rows", f"WITH {BILLS} SELECT bill_id, 0 source, amount::double amount FROM li UNION ALL SELECT -1 - l_orderkey, 1, l_extendedprice::decimal(18,2)::double FROM lineitem")
def _(spark, d):
    smart = spatial.table_rows_by_column(spatial.normalize_words(R.bills_pages(spark, d))).select("bill_id", "amount")
    lines = R.rendered_lines(spark, d).select((-1 - F.col("bill_id")).alias("bill_id"), F.col("amount").cast("double"))
    plain = tables.table_rows(R.bills_text(spark, d)).select("bill_id", "amount").union(lines)
    return region.first_table(smart, plain).select("bill_id", "source", F.round("amount", 2).alias("amount"))


_FORM = (
    "Tax Invoice\nNo: {no}\nDate: 05/06/1996\nJob No: {k}\nParty DC No: P{k}\nFIRM {k}\nlane {no}\nplot\n{gstin}\nTamil Nadu (33)\nPhone 98765 43210\nmail a{k}@example.com\n"
    "CGST: 30.25\nSGST: 31.75\nIGST: 5.50\nRound Off: -0.40\n{no}.50\n9{no}.25"
)
_FORMED = dict(
    billNo="no", date="'05/06/1996'", formDate="'1996-06-05'", jobNo="k", partyDcNo="'P' || k", invoiceType="'Tax Invoice'", customer="'FIRM ' || k",
    customerAddress="'FIRM ' || k || ' lane ' || no || ' plot'", gst="gstin", customerState="'33'", customerPhone="'9876543210'", customerEmail="'a' || k || '@example.com'",
    subtotal="no || '.5'", cgst="'30.25'", sgst="'31.75'", igst="'5.5'", roundedOff="'-0.4'", netTotal="'9' || no || '.25'", total="'9' || no || '.25'",
)


@query("form_of_all_fields", f"WITH {_sql(1)} SELECT bill_id, unnest([{', '.join(map(repr, _FORMED))}]) field, unnest([{', '.join(_FORMED.values())}]) AS value FROM o")
def _(spark, d):
    t = F.col("t")
    parsed = _orders(spark, d, 1).select("bill_id", _text([_FORM]).alias("t")).select("bill_id", region.bill_meta(t).alias("bill_meta"), region.customer(t).alias("customer"), region.totals(t).alias("totals"))
    return region.form_fields(parsed)


_HEADERS = [
    "KNITTING INVOICE\nNEW GOOD NITS\n12 Mill Road\nTirupur {k}\nGSTIN 33AAFFN1234A1Z5\nTIN: 1{six}99\nPAN: AAFFN1234A\nPh 98765 43210, 04212-22333",
    "NEW GOOD NITS\nlane {no}\n9876543210\nrest",
    "Other firm\nPAN AAFFN1234A\n29ABCDE1234F1Z5",
    "",
    "KNITTING  INVOICE\nNEW  GOOD NITS\nlane {no}",  # spaces doubled: the name isn't found again among the lines
]


@query("damaged_header", f"""WITH {_sql(len(_HEADERS))} SELECT bill_id, {_by_kind("'NEW GOOD NITS'", "'NEW GOOD NITS'", "'Other firm'", "NULL", "'KNITTING INVOICE'")} AS company_name, {_by_kind("'33AAFFN1234A1Z5'", "NULL", "'29ABCDE1234F1Z5'")} AS gstin,
{_by_kind("'1' || six || '99'", "'9876543210'")} AS tin, {_by_kind("'AAFFN1234A'", "NULL", "'AAFFN1234A'")} AS pan, {_by_kind("'98765 43210; 04212-22333'", "'9876543210'", "''", "''", "''")} AS phones,
{_by_kind("'12 Mill Road, Tirupur ' || k", "'lane ' || no", "'PAN AAFFN1234A'", "NULL", "'KNITTING  INVOICE, NEW  GOOD NITS, lane ' || no")} AS address FROM o""")
def _(spark, d):
    h = _orders(spark, d, len(_HEADERS)).select("bill_id", region.header(_text(_HEADERS)).alias("h"))
    return h.select("bill_id", *[f"h.{c}" for c in ("company_name", "gstin", "tin", "pan")], F.array_join("h.phones", "; ").alias("phones"), "h.address")


@query("extract_any_confidence", f"""WITH {BILLS}, c AS (SELECT c_custkey k, c_custkey::varchar bill_no, (c_custkey * 10)::varchar total, CASE WHEN c_custkey % 5 > 0 THEN 80 END scan FROM customer),
w AS (SELECT k, unnest(['Invoice', bill_no, 'Grand', total]) t, unnest([50, 70, 80, 40]) s FROM c WHERE k % 2 = 0),
f AS (SELECT k, unnest(['bill_no', 'total']) field, unnest([bill_no, total]) v, scan FROM c),
m AS (SELECT f.k, field, coalesce(avg(s) / 100, max(scan) / 100::double, 0.5) sure FROM f LEFT JOIN w ON w.k = f.k AND (contains(lower(v), lower(t)) OR contains(lower(t), lower(v))) GROUP BY 1, 2)
SELECT bill_id, bill_no, net total, 0.9::double bill_no_sure, 0.9::double total_sure, 0.9::double date_sure FROM b
UNION ALL SELECT -k, k::varchar, (k * 10)::decimal(18,2), round(max(sure) FILTER (field = 'bill_no'), 9), round(max(sure) FILTER (field = 'total'), 9), 0 FROM m GROUP BY k""")
def _(spark, d):
    """Half of the other bills have words with confidences; of those without, some have a scan's."""
    key = F.col("c_custkey")
    other = R.table(spark, d, "customer").select(
        (-key).alias("bill_id"), F.concat(F.lit("Invoice No: "), key, F.lit("\nGrand Total: "), key * 10).alias("text"), F.when(key % 5 > 0, 80.0).alias("scan"), key
    )
    word = F.explode(F.arrays_zip(F.array(F.lit("Invoice"), key.cast("string"), F.lit("Grand"), (key * 10).cast("string")).alias("text"), F.array(*map(F.lit, (50.0, 70.0, 80.0, 40.0))).alias("confidence")))
    words = other.filter(key % 2 == 0).select("bill_id", word.alias("w")).select("bill_id", "w.*")
    bills = R.bills_text(spark, d).withColumn("scan", F.lit(None).cast("double")).union(other.drop("c_custkey"))
    out = generic.extract_any(bills, generic.Rules().get(), words=words, scan_confidence="scan")
    return out.select("bill_id", "bill_no", F.col("total").cast(R.MONEY).alias("total"), *[F.round(F.col("confidence")[c], 9).alias(f"{c}_sure") for c in ("bill_no", "total", "date")])


@query("photo_quality", """WITH ph AS (SELECT p_partkey id, p_size * 40 w, p_size * 50 h FROM part)
SELECT id AS image_id, (CASE WHEN w * h >= 250000 THEN 0 ELSE 1 END + CASE WHEN w >= 400 AND least(w / 8.27::double, h / 11.69::double) >= 50 THEN 0 ELSE 1 END + id % 2 + id % 3 // 2 + id % 5 // 4)::int issues,
(CASE WHEN w * h >= 250000 THEN 0 ELSE 1 END + CASE WHEN w >= 400 AND least(w / 8.27::double, h / 11.69::double) >= 50 THEN 0 ELSE 1 END + id % 2 + id % 3 // 2 + id % 5 // 4) >= 3 AS poor FROM ph""")
def _(spark, d):
    """Sizes on both sides of the limits, with every mix of the other checks."""
    key, size = F.col("p_partkey"), (F.col("p_size") * 40, F.col("p_size") * 50)
    q = checks.quality(T.resolution(*size)["adequate"], key % 2 == 0, key % 3 < 2, key % 5 < 4, T.page_dpi(*size)["adequate"])
    return R.table(spark, d, "part").select(key.alias("image_id"), q["issues"].alias("issues"), q["poor"].alias("poor"))


def _learned_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Templates of bills, with the layout learned from the words of the known one, saved as text and read back; the others have the default."""
    words = R.bills_words(spark, d)
    heights = words.groupBy("bill_id").agg((F.max("y1") + 50).alias("height"))
    trained = layouts.train(words, heights).withColumn("template", F.lit(region.TEMPLATE))
    saved = S.layouts_from_json(S.layout_json(trained))
    seen = R.bills_text(spark, d).select(region.detect_template(F.when(F.col("bill_id") % 3 > 0, F.col("text")).otherwise("OTHER SELLER")).alias("template"))
    bills = seen.groupBy("template").agg(F.count("*").alias("bills"))
    default = spark.createDataFrame(list(layouts.TRAINED), layouts.LAYOUT)
    return layouts.layout_for(bills, saved, default).select("template", "bills", "region", F.round("y", 6).alias("y"), F.round("h", 6).alias("h"))


QUERIES["trained_layout"] = _learned_layouts
ORACLES["trained_layout"] = f"""WITH {_LAYOUTS}, t AS (SELECT CASE WHEN bill_id % 3 > 0 THEN '{region.TEMPLATE}' ELSE '{region.UNKNOWN}' END AS template, count(*) bills FROM (SELECT DISTINCT l_orderkey bill_id FROM lineitem) GROUP BY 1),
le AS (SELECT '{region.TEMPLATE}' AS template, region, avg(y) y, avg(h) h FROM ly GROUP BY 2
  UNION ALL SELECT '{region.UNKNOWN}', * FROM (VALUES {", ".join(str((r, y, h)) for r, y, h, *_ in layouts.TRAINED)}))
SELECT template, bills, region, round(y::double, 6) y, round(h::double, 6) h FROM t JOIN le USING (template)"""


@query("text_of_blocks", f"WITH {_sql(1)} SELECT bill_id, 'No: ' || no || chr(10) || 'FIRM ' || k || chr(10) || chr(10) || gstin AS text FROM o")
def _(spark, d):
    line = lambda *parts: F.concat(*[F.lit(p) if p[:1] in " NF" else F.col(p) for p in parts])
    blocks = F.array(F.array(line("  No: ", "no"), line("FIRM ", "k", "  ")), F.array().cast("array<string>"), F.array(F.lit(" "), line("gstin", " ")))
    return _orders(spark, d, 1).select("bill_id", scans.text_of_blocks(blocks).alias("text"))


def _all_fields(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    who = region.customer(F.regexp_extract("text", r"(?s)(To\..*?)\nJob", 1))
    out = region.form_fields(R.bills_text(spark, d).select("bill_id", region.bill_meta(t).alias("bill_meta"), who.alias("customer"), region.totals(t).alias("totals")))
    money = F.col("field").isin("subtotal", "cgst", "sgst", "igst", "roundedOff", "netTotal", "total")
    return out.withColumn("value", F.when(money, F.col("value").try_cast("double").try_cast(R.MONEY).cast("string")).otherwise(F.col("value")))


# All fields of the undamaged bills too, not some of them: the registration number is taken for the bill's, the tax rate for the tax.
QUERIES["form_fields"] = _all_fields
ORACLES["form_fields"] = f"""WITH {BILLS} SELECT bill_id, unnest(['billNo', 'date', 'formDate', 'jobNo', 'customer', 'customerAddress', 'gst', 'subtotal', 'cgst', 'sgst', 'netTotal', 'total']) field,
unnest(['33', bill_date, iso, bill_id::varchar, cname, cname || ' ' || seg || ' GST No:', gstin, abs(off)::decimal(18,2)::varchar, '2.50', '2.50', net::varchar, net::varchar]) AS value FROM b"""
