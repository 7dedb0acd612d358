"""Words of whole pages in Arrow batches, and what the text parser evaluates."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill.functions import numbers as N
from quillmill.functions import text as T
from quillmill.operators import layouts, spatial, template
from quillmill.sources import rendered as R

RAW = ["12.5", "O12", "12.", ".5", "1,234.50", "abc", "+7", "2.5%", "", "-3", "1e999", " 12", "S.5", "\x0b-S.5\n", "ABCS", "- 5", "l2B kg", ",B5", ", 7", "1e5x", "+-5", "SGST", None]


def _shuffled(spark, pages):
    """Rows of words in no order."""
    rows = pages.select("bill_id", F.explode("words").alias("w")).select("bill_id", "w.*").collect()
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "bill_id long, word_ix int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")


def test_pages_have_the_words_of_the_rows(spark, sf_dir):
    rows = R.bills_words(spark, sf_dir)
    pages = R.bills_pages(spark, sf_dir).select("bill_id", F.inline("words")).select(*rows.columns)
    assert {tuple(r) for r in pages.collect()} == {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("of", ["table_rows", "table_rows_plain", "table_rows_by_column", "totals", "customers", "bill_numbers", "word_rows"])
def test_rows_in_any_order_give_what_pages_give(spark, sf_dir, of):
    pages = R.bills_pages(spark, sf_dir).filter("bill_id % 20 = 1").localCheckpoint()
    op = getattr(spatial, of)
    got = sorted(map(tuple, op(spatial.normalize_words(_shuffled(spark, pages))).collect()), key=repr)
    assert got and got == sorted(map(tuple, op(pages).collect()), key=repr)


def test_empty_pages_and_words_without_text(spark):
    kind = "bill_id long, words array<struct<word_ix:int,text:string,x0:double,y0:double,x1:double,y1:double>>"
    df = spark.createDataFrame([(1, []), (2, [(0, None, None, 1.0, 2.0, 3.0)]), (3, [])], kind)
    for of in ("table_rows", "table_rows_plain", "table_rows_by_column", "totals", "customers"):
        assert getattr(spatial, of)(df).collect() == []
    assert [tuple(r) for r in spatial.word_rows(df).collect()] == [(2, 0, 0)]


def _zones(words):
    """zones of one page by its plain rule; words are (word_ix, text, x0, y0, x1, y1)."""
    space = " \t\n\x0b\f\r"
    words = sorted((i, (t or "").strip(space), *[v or 0.0 for v in at]) for i, t, *at in words)
    text, box, y = [w[1] for w in words], [w[2:] for w in words], [(w[3] + w[5]) / 2 for w in words]
    x, every = [(w[2] + w[4]) / 2 for w in words], range(len(words))
    high = [b[3] - b[1] for b in box if b[3] > b[1]]
    mean = math.floor((sum(high) / len(high) if high else 15.0) * 0.8 + 0.5)
    bare = [re.sub(f"[{space}]", "", t) for t in text]
    out = []
    top = [i for i in every if box[i][1] < (max(b[3] for b in box) + 50) * 28 / 100]
    for i in top:
        line = [o for o in top if abs(y[o] - y[i]) < max(mean, 10)]
        right = sorted((x[o], words[o][0], o) for o in line if x[o] > x[i])
        if text[i].lower() in ("no", "no.", "t0") and right and not re.search(r"(?i)GST\s*No", " ".join(text[o] for o in line), re.ASCII):
            out += [("bill_no", None, box[i]), ("bill_no", None, box[right[0][2]])]
            break
    number = [i for i in every if re.fullmatch("[0-9]{2}[A-Z][A-Z0-9]{10,14}", bare[i])][:1]
    out += [("customer", None, box[i]) for n in number for i in every if len(bare[n]) == 15 and y[i] < y[n] - 5]
    total = next((box[i][1] for i in every if re.fullmatch("T[O0D]?TAL|TOIAL", bare[i].upper())), None)
    net = [box[i][1] for i in every if re.fullmatch("NETT[O0D]?TAL", bare[i].upper())]
    if total is not None:
        end = (net[-1] + 80 if net else total + 600) + 5
        out += [("totals", None, b) for b in box if b[1] >= total - 5 and b[3] <= end]
    row, last = 0, None
    for i in sorted((i for i in every if y[i] < (1e9 if total is None else total) - 20), key=lambda i: (y[i], x[i], words[i][0])):
        row += last is not None and abs(y[i] - last) > max(mean, 15)
        last = y[i]
        out.append(("table", row, box[i]))
    return out


ODD = ["No", "no.", "N0", "NO.", "T0", "t0 ", "No:", "GST", "gst", "GST No", "G\u017fT", "TOTAL", "t o t a l", "T\x0bTAL", "TOTALS", "toıal", "NETTOTAL", "Net T0tal", "NET",
       "33ABCDE1234F1Z5", " 33ABCDE 1234F1Z5", "33ABCDE1234F1", "33ABCDE1234F1Z567", "33ABCDE1234F1Z5678", "33abcde1234f1z5", "1234", "12.50", "foot", "", " ", None]


def test_zones_of_odd_pages_are_those_of_the_plain_rule(spark):
    own, pages = random.Random(5), []
    for n in range(400):
        words, spread, kinds = [], own.choice((100, 400, 2000)), own.sample(ODD, own.randint(2, len(ODD)))
        for i in range(own.randint(0, 30)):
            x, y = (float(own.randrange(0, most, 10)) for most in (300, spread))
            words.append((i, own.choice(kinds), x, y, x + own.choice((0.0, 20.0, 30.0)), y + own.choice((-5.0, 0.0, 12.0, 12.0, 40.0)) if own.random() < 0.95 else None))
        own.shuffle(words)
        pages.append((n, words))
    df = spark.createDataFrame(pages, "bill_id long, words array<struct<word_ix:int,text:string,x0:double,y0:double,x1:double,y1:double>>")
    want = sorted(((n, zone, row, *box) for n, words in pages for zone, row, box in _zones(words)), key=repr)
    assert {w[1] for w in want} == {"bill_no", "customer", "totals", "table"}
    assert sorted(map(tuple, spatial.zones(df).collect()), key=repr) == want
    rows = spatial.normalize_words(df.select("bill_id", F.inline("words")).repartition(3))
    assert sorted(map(tuple, spatial.zones(rows).collect()), key=repr) == want


def test_zones_read_each_bill_once(spark, sf_dir):
    from quillmill.plans.bill_queries import QUERIES

    plan = _plan(QUERIES["spatial_zones"](spark, sf_dir))
    assert "Generate" not in plan and plan.count("Aggregate") == 1 and plan.count("Window") == 1  # the lines, their numbers
    assert plan.count("MapInArrow") == 1


def test_numbers_of_a_page_are_those_of_the_column_function(spark):
    import pyarrow as pa

    from quillmill.operators import pages

    want = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(RAW)], "i int, t string").coalesce(1).orderBy("i").select(N.parse_repaired(F.col("t"))).collect()]
    got = pages.parsed(pa.array([t or "" for t in RAW]))
    assert [None if v != v else float(v) for v in got] == want


def test_words_like_totals(spark):
    rows = [("total",), (" T 0 T A L ",), ("TTAL",), ("toıal",), ("TOIAL",), ("TOTALS",), ("NETTOTAL",), ("net t0tal",), (None,), ("",)]
    got = spark.createDataFrame(rows, "w string").select(T.is_total(F.col("w")), T.is_net_total(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(True, False)] * 5 + [(False, False), (False, True), (False, True), (False, False), (False, False)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_pages_are_not_exploded_or_grouped(spark, sf_dir):
    for of in (spatial.table_rows, spatial.totals, spatial.customers, spatial.bill_numbers, spatial.word_rows):
        plan = _plan(of(R.bills_pages(spark, sf_dir)))
        assert "Generate" not in plan and plan.count("Aggregate") == 1  # the lines of a bill


def test_anchors_group_only_words_that_can_be_one(spark, sf_dir):
    plan = _plan(layouts.anchors(R.bills_words(spark, sf_dir)))
    assert plan.lower().count("upper(trim(") == 1 and "RLIKE" in plan


def test_a_label_is_matched_once(spark):
    df = spark.createDataFrame([("No: 12",)], "t string")
    plan = _plan(df.select(F.when(F.length("t") > 1, N.first(F.col("t"), r"No: (\d+)")).alias("n"), F.when(F.length("t") > 2, N.parse_float(F.col("t"))).alias("f")))
    assert plan.count("regexp_extract(") == 2


@pytest.mark.parametrize("text,state", [("STATE: Tamil Nadu (33)", "33"), ("(29)", "29"), ("Tamil Nadu", None), ("(x) Tamil  Nadu(7)", "7"), ("(a) b", None)])
def test_state_of_a_customer(spark, text, state):
    bill = f"NEW GOOD NITS\nGST No: 33AAFFN1234A1Z5\nTo.\nFIRM\n{text}\nGST No: 29ABCDE1234F1Z5"
    assert spark.createDataFrame([(bill,)], "t string").select(template.customer(F.col("t"))["state"]).first()[0] == state


def test_templates_in_small_letters(spark):
    rows = [("New Good Nits",), ("knittıng invoice good",), ("NEW GOOD",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(template.detect_template(F.col("t"))).collect()] == [template.TEMPLATE] * 2 + [None] * 2
