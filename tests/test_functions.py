"""Worked examples and odd cases of the scalar functions and extractors."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import numbers as N
from quillmill.functions import text as T
from quillmill.operators import generic, region, spatial, tables, template, votes
from quillmill.sources import store as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "fixed"), [("2I0", "210"), ("125.SO", "125.50"), ("SO", "50"), ("Is", "15"), ("Invoice", "Invoice"), ("", ""), (None, None)]
)
def test_repair(spark, raw, fixed):
    if raw == "Is":  # small s stays
        fixed = "1s"
    assert one(spark, N.repair_numeric(F.col("v")), v=raw) == fixed


@pytest.mark.parametrize(("raw", "value"), [("125.5x", 125.5), ("1d", 1.0), ("NaN", None), (".5", 0.5), ("-2e3z", -2000.0), ("x", None), ("", None), (None, None)])
def test_parse_float(spark, raw, value):
    assert one(spark, N.parse_float(F.col("v")), v=raw) == value


def test_numbers(spark):
    assert one(spark, N.to_number(F.col("v")), v="20,490.10") == 20490.1
    assert one(spark, N.to_number(F.col("v")), v=None) == 0
    assert one(spark, N.round_half_up(F.col("v")), v=-2.5) == -2
    assert one(spark, N.round_half_up(F.col("v"), 2), v=0.125) == 0.13


def test_normalize(spark):
    assert one(spark, T.normalize_lines(F.col("v")), v=" a  b\r\nT0TAL GSTNO No. G5T ") == "a b\nTOTAL GST No No: GST"
    assert one(spark, T.normalize_flat(F.col("v")), v="a\n\tb TOIAL") == "a b TOTAL"
    assert one(spark, T.normalize_lines(F.col("v")), v=None) == ""


@pytest.mark.parametrize(("raw", "iso"), [("1/2/26", "2026-02-01"), ("2026-1-5", "2026-01-05"), ("31-12-1999", "1999-12-31"), ("1/2", None)])
def test_iso_date(spark, raw, iso):
    assert one(spark, T.iso_date(F.col("v")), v=raw) == iso


def test_form_date_takes_two_digit_years_for_days(spark):
    assert one(spark, T.form_date(F.col("v")), v="10/01/26") == "2010-01-26"
    assert one(spark, T.form_date(F.col("v")), v="none") == "none"


def test_text_rows_keep_numeric_prefixes_and_never_repair_them(spark):
    assert [t["v"] for t in one(spark, tables.numeric_tokens(F.col("v")), v="2I0 x 1,200.50")] == [2.0, 1200.5]


def test_rounded_off_loses_its_sign(spark):
    assert one(spark, template.totals(F.col("v")), v="TOTAL 1.000 100.00\nRounded Off -0.38\nNET TOTAL 105.00")["rounded_off"] == "0.38"
    assert one(spark, region.totals(F.col("v")), v="Rounded Off 0.20")["rounded_off"] is None


def test_bill_number_of_regions_has_no_word_boundary(spark):
    assert one(spark, region.bill_meta(F.col("v")), v="GST No: 33AAF")["bill_no"] == "33"


def test_postal_codes_are_no_bill_numbers(spark):
    assert one(spark, template.bill_meta(F.col("v")), v="No: 641")["bill_no"] is None


def test_one_gst_number_takes_the_lines_above(spark):
    got = one(spark, template.customer(F.col("v")), v="To.\nACME MILLS\nMain Road\nGST No: 33ABCDE1234F1Z5")
    assert (got["name"], got["address"], got["gst_no"]) == ("ACME MILLS", "To., Main Road", "33ABCDE1234F1Z5")
    assert one(spark, template.customer(F.col("v")), v="PAN: X\nGST No: 33AAFFN1234A1Z5") is None


def test_total_falls_back_to_largest_number(spark):
    assert one(spark, generic.total(F.col("v")), v="a 12 b 1,500.50 c") == "1500.5"


def test_rules_overlay_the_default():
    rules = generic.Rules()
    rules.set("x", {"total_rule": "LABEL:Due"})
    assert rules.get("x")["total_rule"] == "LABEL:Due" and rules.get("x")["gst_rule"] == "LABEL:GST"
    assert rules.get("nobody") == rules.get()


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "bill_id long, text string")
    assert tables.table_rows(none).count() == 0
    assert template.parse_bills(none).count() == 0
    assert tables.table_rows(spark.createDataFrame([(1, None), (2, "")], none.schema)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["10", "9", "x", "y", " "]), min_size=1, max_size=5), st.randoms())
def test_votes_ignore_row_order(spark, values, rng):
    rows = [(1, i, "f", v) for i, v in enumerate(values)]
    shuffled = rng.sample(rows, len(rows))
    frame = lambda r: spark.createDataFrame(r, "bill_id long, pass int, field string, value string")
    got = votes.vote(frame(rows)).first()
    assert got == votes.vote(frame(shuffled)).first()
    some = [v for v in values if v.strip()]
    if some:
        n = max(map(some.count, some))
        best = [v for v in dict.fromkeys(some) if some.count(v) == n]
        numbers = sorted((v for v in best if re.fullmatch("[0-9]+", v)), key=int)
        assert got["value"] == (numbers or best)[0] and got["confidence"] == n / len(some)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=12))
def test_clusters_split_exactly_at_steps(spark, ys):
    rows = [(1, i, "w", 0.0, float(y), 10.0, float(y)) for i, y in enumerate(ys)]
    words = spatial.normalize_words(spark.createDataFrame(rows, "bill_id long, word_ix int, text string, x0 double, y0 double, x1 double, y1 double"))
    got = {r["word_ix"]: r["row_ix"] for r in spatial.cluster_rows(words, 15.0).collect()}
    order = sorted(range(len(ys)), key=lambda i: (ys[i], i))
    row, want = 0, {order[0]: 0}
    for a, b in zip(order, order[1:]):
        row += ys[b] - ys[a] > 15
        want[b] = row
    assert got == want


def test_upsert_replaces_by_id_and_rejects_taken_numbers(spark):
    schema = "id long, billNo string, createdAt timestamp, synced boolean"
    old = spark.createDataFrame([(1, "A", None, True), (2, "B", None, False)], schema)
    new = spark.createDataFrame([(1, "A", None, None), (3, "B", None, None), (4, "C", None, None), (5, "C", None, None)], schema)
    after, rejected = S.upsert(old, new)
    assert sorted((r["id"], r["synced"]) for r in after.collect()) == [(1, False), (2, False), (4, False)]
    assert sorted(r["id"] for r in rejected.collect()) == [3, 5]


def test_csv_quotes_survive(spark, tmp_path):
    r = spark.sql("SELECT 1L id, 'N1' billNo, '2026-01-02' date, 'a \"b\", c' customer, '5' gst, 9.5D total, timestamp'2026-01-02 03:04:05' createdAt, true synced")
    S.write_csv(r, str(tmp_path / "x"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "x")).first()
    assert back["Customer"] == 'a "b", c' and back["Created At"] == "2026-01-02 03:04:05"


def test_stream_extracts_each_bill_once(spark, tmp_path):
    from quillmill.streaming import bills

    row = spark.sql("SELECT 7L bill_id, 'No: 1234\nDate: 01/02/2026\nNET TOTAL 1,234.00' text, timestamp'2026-02-01 10:00:00' arrived")
    row.union(row.withColumn("bill_id", F.lit(8).cast("long"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = bills.extracted(bills.incoming(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bills_out").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    try:
        out.processAllAvailable()
        got = spark.table("bills_out").collect()
    finally:
        out.stop()
    assert [(r["invoice_no"]["value"], r["total"]["value"]) for r in got] == [("1234", "1,234.00")]


def test_inline_status_of_required_fields(spark):
    from quillmill.operators import checks

    rows = [(None,), ("  ",), ("12.5x",), ("-1",), ("abc",), ("2026-02-28",), ("2026-13-01",)]
    df = spark.createDataFrame(rows, "v string").coalesce(1)
    got = {f: [r[0] for r in df.select(checks.inline_status(f, F.col("v"))).collect()] for f in ("total", "date", "billNo")}
    assert got["total"] == ["required", "required", "ok", "invalid amount", "invalid amount", "ok", "ok"]
    assert got["date"] == ["required", "required", "invalid date", "invalid date", "invalid date", "ok", "invalid date"]
    assert got["billNo"] == ["required", "required", *["ok"] * 5]


def test_words_beside_labels_take_one_exchange_and_no_window(spark, tmp_path):
    schema = "bill_id long, word_ix int, text string, x0 double, y0 double, x1 double, y1 double"
    spark.createDataFrame([(1, 0, "No", 0.0, 0.0, 9.0, 9.0)], schema).write.parquet(str(tmp_path / "w"))
    words = spatial.normalize_words(spark.read.parquet(str(tmp_path / "w")))
    for df in (spatial.bill_numbers(words), spatial.zones(words)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_the_nearest_word_to_the_right_of_a_label(spark):
    def page(*words):
        return [(1, i, t, float(x), float(y), x + 20.0, y + 10.0) for i, (t, x, y) in enumerate(words)]

    def number(*words):
        df = spark.createDataFrame(page(*words, ("foot", 0, 900)), "bill_id long, word_ix int, text string, x0 double, y0 double, x1 double, y1 double")
        return spatial.bill_numbers(spatial.normalize_words(df)).first()["bill_no"]

    assert number(("77", 300, 0), ("No.", 0, 50), ("9", 90, 52), ("8", 60, 48), ("5", 40, 70)) == "8"
    assert number(("GST", 0, 50), ("No", 30, 50), ("12", 60, 50), ("No", 0, 90), ("1,234", 40, 90)) == "1234"
    assert number(("No", 0, 50), ("word", 40, 50), ("T0", 0, 90), ("12O4", 40, 90)) == "1204"
    assert number(("No", 100, 50), ("left", 0, 50), ("31", 0, 90)) == "31"
    assert number(("No", 0, 50), ("abc", 40, 50)) is None
    assert number(("no", 0, 50), ("41", 40, 50), ("No.", 0, 80), ("42", 40, 80)) == "41"


@pytest.mark.parametrize("raw", [" 1,2I.5x", "\t12 ", "\x0b-S.5\n", ", 7", " , 8", "D12", "ABCS", "O", "", " ", None, "+.5e2z", "1 ", " 1", "l2B kg", "- 5"])
def test_parse_repaired_equals_its_plain_rule(spark, raw):
    def rule(t):
        if t is None:
            return None
        t = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t.replace(",", ""))
        if len(re.sub("[^A-Za-z]", "", t)) <= len(re.sub("[^0-9]", "", t)) + 2:
            t = t.translate(str.maketrans("OIlSB", "01158"))
        found = re.match(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", t)
        return float(found[0]) if found else None

    assert one(spark, N.parse_repaired(F.col("v")), v=raw) == rule(raw)
