"""Saves that last: crashes, repeats, rivals, pruned lookups."""

import pytest
from pyspark.sql import functions as F

from quillmill.sources import folders
from quillmill.sources import store as S
from quillmill.sources.saved import BillStore, bucket_named

SCHEMA = "id long, billNo string, customer string, createdAt timestamp, synced boolean, invoiceHash string"
DAY = "2026-01-0"


def rows(spark, *some):
    return spark.createDataFrame(list(some), "id long, billNo string, customer string, day string, synced boolean, invoiceHash string").select(
        "id", "billNo", "customer", F.to_timestamp("day").alias("createdAt"), "synced", "invoiceHash"
    )


@pytest.fixture
def store(spark, tmp_path):
    old = rows(spark, *[(i, f"N{i}", f"c{i}", DAY + "1", i % 2 == 0, f"h{i % 7}") for i in range(1, 41)], (41, None, "no number", DAY + "1", False, ""), (42, None, "nor this", DAY + "1", False, None))
    return BillStore.create(spark, f"file://{tmp_path}/bills", old, buckets=8)


def told(df):
    return sorted((r["id"], r["billNo"], r["customer"]) for r in df.select("id", "billNo", "customer").collect())


def whole(store):
    """The three tables agree."""
    now = store.snapshot()
    records = {r["id"]: r for r in now.records().collect()}
    assert {r["id"] for r in now.read("ids").collect()} == set(records) and now.read("ids").count() == len(records)
    assert sorted((r["invoiceHash"], r["id"]) for r in now.read("hashes").collect()) == sorted((r["invoiceHash"], i) for i, r in records.items() if r["invoiceHash"])
    return records


def test_a_save_is_read_back_and_equals_upsert(spark, store):
    new = rows(spark, (3, "N3", "again", DAY + "2", None, "h99"), (4, "M4", "renamed", DAY + "2", True, None), (50, "N5", "taken", DAY + "2", None, None), (51, "X", "first", DAY + "2", None, "h1"), (52, "X", "second", DAY + "3", None, None))
    before = store.snapshot()
    want, refused = S.upsert(before.records(), new)
    after, rejected = store.save(new)
    assert told(after.records()) == told(want) == told(store.snapshot().records())
    assert told(rejected) == told(refused) == [(50, "N5", "taken"), (52, "X", "second")]
    assert {r["id"]: r["errors"] for r in rejected.collect()} == {50: ["billNo: taken"], 52: ["billNo: taken"]}
    records = whole(store)
    assert records[3]["synced"] is False and records[4]["synced"] is True
    assert after.version == 1 and len(told(before.records())) == 42  # a pinned reader sees what it pinned
    assert told(store.snapshot(0).records()) == told(before.records())


def test_null_numbers_two_rows_of_one_id_and_rows_without_an_id(spark, store):
    new = rows(spark, (None, None, "a", DAY + "2", None, None), (None, "N60", "b", DAY + "2", None, None), (None, None, "c", DAY + "2", None, None), (70, "N70", "old", DAY + "2", None, None), (70, "N71", "new", DAY + "3", None, None))
    after, rejected = store.save(new)
    records = whole(store)
    added = sorted((r["customer"], r["billNo"]) for i, r in records.items() if i > 42)
    assert added == [("a", None), ("b", "N60"), ("c", None), ("new", "N71")]
    assert [(r["customer"], r["errors"]) for r in rejected.collect()] == [("old", ["id: saved again later"])]
    assert len(records) == after.records().count() == 46


def test_a_crash_before_the_commit_changes_nothing(spark, store):
    def crash():
        raise KeyboardInterrupt

    before = told(store.snapshot().records())
    new = rows(spark, (3, "Z", "z", DAY + "2", None, None))
    with pytest.raises(KeyboardInterrupt):
        store.save(new, before_commit=crash)
    assert store.versions() == [0] and told(store.snapshot().records()) == before
    store.save(new)
    assert (3, "Z", "z") in told(store.snapshot().records()) and len(whole(store)) == 42
    store.clean(keep=1)
    assert store.versions() == [1] and len(whole(store)) == 42
    assert len(folders.names(spark, f"{store.path}/data")) == 2  # the folder of the crash is gone


def test_a_repeated_save_is_applied_once(spark, store):
    new = rows(spark, (None, "R1", "r", DAY + "2", None, None), (None, "N1", "taken", DAY + "2", None, None))
    first, refused = store.save(new, token="stream", number=4)
    again, same = store.save(new, token="stream", number=4)
    assert first.version == again.version == 1 and told(refused) == told(same)
    assert store.save(new, token="stream", number=3)[0].version == 1
    later, refused = store.save(new, token="stream", number=5)  # a new save of the same rows: their numbers are taken now
    assert later.version == 2 and refused.count() == 2 and len(whole(store)) == 43


def test_of_two_writers_the_later_begins_anew(spark, store):
    rival = BillStore(spark, store.path)
    turns = []

    def between():
        if not turns:
            turns.append(1)
            rival.save(rows(spark, (80, "SAME", "rival", DAY + "2", None, None)))

    after, rejected = store.save(rows(spark, (81, "SAME", "late", DAY + "1", None, None), (82, "OWN", "o", DAY + "1", None, None)), before_commit=between)
    assert after.version == 2
    assert told(rejected) == [(81, "SAME", "late")]
    assert {80, 82} <= set(whole(store)) and 81 not in whole(store)


def test_only_buckets_that_change_are_written(spark, store):
    before = store.snapshot().manifest["tables"]["records"]
    after = store.save(rows(spark, (3, "N3", "again", DAY + "2", None, None)))[0].manifest["tables"]["records"]
    assert {b for b in after if after[b] != before.get(b)} == {str(bucket_named("N3", 8))}


def test_lookups_read_one_bucket(spark, store):
    now = store.snapshot()
    all_files = len(now.records().inputFiles())
    for found, want in [(now.by_bill_no("N17"), 17), (now.by_id(23), 23), (now.by_hash("h3"), 3)]:
        assert [r["id"] for r in found.collect()] == [want]
        assert 1 <= len(found.inputFiles()) <= all_files / 4
    plan = now.by_bill_no("N17")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(billNo), EqualTo(billNo,N17)]" in plan
    for none in (now.by_bill_no("?"), now.by_id(999), now.by_hash(""), now.by_hash(None), now.by_hash("?")):
        assert none.count() == 0


def test_delete_and_checked_saves(spark, store):
    store.delete(spark.createDataFrame([(1,), (2,), (999,)], "id long"))
    assert len(whole(store)) == 40 and store.snapshot().by_id(1).count() == 0 and store.snapshot().by_hash("h1").first()["id"] == 8
    errors = F.when(F.col("customer").isNull(), F.array(F.lit("customer: missing")))
    after, rejected = store.save(rows(spark, (90, "P", None, DAY + "2", None, None), (91, "Q", "q", DAY + "2", None, None)), errors=errors)
    assert [(r["id"], r["errors"]) for r in rejected.collect()] == [(90, ["customer: missing"])]
    assert after.by_id(91).count() == 1 and after.by_id(90).count() == 0


def test_a_store_may_begin_empty_and_insert_only(spark, tmp_path):
    store = BillStore.create(spark, f"file://{tmp_path}/m", spark.createDataFrame([], SCHEMA.replace("billNo", "invoiceNo")), key="invoiceNo", buckets=4)
    one = rows(spark, (1, "A", "x", DAY + "1", None, None)).withColumnRenamed("billNo", "invoiceNo")
    assert store.snapshot().records().count() == 0
    store.save(one, replace=False)
    after, rejected = store.save(one, replace=False)
    assert after.records().count() == 1 and [r["errors"] for r in rejected.collect()] == [["invoiceNo: taken"]]


def test_a_cluster_needs_a_shared_folder(spark):
    def session(master):
        conf = type("Conf", (), {"get": lambda self, name, default: default})()
        return type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master})})()

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            folders.shared(session(master), "x")
    assert folders.shared(session("local[4]"), "x").startswith("file:///")
    assert folders.shared(spark, "x") != folders.shared(spark, "x")
