"""Search by index equals plain search and reads less; a stream of saves that replays a batch stores each number once."""

import os

import pytest
from pyspark.sql import functions as F

from quillmill.sources import rendered as R
from quillmill.sources import store as S
from quillmill.sources.saved import BillStore
from quillmill.sources.search import SearchIndex
from quillmill.streaming import bills

QUERIES = ["1500", "Customer#0000001", "#00000002", "5/1/1996", "/31/1995", "zzz", "77", "", None, "er#000", "É", "ÉTÉ", "0 0", "no number"]


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('search')}"
    own = R.store(spark, sf_dir)
    odd = own.filter("id <= 8").withColumn("id", F.col("id") + 900_000).withColumn("customer", F.when(F.col("id") % 2 == 0, F.lit("Café d'été, no number"))).withColumn("billNo", F.lit(None).cast("string")).withColumn("date", F.lit("not a date"))
    store = BillStore.create(spark, f"{path}/bills", own.union(odd), buckets=16)
    return store, SearchIndex.build(store.snapshot(), f"{path}/index")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("q", QUERIES)
def test_index_finds_what_a_plain_search_finds(stored, q):
    store, index = stored
    now = store.snapshot()
    assert ids(index.search(now, q)) == ids(S.search(now.records(), q))


def test_a_rare_query_reads_few_files_and_a_common_one_all(stored):
    store, index = stored
    now = store.snapshot()
    everything = len(now.records().inputFiles())
    found = index.search(now, "Customer#000000101")
    assert found.count() > 0
    assert len([f for f in found.inputFiles() if "/bills/" in f]) < everything
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan
    assert len([f for f in index.search(now, "1500").inputFiles() if "/bills/" in f]) <= everything / 2
    assert sorted(index.search(now, "ustomer").inputFiles()) == sorted(now.records().inputFiles())
    assert index._rarest({"zzz", "cus"}) == [] and index._rarest({"cus"}) is None


def test_an_index_may_lag_behind_its_store(spark, stored):
    store, index = stored
    store.save(store.snapshot().records().limit(3).withColumn("customer", F.lit("Brand new name")))
    store.delete(spark.createDataFrame([(900_002,), (900_003,)], "id long"))
    now = store.snapshot()
    for q in ("brand new", "café", "Customer#0000001", "1500"):
        assert ids(index.search(now, q)) == ids(S.search(now.records(), q))
    assert len(ids(index.search(now, "brand new"))) == 3


def test_a_stream_with_a_replayed_batch_stores_each_number_once(spark, sf_dir, tmp_path):
    new = R.store(spark, sf_dir).filter("id <= 600").withColumn("billNo", (F.col("id") % 97).cast("string"))
    want = sorted((r["id"], r["billNo"]) for r in S.first_of_each(new).select("id", "billNo").collect())
    store = BillStore.create(spark, f"file://{tmp_path}/bills", new.limit(0), buckets=8)
    days = sorted(r["createdAt"] for r in new.select("createdAt").distinct().collect())
    cuts = [days[0], days[len(days) // 3], days[2 * len(days) // 3], days[-1]]

    def run():
        stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
        bills.stored(stream, store, "bills").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = new.filter(F.col("createdAt").between(F.lit(low), F.lit(high)) if k == 2 else (F.col("createdAt") >= F.lit(low)) & (F.col("createdAt") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        if k == 1:  # the query died after the save, before it noted the batch: the batch comes again
            for name in (str(k), f".{k}.crc"):
                os.remove(f"{tmp_path}/state/commits/{name}")
            run()
            assert store.snapshot().version == 2
    now = store.snapshot()
    assert now.version == 3 and now.applied("bills")["number"] == 2
    assert sorted((r["id"], r["billNo"]) for r in now.records().select("id", "billNo").collect()) == want
    assert len(want) == 97 and now.rejected("bills").filter("errors[0] = 'billNo: taken'").count() > 0
