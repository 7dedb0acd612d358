"""The queries over stored bills that save, look up and search, and the same results in DuckDB SQL.

Each makes a store of the tables' records in the shared folder and answers from what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.plans.bill_queries import _UPSERT, STORE, _halves, query
from quillmill.sources import folders
from quillmill.sources import rendered as R
from quillmill.sources import store as S
from quillmill.sources.saved import BillStore
from quillmill.sources.search import SearchIndex
from quillmill.streaming import bills as streams

#: The last day of a bill that may be saved in these queries.
AS_OF = "1996-06-30"


def _store(spark: SparkSession, records: DataFrame, key: str = "billNo") -> BillStore:
    return BillStore.create(spark, folders.shared(spark, "bills"), records, key)


def _both(after: DataFrame, rejected: DataFrame, key: str = "billNo") -> DataFrame:
    """What is stored, and what was rejected and why."""
    return after.select("id", key, F.lit(None).cast("string").alias("why")).union(rejected.select("id", key, F.array_join("errors", "; ")))


_TAKEN = "SELECT id, {key}, NULL::varchar why FROM old UNION ALL SELECT id, {key}, NULL FROM ok UNION ALL SELECT id, {key}, '{key}: taken' FROM new WHERE id NOT IN (SELECT id FROM ok)"


@query("upsert_bills", f"WITH {_UPSERT} {_TAKEN.format(key='billNo')}")
def _(spark, d):
    old, new = _halves(spark, d)
    after, rejected = _store(spark, old).save(new)
    return _both(after.records(), rejected)


_AGAIN = STORE + """, o AS (SELECT * FROM st WHERE id % 3 <> 0),
n AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'R' || id ELSE billNo END billNo, createdAt FROM o WHERE id % 4 = 1
  UNION ALL SELECT id, CASE WHEN id % 5 <> 0 THEN billNo END, createdAt FROM st WHERE id % 3 = 0),
c AS (SELECT DISTINCT n.id FROM n JOIN o ON n.billNo = o.billNo AND n.id <> o.id),
f AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM c)),
k AS (SELECT * FROM f QUALIFY billNo IS NULL OR row_number() OVER (PARTITION BY billNo ORDER BY createdAt, id) = 1)"""


@query("replace_bills", f"""WITH {_AGAIN} SELECT id, billNo, NULL::varchar why FROM o WHERE id NOT IN (SELECT id FROM k)
UNION ALL SELECT id, billNo, NULL FROM k UNION ALL SELECT id, billNo, 'billNo: taken' FROM n WHERE id NOT IN (SELECT id FROM k)""")
def _(spark, d):
    """Some stored records come again with a new number, without one, or unchanged, with new records among them."""
    old, new = _halves(spark, d)
    number = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, F.concat(F.lit("R"), "id")).otherwise(F.col("billNo"))
    again = old.filter("id % 4 = 1").withColumn("billNo", number)
    new = new.withColumn("billNo", F.when(F.col("id") % 5 != 0, F.col("billNo")))
    after, rejected = _store(spark, old).save(again.union(new))
    return _both(after.records(), rejected)


@query("save_checked", f"""WITH {_UPSERT.replace("FROM st WHERE id % 3 = 0)", f"FROM st WHERE id % 3 = 0 AND date::date <= DATE '{AS_OF}')")}
{_TAKEN.format(key='billNo')} UNION ALL SELECT id, billNo, 'date: in the future' FROM st WHERE id % 3 = 0 AND date::date > DATE '{AS_OF}'""")
def _(spark, d):
    old, new = _halves(spark, d)
    after, rejected = _store(spark, old).save(new, errors=S.save_errors(F.to_date(F.lit(AS_OF)), confirmed=True))
    return _both(after.records(), rejected)


_MOBILE = _UPSERT.replace("billNo", "invoiceNo").replace("::varchar invoiceNo", "::varchar billNo0").replace(
    "old AS (SELECT * FROM", "sh AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'Not Found' ELSE billNo0 END invoiceNo FROM st), old AS (SELECT * REPLACE (billNo0 AS invoiceNo) FROM"
).replace("FROM st WHERE", "FROM sh WHERE")


@query("mobile_insert", f"WITH {_MOBILE} {_TAKEN.format(key='invoiceNo')}")
def _(spark, d):
    """A number that was not read is stored as it was shown, so only the first such record is."""
    old, new = (x.withColumnRenamed("billNo", "invoiceNo") for x in _halves(spark, d))
    new = S.as_shown(new.withColumn("invoiceNo", F.when(F.col("id") % 9 != 0, F.col("invoiceNo"))))
    after, rejected = _store(spark, old, "invoiceNo").save(new, replace=False)
    return _both(after.records(), rejected, "invoiceNo")


@query("find_bill", f"WITH {STORE} SELECT 'no' AS how, min(id) id FROM st WHERE billNo = '1500' UNION ALL SELECT 'hash', min(id) FROM st WHERE invoiceHash = (SELECT invoiceHash FROM st WHERE id = 42) UNION ALL SELECT 'id', 42")
def _(spark, d):
    now = _store(spark, R.store(spark, d)).snapshot()
    own = now.by_id(42)
    same = now.by_hash(own.first()["invoiceHash"])
    found = (("no", now.by_bill_no("1500")), ("hash", same), ("id", own))
    first, *more = [x.select(F.lit(how).alias("how"), "id") for how, x in found]
    return first.union(more[0]).union(more[1])


#: Numbers, names, dates, and what is nowhere; all but the last two are found by the index.
_SEARCHES = ("1500", "CUSTOMER#0000001", "#00000002", "5/1/1996", "/31/1995", "zzz", "77", "er#000")


@query("search_indexed", f"""WITH {STORE}, q AS (SELECT unnest([{", ".join(f"'{q}'" for q in _SEARCHES)}]) q)
SELECT q, id FROM q JOIN st ON contains(lower(billNo), lower(q)) OR contains(lower(customer), lower(q)) OR contains(strftime(date::date, '%-m/%-d/%Y'), lower(q))""")
def _(spark, d):
    now = _store(spark, R.store(spark, d)).snapshot()
    index = SearchIndex.build(now, folders.shared(spark, "search"))
    first, *more = [index.search(now, q).select(F.lit(q).alias("q"), "id") for q in _SEARCHES]
    for x in more:
        first = first.union(x)
    return first


@query("stream_keep_first", f"WITH {STORE} SELECT id, billNo FROM st QUALIFY row_number() OVER (PARTITION BY billNo ORDER BY createdAt, id) = 1")
def _(spark, d):
    """Bills arrive as files in the order they were made, some in each micro-batch; the store keeps the first of each number."""
    new = R.store(spark, d)
    folder = folders.shared(spark, "arrivals")
    store = _store(spark, new.limit(0))
    cuts = (None, "1994-06-01", "1996-06-01", None)
    for low, high in zip(cuts, cuts[1:]):
        part = new.filter((F.lit(True) if low is None else F.col("date") >= low) & (F.lit(True) if high is None else F.col("date") < high))
        part.write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(new.schema).parquet(f"{folder}/in")
        streams.stored(arriving, store, "bills").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return store.snapshot().records().select("id", "billNo")
