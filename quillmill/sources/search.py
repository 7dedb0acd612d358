"""Searching stored bills by the three-letter pieces of their texts.

A posting is (gram, id, bucket of the record); postings are in buckets by gram and
sorted in each, and a small table counts them.  A query reads the postings of its
rarest grams, then the buckets of the records these name, and confirms each by
the plain search, so results are exactly those of ``store.search``.  Queries
under three letters, and those whose rarest gram is in a quarter of all records,
read the records themselves.

An index is of one version of its store.  Buckets that later saves have written
anew are searched plainly, the others by the index, so it may lag behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources import folders
from quillmill.sources import store as S
from quillmill.sources.saved import Snapshot, bucket_named, bucket_of

GRAM = 3
#: Grams of a query whose postings are met.
MOST_GRAMS = 3
#: Share of the records beyond which a gram's postings are not worth reading.
COMMON = 0.25


def grams_of(text: Column) -> Column:
    """The different grams of a text."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.about = folders.get(spark, f"{self.path}/index.json")

    @staticmethod
    def build(snapshot: Snapshot, path: str) -> SearchIndex:
        spark, n = snapshot.spark, snapshot.buckets
        own = snapshot.records()
        grams = F.array_distinct(F.flatten(F.array(*[grams_of(t) for t in S.searched(own).values()])))
        at = bucket_of(F.col(snapshot.key), F.col("id"), n)
        postings = own.select(F.explode(grams).alias("gram"), "id", at.alias("at")).withColumn("bucket", bucket_of(F.col("gram"), F.col("gram"), n))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # A gram of many records is several files: ranges go down to ids.
        postings.repartitionByRange(parts, "bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        stored.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange(parts, "gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        folders.put_once(spark, f"{path}/index.json", dict(version=snapshot.version, buckets=n, records=own.count(), folders=snapshot.manifest["tables"]["records"]))
        return SearchIndex(spark, path)

    def search(self, snapshot: Snapshot, query: str | None) -> DataFrame:
        """The records that ``store.search`` finds in this snapshot."""
        q = (query or "").lower()
        rare = self._rarest({q[k : k + GRAM] for k in range(len(q) - GRAM + 1)})
        if rare is None:
            return S.search(snapshot.records(), query)
        then, now = self.about["folders"], snapshot.manifest["tables"]["records"]
        same = {int(b) for b in now if then.get(b) == now[b]}
        changed = S.search(snapshot.read(buckets=[int(b) for b in now if int(b) not in same]), query)
        if not rare:
            return changed
        met = self._postings(rare).filter(F.col("gram").isin(rare)).groupBy("id", "at").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare))
        met = met.select("id", "at")
        wanted = same & {r["at"] for r in met.select("at").distinct().collect()}  # buckets of the store at most
        own = snapshot.read(buckets=wanted)
        return S.search(own.join(met.select("id"), "id", "left_semi").select(*own.columns), query).union(changed)

    def _rarest(self, grams: set[str]) -> list[str] | None:
        """Grams to look up; none if one of them is nowhere, None if reading all records is as good."""
        if not grams:
            return None
        known = {r["gram"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/counts").filter(F.col("gram").isin(sorted(grams))).collect()}
        if len(known) < len(grams):
            return []
        few = sorted(grams, key=lambda g: (known[g], g))[:MOST_GRAMS]
        return None if known[few[0]] > COMMON * self.about["records"] else few

    def _postings(self, grams: list[str]) -> DataFrame:
        """The buckets of these grams."""
        found = sorted({f"{self.path}/postings/bucket={bucket_named(g, self.about['buckets'])}" for g in grams})
        return self.spark.read.schema("gram string, id long, at int").parquet(*found)
