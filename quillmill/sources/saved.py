"""Stored bills in a shared folder: saves that last, and lookups that read a few files.

Records are dealt into buckets by their number and sorted by it in each; two small
tables tell the bucket of an id and of an image's hash, and are in buckets by
these.  A save judges the new rows against the buckets that their numbers fall
into, writes the buckets that change to a new folder and then commits: a manifest,
which names the folder of each bucket, appears under the next number by a rename
that never replaces a file.  So a save that dies leaves files that no manifest
names, two writers can't both commit one version (the later begins anew on what the
other stored), and a reader works on the manifest it pinned.

A save with a ``token`` and ``number`` is applied once, however often it is
repeated; only the last number of each token is remembered, so numbers must rise.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources import folders
from quillmill.sources import store as S

#: Buckets of a new store; a bucket of many rows is several files, each of a range of numbers.
BUCKETS = 32
TRIES = 5
#: Rows of a bucket that a Bloom filter is made for.
FILTER_ROWS = 100_000


class Conflict(RuntimeError):
    """Others have committed again and again."""


def bucket_of(key: Column, instead: Column, buckets: int) -> Column:
    """The bucket of a key; a row without one may be anywhere, so it goes where ``instead`` says."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.coalesce(instead.cast("string"), F.lit(""))))), F.lit(buckets)).cast("int")


def bucket_named(key: object, buckets: int) -> int:
    return zlib.crc32(str(key).encode()) % buckets


@dataclass(frozen=True)
class Snapshot:
    """The store as one manifest names it."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def key(self) -> str:
        return self.manifest["key"]

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    def schema(self, name: str = "records") -> T.StructType:
        own = T.StructType.fromJson(json.loads(self.manifest["schema"]))
        if name == "records":
            return own
        first = T.StructField("invoiceHash", T.StringType()) if name == "hashes" else None
        return T.StructType([*([first] if first else []), own["id"], T.StructField("at", T.IntegerType())])

    def read(self, name: str = "records", buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or some buckets of it; no other file is listed or opened."""
        known = self.manifest["tables"][name]
        wanted = known if buckets is None else [str(b) for b in sorted(set(buckets)) if str(b) in known]
        found = [f"{self.path}/{known[b]}" for b in wanted]
        schema = self.schema(name)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        return self.read()

    def by_bill_no(self, number: str) -> DataFrame:
        """The record of a number with the least id, from one bucket."""
        own = self.read(buckets=[bucket_named(number, self.buckets)])
        return own.filter(F.col(self.key) == number).orderBy("id").limit(1)

    def by_id(self, record_id: int) -> DataFrame:
        """One record, from one bucket of ids and one of records."""
        at = self.read("ids", [bucket_named(record_id, self.buckets)]).filter(F.col("id") == record_id).select("at").distinct().limit(2).collect()
        return self.read(buckets=[r["at"] for r in at]).filter(F.col("id") == record_id)

    def by_hash(self, image_hash: str | None) -> DataFrame:
        """The record of an image with the least id; none for an empty hash."""
        if not image_hash:
            return self.read(buckets=[])
        own = self.read("hashes", [bucket_named(image_hash, self.buckets)]).filter(F.col("invoiceHash") == image_hash)
        first = own.agg(F.min(F.struct("id", "at")).alias("x")).collect()[0]["x"]
        return self.read(buckets=[first["at"]]).filter(F.col("id") == first["id"]) if first else self.read(buckets=[])

    def applied(self, token: str) -> dict | None:
        return self.manifest["applied"].get(token)

    def rejected(self, token: str) -> DataFrame:
        """What the last save of a token rejected."""
        return _refused(self.spark, f"{self.path}/{self.manifest['applied'][token]['judged']}")


class BillStore:
    """Opened by its folder; ``create`` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(spark: SparkSession, path: str, records: DataFrame, key: str = "billNo", buckets: int = BUCKETS) -> BillStore:
        """A store of these records as version 0; each id must be there once.  ``key`` is the column that is unique."""
        store = BillStore(spark, path)
        out = f"data/{uuid.uuid4().hex}"
        empty = dict(version=-1, key=key, buckets=buckets, schema=records.schema.json(), applied={}, tables=dict(records={}, ids={}, hashes={}))
        before = Snapshot(spark, store.path, empty)
        staged = store._staged(records.select("*", bucket_of(F.col(key), F.col("id"), buckets).alias("at")), f"{out}/new")
        tables = store._written(before, out, staged.drop("at"), staged.select("id", "at"), store._hashed(staged), None, None, None)
        folders.remove(spark, f"{store.path}/{out}/new")
        if not store._commit(empty | dict(version=0, tables=tables)):
            raise Conflict(path)
        return store

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in folders.names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0] != "."]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one."""
        n = max(self.versions()) if version is None else version
        return Snapshot(self.spark, self.path, folders.get(self.spark, f"{self.path}/manifests/{n:012d}.json"))

    def save(
        self, new: DataFrame, token: str | None = None, number: int = 0, errors: Column | None = None, replace: bool = True,
        before_commit: Callable[[], None] | None = None,
    ) -> tuple[Snapshot, DataFrame]:
        """(the store after the save, rejected rows with ``errors``).

        Rows with ``errors`` (array of strings) are rejected, the others judged as by
        ``store.judged``.  A row without an id gets one beyond all others;
        missing ``createdAt`` is now, missing ``synced`` false.
        """
        for _ in range(TRIES):
            now = self.snapshot()
            done = now.applied(token) if token else None
            if done and done["number"] >= number:
                return now, now.rejected(token)
            after = self._saved(now, new, token, number, errors, replace, before_commit)
            if after:
                return self.snapshot(after["version"]), _refused(self.spark, f"{self.path}/{after['judged']}")
        raise Conflict(self.path)

    def delete(self, ids: DataFrame) -> Snapshot:
        """The store without the records of these ids."""
        for _ in range(TRIES):
            now, out = self.snapshot(), f"data/{uuid.uuid4().hex}"
            gone = self._staged(ids.select("id").distinct(), f"{out}/gone")
            nothing = self.spark.createDataFrame([], T.StructType([*now.schema().fields, T.StructField("at", T.IntegerType())]))
            tables = self._changed(now, out, nothing, gone)
            folders.remove(self.spark, f"{self.path}/{out}/gone")
            if self._commit(now.manifest | dict(version=now.version + 1, tables=tables)):
                return self.snapshot(now.version + 1)
        raise Conflict(self.path)

    def clean(self, keep: int = 2) -> None:
        """Forget all but the newest versions and delete the files that only they named.  No save may be running, and no older version be read."""
        kept = [self.snapshot(v).manifest for v in self.versions()[-keep:]]
        used = {f.split("/")[1] for m in kept for t in m["tables"].values() for f in t.values()} | {a["judged"].split("/")[1] for m in kept for a in m["applied"].values()}
        for v in self.versions()[:-keep]:
            folders.remove(self.spark, f"{self.path}/manifests/{v:012d}.json")
        for name in folders.names(self.spark, f"{self.path}/data"):
            if name not in used:
                folders.remove(self.spark, f"{self.path}/data/{name}")

    def _staged(self, df: DataFrame, where: str) -> DataFrame:
        """Written once, since what follows reads it several times."""
        df.write.parquet(f"{self.path}/{where}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{where}")

    def _saved(self, now: Snapshot, new: DataFrame, token: str | None, number: int, errors: Column | None, replace: bool, before_commit: Callable | None) -> dict | None:
        out = f"data/{uuid.uuid4().hex}"
        own = now.schema()
        here = {c.lower() for c in new.columns}
        rows = new.select(*[(F.col(f.name).cast(f.dataType) if f.name.lower() in here else F.lit(None).cast(f.dataType)).alias(f.name) for f in own], (F.lit(None) if errors is None else errors).cast("array<string>").alias("errors"))
        if "createdAt" in own.names:
            rows = rows.withColumn("createdAt", F.coalesce("createdAt", F.current_timestamp().cast(own["createdAt"].dataType)))
        if "synced" in own.names:
            rows = rows.withColumn("synced", F.coalesce("synced", F.lit(False)))
        beyond = now.read("ids").agg(F.coalesce(F.max("id"), F.lit(0))).collect()[0][0] if rows.filter("id IS NULL").limit(1).count() else 0
        rows = rows.withColumn("id", F.coalesce("id", F.monotonically_increasing_id() + beyond + 1))
        rows = self._staged(rows.withColumn("at", bucket_of(F.col(now.key), F.col("id"), now.buckets)), f"{out}/new")
        wrong = rows.filter(F.size("errors") > 0)
        fine = rows.filter(F.coalesce(F.size("errors"), F.lit(0)) <= 0).drop("errors")
        known = now.read(buckets=_distinct(fine.select("at"))).select("id", now.key)
        told = f"{out}/judged"
        seen = self._staged(S.judged(known, fine, now.key, replace).unionByName(wrong), told)
        good = seen.filter("errors IS NULL").drop("errors")
        tables = self._changed(now, out, good, good.select("id"))
        folders.remove(self.spark, f"{self.path}/{out}/new")
        after = now.manifest | dict(version=now.version + 1, tables=tables, judged=told)
        if token:
            after["applied"] = now.manifest["applied"] | {token: dict(number=number, judged=told)}
        if before_commit:
            before_commit()
        return after if self._commit(after) else None

    def _changed(self, now: Snapshot, out: str, good: DataFrame, gone: DataFrame) -> dict:
        """The tables without the ids of ``gone`` and with the rows of ``good`` (and ``at``); only buckets that change are read and written."""
        n = now.buckets
        id_buckets = _distinct(gone.select(bucket_of(F.col("id"), F.col("id"), n)))
        ids = now.read("ids", id_buckets)
        moved = ids.join(gone, "id", "left_semi")
        touched = _distinct(moved.select("at").union(good.select("at")))
        records = now.read(buckets=touched)
        lost = records.join(gone, "id", "left_semi")
        hash_buckets = _distinct(self._hashed(lost.withColumn("at", F.lit(0))).union(self._hashed(good)).select(bucket_of(F.col("invoiceHash"), F.col("id"), n)))
        without = lambda df: df.join(gone, "id", "left_anti").select(*df.columns)
        return self._written(
            now, out, without(records).unionByName(good.drop("at")), without(ids).unionByName(good.select("id", "at")),
            without(now.read("hashes", hash_buckets)).unionByName(self._hashed(good)), touched, id_buckets, hash_buckets,
        )

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """(invoiceHash, id, at) of rows with a hash."""
        if "invoiceHash" not in rows.columns:
            return rows.select(F.lit(None).cast("string").alias("invoiceHash"), "id", "at").limit(0)
        return rows.filter(F.coalesce("invoiceHash", F.lit("")) != "").select("invoiceHash", "id", "at")

    def _written(self, now: Snapshot, out: str, records: DataFrame, ids: DataFrame, hashes: DataFrame, *touched: list[int] | None) -> dict:
        """Manifest tables after writing these contents of the touched buckets (None: all)."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def write(name: str, df: DataFrame, key: str, old: list[int] | None) -> dict:
            known = {b: f for b, f in now.manifest["tables"][name].items() if old is not None and int(b) not in old}
            if old == []:
                return known
            rows = df.withColumn("bucket", bucket_of(F.col(key), F.col("id"), now.buckets)).repartitionByRange(parts, "bucket", key, "id").sortWithinPartitions("bucket", key, "id")
            rows.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(FILTER_ROWS)).parquet(f"{self.path}/{out}/{name}")
            found = [x for x in folders.names(self.spark, f"{self.path}/{out}/{name}") if x.startswith("bucket=")]
            return known | {x.removeprefix("bucket="): f"{out}/{name}/{x}" for x in found}

        todo = [("records", records, now.key), ("ids", ids, "id"), ("hashes", hashes, "invoiceHash")]
        with ThreadPoolExecutor(len(todo)) as pool:  # three independent jobs
            made = pool.map(lambda x: write(*x[0], x[1]), zip(todo, touched))
            return {name: tables for (name, _, _), tables in zip(todo, made)}

    def _commit(self, manifest: dict) -> bool:
        return folders.put_once(self.spark, f"{self.path}/manifests/{manifest['version']:012d}.json", manifest)


def _refused(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a save that were not stored, with ``errors``."""
    return spark.read.parquet(path).filter("errors IS NOT NULL").drop("at")


def _distinct(buckets: DataFrame) -> list[int]:
    """Bucket numbers: as many as a store has at most."""
    return [r[0] for r in buckets.distinct().collect()]
