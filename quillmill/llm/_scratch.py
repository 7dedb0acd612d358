"""Intermediate tables in the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that go to the JVM at once.
PIECE = 1 << 20
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests), a temporary folder of this process, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster the tables of a run need a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quillmill-")
        atexit.register(_remove, _OWN["dir"])
    return "file://" + _OWN["dir"]


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """The tables of one run.  ``put`` writes a table and reads it back: its lineage is the files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{folder(spark)}/quillmill/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        out = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def put_file(self, raw: bytes, name: str) -> str:
        """Write a file of bounded size; returns where it is."""
        p, files = self._at(name)
        out = files.create(p)
        try:
            for at in range(0, len(raw), PIECE):
                out.write(bytearray(raw[at : at + PIECE]))
        finally:
            out.close()
        return p.toString()

    def drop(self, name: str) -> None:
        """Delete a table that nothing lazy reads any more."""
        p, files = self._at(name)
        files.delete(p, True)

    def _at(self, name: str) -> tuple:
        """Hadoop's path and file system of a table or file of this run."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())
