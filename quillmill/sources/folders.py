"""Folders that all machines share, and small files in them."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir.  Only a local master may do without: its threads share this machine's temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="quillmill-")
            atexit.register(shutil.rmtree, _OWN["dir"], True)
        named = "file://" + _OWN["dir"]
    return f"{named}/quillmill/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p, files = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(p)) if files.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, files = _at(spark, path)
    files.delete(p, True)


def put_once(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a JSON file that nobody sees half written; False if the name is taken."""
    at = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    p, files = _at(spark, at)
    out = files.create(p, False)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    never = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # not over another file
    try:
        hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, target, never)
    except Py4JJavaError:
        files.delete(p, False)
        if not files.exists(target):
            raise
        return False
    return True


def get(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
