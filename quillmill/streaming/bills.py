"""New bills as a stream: the operators are pure, so the same ones run on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillmill.functions.text import image_hash
from quillmill.sources.saved import BillStore

SCHEMA = "bill_id long, text string, arrived timestamp"


def incoming(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Parquet files of new bills, each image or text once within the watermark."""
    new = spark.readStream.schema(SCHEMA).parquet(path).withWatermark("arrived", late)
    return new.withColumn("invoiceHash", image_hash(F.col("text"))).dropDuplicatesWithinWatermark(["invoiceHash"])


def extracted(stream: DataFrame) -> DataFrame:
    """The mobile scanner's fields of each new bill."""
    from quillmill.functions.text import mobile_normalize
    from quillmill.operators import mobile

    t = mobile_normalize(F.col("text"))
    return stream.select(
        "bill_id", "arrived", mobile.invoice_no(t).alias("invoice_no"), mobile.bill_date(t).alias("date"), mobile.net_total(t).alias("total")
    )


def stored(stream: DataFrame, store: BillStore, name: str) -> DataStreamWriter:
    """A writer of a stream of new bills (rows of the store) that saves each micro-batch.

    A number that an earlier batch has stored is rejected, so of each number the first stays, over
    the whole stream.  The store knows the last batch it took of ``name``: one that is
    replayed after a failure is not applied again.  Start it with a checkpointLocation.
    """

    def save(batch: DataFrame, number: int) -> None:
        store.save(batch, token=name, number=number)

    return stream.writeStream.foreachBatch(save).queryName(name)
