"""Stored bills: looking up, saving, deleting, searching, exporting.

A save is one plan: the new rows are checked against the stored ones and each
other, so no other writer's rows can slip in between a check and a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_IMAGE_BYTES = 10 * 1024 * 1024
EXPORT = ("Bill No", "Date", "Customer", "GST", "Total", "Created At", "Synced")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of up to 10 MB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(path)
    return files.filter(F.col("length") <= MAX_IMAGE_BYTES)


def by_bill_no(records: DataFrame, bill_no: str) -> DataFrame:
    return records.filter(F.col("billNo") == bill_no).orderBy("id").limit(1)


def by_hash(records: DataFrame, image_hash: str | None) -> DataFrame:
    """The first record of an image; none for an empty hash."""
    return records.filter((F.col("invoiceHash") == (image_hash or "")) & F.lit(bool(image_hash))).orderBy("id").limit(1)


def by_id(records: DataFrame, record_id: int) -> DataFrame:
    return records.filter(F.col("id") == record_id)


def duplicates(records: DataFrame, key: str) -> DataFrame:
    """Records whose key (billNo, or invoiceHash) another record has too; blank keys match nothing."""
    many = records.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    return records.join(many, key, "left_semi")


def first_of_each(records: DataFrame, key: str = "billNo") -> DataFrame:
    """What saving the records one after another would keep: the first of each key.  Rows without a key are all kept."""
    order = Window.partitionBy(key, F.when(F.col(key).isNull(), F.col("id"))).orderBy("createdAt", "id")
    return records.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") == 1) | F.col(key).isNull()).drop("_r")


def judged(known: DataFrame, new: DataFrame, key: str = "billNo", replace: bool = True) -> DataFrame:
    """new with ``errors``: null for rows to store, else why not; by the (id, key) of what is stored.

    Of new rows of one id the newest counts, of those of one number the first; a
    number that a stored record of another id has (of any, unless ``replace``) is
    taken, as the store was before.  Rows without a number clash with nothing.
    """
    name = lambda c: f"_{c}_"
    of_id = Window.partitionBy("id", F.when(F.col("id").isNull(), F.xxhash64(*new.columns))).orderBy(F.col("createdAt").desc_nulls_last(), key)
    last = new.withColumn(name("turn"), F.when(F.col("id").isNull(), 1).otherwise(F.row_number().over(of_id)))
    taken = known.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(name("key"))).agg(F.min("id").alias(name("low")), F.max("id").alias(name("high")))
    met = last.join(taken, F.col(key) == F.col(name("key")), "left")
    other = ~(F.col("id").eqNullSafe(F.col(name("low"))) & F.col("id").eqNullSafe(F.col(name("high")))) if replace else F.lit(True)
    free = (F.col(name("turn")) == 1) & ~(F.col(name("key")).isNotNull() & other)
    met = met.withColumn(name("free"), free)
    # A number that many rows have is summed up before it is shuffled.
    order = F.struct("createdAt", "id")
    firsts = met.filter(F.col(name("free")) & F.col(key).isNotNull()).groupBy(F.col(key).alias(name("first"))).agg(F.min(order).alias(name("row")))
    met = met.join(firsts, F.col(key) == F.col(name("first")), "left")
    first = F.col(name("free")) & (F.col(key).isNull() | order.eqNullSafe(F.col(name("row"))))
    why = F.when(F.col(name("turn")) > 1, F.array(F.lit("id: saved again later"))).when(~first, F.array(F.lit(f"{key}: taken")))
    return met.select(*new.columns, why.alias("errors"))


def upsert(records: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records after saving, rejected new rows).  A row replaces the one of its id; another record's billNo rejects it."""
    seen = judged(records, new)
    good = seen.filter("errors IS NULL").drop("errors").withColumn("synced", F.coalesce("synced", F.lit(False)))
    return records.join(good.select("id"), "id", "left_anti").unionByName(good, allowMissingColumns=True), seen.filter("errors IS NOT NULL").drop("errors")


def as_shown(new: DataFrame, shown: str = "Not Found") -> DataFrame:
    """New rows of the mobile store, where what is missing is stored as it was shown."""
    return new.fillna(shown, subset=[c for c, t in new.dtypes if t == "string"])


def insert(records: DataFrame, new: DataFrame, key: str = "invoiceNo", shown: str = "Not Found") -> tuple[DataFrame, DataFrame]:
    """(records after inserting, rejected new rows) of the mobile store: the key is unique, and null is stored as what was shown."""
    filled = as_shown(new, shown)
    fresh = first_of_each(filled.join(records.select(key), key, "left_anti"), key)
    return records.unionByName(fresh, allowMissingColumns=True), filled.join(fresh.select("id"), "id", "left_anti")


def save_errors(as_of: Column, confirmed: bool = False) -> Column:
    """array<string> of what keeps a new row from being saved: its errors, and its warnings unless ``confirmed``."""
    from quillmill.operators.checks import bill_errors, bill_warnings

    text = lambda c: F.col(c).cast("string")
    found = bill_errors(text("billNo"), text("date"), text("customer"), text("total"), as_of)
    return found if confirmed else F.concat(found, bill_warnings(text("gst"), text("total")))


def save_checked(records: DataFrame, new: DataFrame, as_of: Column, confirmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejected with ``errors``): errors reject; warnings do unless ``confirmed``; then as ``upsert``."""
    checked = new.withColumn("errors", save_errors(as_of, confirmed))
    bad = checked.filter(F.size("errors") > 0)
    after, clash = upsert(records, checked.filter(F.size("errors") == 0).drop("errors"))
    return after, bad.unionByName(clash.withColumn("errors", F.array(F.lit("billNo: taken"))))


def delete(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")


def searched(records: DataFrame) -> dict[str, Column]:
    """The texts that a search looks into, in lower case."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return dict(
        billNo=low(F.col("billNo")), customer=low(F.col("customer")), date=low(F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "M/d/yyyy"))
    )


def search(records: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive, in bill number, customer, or the date as M/d/yyyy; an empty query finds all."""
    found = [F.contains(text, F.lit((query or "").lower())) for text in searched(records).values()]
    return records.filter(found[0] | found[1] | found[2])


def filter_sync(records: DataFrame, status: str) -> DataFrame:
    return records if status == "all" else records.filter(F.col("synced") == (status == "synced"))


def filtered(records: DataFrame, query: str | None, status: str = "all") -> DataFrame:
    return filter_sync(search(records, query) if (query or "").strip() else records, status)


def newest_first(records: DataFrame, limit: int | None = None) -> DataFrame:
    out = records.orderBy(F.coalesce("createdAt", F.timestamp_seconds(F.lit(0))).desc(), "id")
    return out if limit is None else out.limit(limit)


def export_rows(records: DataFrame) -> DataFrame:
    """The seven columns of the exports."""
    return records.select(
        F.col("billNo").alias("Bill No"), F.col("date").alias("Date"), F.col("customer").alias("Customer"), F.col("gst").alias("GST"),
        F.col("total").alias("Total"), F.date_format("createdAt", "yyyy-MM-dd HH:mm:ss").alias("Created At"),
        F.when(F.col("synced"), "Yes").otherwise("No").alias("Synced"),
    )


def write_csv(records: DataFrame, path: str) -> None:
    """Every field quoted, quotes in fields doubled."""
    export_rows(records).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(records: DataFrame, path: str) -> None:
    """All columns of all records, nulls included, one JSON object a line, so that no task holds more than a record."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def tiles(records: DataFrame) -> DataFrame:
    """(records, synced, pending, success): one row."""
    n = F.count("*")
    done = F.sum(F.col("synced").cast("int"))
    return records.agg(
        n.alias("records"), F.coalesce(done, F.lit(0)).cast("long").alias("synced"), (n - F.coalesce(done, F.lit(0))).cast("long").alias("pending"),
        F.when(n > 0, "100%").otherwise("—").alias("success"),
    )


def layout_json(layouts: DataFrame, template: str = "template") -> DataFrame:
    """(template, json) of trained layouts, region by region."""
    entry = F.struct("region", F.struct("y", "h", "x", "w").alias("box"))
    return layouts.groupBy(template).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("json"))


def layouts_from_json(saved: DataFrame, template: str = "template") -> DataFrame:
    boxes = F.from_json("json", "map<string,struct<y:double,h:double,x:double,w:double>>")
    return saved.select(template, F.explode(boxes).alias("region", "box")).select(template, "region", "box.*")
