"""Several scans of one bill, and how far each field can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.numbers import trim
from quillmill.functions.text import two_decimals


def vote(passes: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, field, value, confidence) from (id, pass, field, value).

    The most frequent value that is not blank; of equals, whole numbers without
    leading zeros come first, the smallest of them, then what was seen first.
    confidence: the share of such values that agree, 0 where there is none.
    """
    some = passes.filter(trim(F.coalesce("value", F.lit(""))) != "")
    counted = some.groupBy(id_col, "field", "value").agg(F.count("*").alias("n"), F.min("pass").alias("first"))
    number = F.when(F.col("value").rlike(r"^(?:0|[1-9]\d{0,9})\z"), F.col("value").cast("long"))
    number = F.when(number < 4294967295, number)
    counted = counted.withColumn("num", number)
    order = Window.partitionBy(id_col, "field").orderBy(F.desc("n"), F.col("num").isNull(), "num", "first")
    ranked = counted.withColumn("r", F.row_number().over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(id_col, "field")))
    best = ranked.filter("r = 1").select(id_col, "field", "value", (F.col("n") / F.col("all")).alias("confidence"))
    fields = passes.select(id_col, "field").distinct()
    return fields.join(best, [id_col, "field"], "left").select(
        id_col, "field", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def vote_confidence(voted: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, overall): the mean of the fields' confidences."""
    return voted.groupBy(id_col).agg(F.avg("confidence").alias("overall"))


def rated(fields: DataFrame) -> DataFrame:
    """(…, confidence, needs_review, status) with confidence rounded to two decimals."""
    c = F.col("confidence")
    status = F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")
    return fields.select(
        *[x for x in fields.columns if x not in ("confidence", "value")], F.coalesce("value", F.lit("")).alias("value"),
        (c < 0.7).alias("needs_review"), status.alias("status"), two_decimals(c).alias("confidence"),
    )


def looked_up(wanted: DataFrame, ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Ratings of the wanted fields; a field without one has confidence 0, needs review and is of unknown status."""
    return wanted.join(ratings, keys, "left").select(
        *keys, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("needs_review", F.lit(True)).alias("needs_review"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
    )


def overall(ratings: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, average, low_fields, needs_review, total_fields, poor) of rated fields."""
    low = F.sort_array(F.collect_list(F.when(F.col("needs_review"), F.col("field"))))
    out = ratings.groupBy(id_col).agg(F.avg("confidence").alias("a"), low.alias("low_fields"), F.count("*").alias("total_fields"))
    average = two_decimals(F.col("a"))
    return out.select(
        id_col, average.alias("average"), "low_fields", (F.size("low_fields") > 0).alias("needs_review"), "total_fields",
        ((average * 100 < 50) | (F.size("low_fields") >= 3)).alias("poor"),
    )


def field_confidence(fields: DataFrame, words: DataFrame, document: Column | None = None, id_col: str = "bill_id") -> DataFrame:
    """(id, field, value, confidence): the mean confidence of the words a value holds or is held by.

    ``words`` are folded into one array for each bill first, so fields meet the
    words of their own page only.  A value without such words has the document's
    confidence (0.5 if unknown), a blank one 0.
    """
    page = words.groupBy(id_col).agg(F.collect_list(F.struct(F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("confidence", F.lit(0.0)).alias("c"))).alias("w"))
    value = F.lower("value")
    hits = F.filter("w", lambda x: F.contains(value, x["t"]) | F.contains(x["t"], value))
    mean = F.aggregate("_h", F.lit(0.0), lambda a, x: a + x["c"], lambda a: a / F.size("_h")) / 100
    both = fields.join(page, id_col, "left").withColumn("_h", F.coalesce(hits, F.array().cast("array<struct<t:string,c:double>>")))
    blank = trim(F.coalesce("value", F.lit(""))) == ""
    other = F.coalesce(document / 100 if document is not None else F.lit(None).cast("double"), F.lit(0.5))
    return both.select(id_col, "field", "value", F.when(blank, 0.0).when(F.size("_h") == 0, other).otherwise(mean).alias("confidence"))
