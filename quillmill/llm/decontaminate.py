"""Benchmark decontamination by winnowed fingerprints and exact extension.

Of every window of ``WINDOW`` words the smallest hash of its ``GRAM``-word grams
is kept, so a shared run of ``WINDOW`` words always has a fingerprint in common.
Documents' fingerprints are joined with the benchmark's; for the few that meet,
the windows they stand for are compared word by word, so hits are exact.  Each
fingerprint carries the words of its windows, so a text is read once and never
shuffled.  Items shorter than a window are one window of their own length.

The benchmark side is broadcast only while its counted windows stay within
``BROADCAST_ROWS``; beyond, the same joins are shuffled.

Defined results: null, empty and word-less texts have no words and no hits;
repeated rows each get their own result; word-less items never occur; equal
items all count; an empty benchmark or an empty document table gives no hits or
no rows; all items without an id count as one, whose id is null in ``items``;
documents without an id get their results like all; further columns are ignored
unless named in ``keep``, where names of results are an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._native import kept_columns, let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _grams(words: Column, n: int) -> Column:
    """Hashes of all n-word grams, in order."""
    last = F.size(words) - n
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, n)))
    ).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, width: int) -> Column:
    """The smallest of each ``width`` consecutive hashes."""

    def slide(hashes: Column) -> Column:
        last = F.size(hashes) - width
        return F.when(
            last >= 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.least(*[F.get(hashes, i + j) for j in range(width)])
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(grams, slide)


_RUN = "array<struct<fp:bigint,at:int,len:int,words:string>>"


def _runs(words: Column, minima: Column) -> Column:
    """A struct for each run of windows with one minimum: fingerprint, first window, window length, words."""

    def cut(changes: Column) -> Column:
        ends = F.concat(F.slice(changes, 2, F.size(changes)), F.array(F.size(minima)))
        return F.zip_with(
            changes, ends,
            lambda a, b: F.struct(
                F.get(minima, a).alias("fp"), a.cast("int").alias("at"), F.lit(WINDOW).alias("len"),
                F.array_join(F.slice(words, a + 1, b - a + WINDOW - 1), " ").alias("words"),
            ),
        )

    changes = F.filter(
        F.sequence(F.lit(0), F.size(minima) - 1), lambda i: (i == 0) | (F.get(minima, i) != F.get(minima, i - 1))
    )
    return F.when(F.size(minima) > 0, let(changes, cut)).otherwise(F.array().cast(_RUN))


def _short(words: Column, n: int) -> Column:
    """A struct for each window of n < WINDOW words."""
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))),
        lambda i: F.struct(
            F.xxhash64(F.lit(n), F.slice(words, i + 1, n)).alias("fp"), i.cast("int").alias("at"), F.lit(n).alias("len"),
            F.array_join(F.slice(words, i + 1, n), " ").alias("words"),
        ),
    )
    return F.when(F.size(words) >= n, each).otherwise(F.array().cast(_RUN))


def _windows(run: DataFrame) -> DataFrame:
    """Each window of each run: its first word's place and its words."""
    each = let(
        F.split("words", " ", -1),
        lambda parts: F.transform(
            F.sequence(F.lit(0), F.size(parts) - F.col("len")),
            lambda i: F.struct((F.col("at") + i).cast("int").alias("pos"), F.array_join(F.slice(parts, i + 1, F.col("len")), " ").alias("win")),
        ),
    )
    each = F.when(F.col("len") > 0, each).otherwise(F.array(F.struct(F.col("at").alias("pos"), F.col("_row").cast("string").alias("win"))))
    return run.withColumn("_w", F.explode(each))


def contaminated_words(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, n_words, hits array<struct<pos,len>>, items array of item ids) for each row of docs."""
    own = kept_columns([id_col, *keep], ("n_words", "hits", "items"))
    items = bench.select(F.col(item_col).alias("_item"), words_of(F.col(item_text_col)).alias("_w")).filter(F.size("_w") > 0)
    items = items.withColumn("_n", F.least(F.size("_w"), F.lit(WINDOW)))
    shorter = [r[0] for r in items.filter(F.col("_n") < WINDOW).select("_n").distinct().collect()]  # at most WINDOW - 1 numbers

    width = WINDOW - GRAM + 1
    item_windows = items.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("_n")))).select(
        "_item", "_n", F.slice("_w", F.col("_i") + 1, F.col("_n")).alias("_x")
    )
    fp = F.when(F.col("_n") < WINDOW, F.xxhash64(F.col("_n"), F.col("_x"))).otherwise(F.array_min(_grams(F.col("_x"), GRAM)))
    known = item_windows.groupBy("_n", F.array_join("_x", " ").alias("win"), fp.alias("fp")).agg(
        F.collect_set(F.struct("_item")).alias("_items")  # a struct, since sets leave nulls out
    )
    fps = known.select("fp").distinct()
    windows = known.select(F.col("_n").alias("len"), "win", "_items")
    if known.count() <= BROADCAST_ROWS:
        fps, windows = F.broadcast(fps), F.broadcast(windows)

    words = docs.select(F.struct(*own).alias("_own"), F.monotonically_increasing_id().alias("_row"), words_of(F.col(text_col)).alias("_w"))
    grams = words.withColumn("_m", _minima(_grams(F.col("_w"), GRAM), width))
    first = F.array(F.struct(
        F.xxhash64("_row").alias("fp"), F.size("_w").alias("at"), F.lit(0).alias("len"), F.lit("").alias("words")
    ))
    runs = grams.select(
        "_own", "_row",
        F.explode(F.concat(first, _runs(F.col("_w"), F.col("_m")), *[_short(F.col("_w"), n) for n in shorter])).alias("_r"),
    ).select("_own", "_row", "_r.*")
    # One row for each document (len 0), and the runs whose fingerprint the benchmark has.  The former are kept whatever
    # they meet, so their keys are hashes and numbers of the row: where the joins are shuffled, no task gets all of them.
    met = runs.join(fps.withColumn("_met", F.lit(True)), "fp", "left").filter((F.col("len") == 0) | F.col("_met"))
    spots = _windows(met).select("_own", "_row", "len", "at", F.col("_w.pos").alias("pos"), F.col("_w.win").alias("win"))
    hits = spots.join(windows, ["len", "win"], "left").filter((F.col("len") == 0) | F.col("_items").isNotNull())
    return hits.groupBy("_row", "_own").agg(
        F.max(F.when(F.col("len") == 0, F.col("at"))).cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("len") > 0, F.struct("pos", "len"))).alias("hits"),
        F.transform(F.array_distinct(F.flatten(F.collect_set("_items"))), lambda x: x["_item"]).alias("items"),
    ).select("_own.*", "n_words", "hits", "items")


def covered(hits: Column) -> Column:
    """How many words the windows cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(x["pos"], acc["end"]))).cast("long").alias("n"),
        )

    return F.aggregate(F.array_sort(hits), start, step, lambda a: a["n"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '{}')".format(UPPER, LOWER, GAP.replace("[", "[^"))
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT item_id, {_WORDS} w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') win FROM (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM (SELECT *, least(len(w), {WINDOW}) n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
