"""A training corpus from ``documents``: language, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes a stage's result to the shared folder and reads it back, so
a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import bpe, decontaminate, langid, near_dedup, pii
from quillmill.llm._native import fresh
from quillmill.llm._scratch import Scratch

#: Dropped rows that are broadcast against the documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs without the rows of ``gone`` (doc_id, text_name), which may have null ids."""
    gone = Scratch(docs.sparkSession, "pipeline").put(gone.distinct(), name)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    mark = fresh(docs, "_name")
    own = docs.withColumn(mark, F.xxhash64("text"))
    same = own["doc_id"].eqNullSafe(gone["doc_id"]) & (own[mark] == gone["text_name"])
    return own.join(gone, same, "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; ``lang`` becomes what was found.  Null and letterless texts go."""
    model = langid.fit(docs)
    mark = fresh(docs, "_found")
    found = docs.withColumn(mark, langid.predicted(F.col("text"), model)["lang_pred"])
    return found.filter(F.col(mark) != langid.UNKNOWN).select(
        *[F.col(mark).alias(c) if c == "lang" else F.col(c) for c in docs.columns]
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id; of the rows of one id, one."""
    scratch = Scratch(spark, "pipeline")
    groups = scratch.put(near_dedup.near_duplicates(docs), "groups")
    ids = scratch.put(groups.filter(~F.col("kept")).select("doc_id").distinct(), "copies")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    left = docs.join(few, "doc_id", "left_anti").select(*docs.columns)
    again = groups.filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = scratch.put(again, "again")
    if not again.limit(1).count():
        return left
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    place = fresh(docs, "_place")
    one = left.join(few, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*docs.columns)
    return left.join(few, "doc_id", "left_anti").select(*docs.columns).union(one)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_name"))
    hits = decontaminate.contaminated_words(named, bench, keep=("text_name",)).filter(F.size("hits") > 0)
    return _without(docs, hits.select("doc_id", "text_name"), "contaminated")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, confirmed personal data replaced by its kind."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, lossless): token ids, and whether they decode to the text."""
    return bpe.encode_documents(docs, bpe.tokenizer_path(), keep=("doc_id", "lang", "source"), results=("ids", "lossless"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_free", benchmark_free),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Not expressible: merging pairs by rank until none is left, and the language profiles.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
