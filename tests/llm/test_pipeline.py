"""The registered queries against their SQL, and the pipeline against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import bpe, langid, near_dedup, pii, registry

tokenizers = pytest.importorskip("tokenizers")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(compare, name):
    compare(registry.queries()[name], registry.oracle_sql()[name])


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark_free", "personal_data", "tokens"]


def test_entry_has_all_eleven_queries():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {q.split("_")[0] for q in entry.queries()}


def test_run_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs)
    found = {i: model.predict(r["text"])[0] for i, r in rows.items()}
    left = {i for i in rows if found[i] != "und"}
    kept = {i for i, *_, own in near_dedup.brute_force([(i, rows[i]["text"]) for i in left], words=5) if own}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else ({tuple(w)} if w else set())
    sizes = {len(w) for w in windows}
    clean = set()
    for i in kept:
        w = words(rows[i]["text"])
        if not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1)):
            clean.add(i)
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs).collect()}
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == clean and clean < kept < set(rows)
    for i, r in got.items():
        assert r["ids"] == library.encode(masked[i], add_special_tokens=False).ids and r["lossless"] and r["lang"] == found[i]
    assert any(masked[i] != rows[i]["text"] for i in clean)


def test_null_ids_and_repeated_rows_pass_through(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bad = docs.limit(1).selectExpr("cast(NULL AS bigint) doc_id", "text", "lang", "source", "n_chars")
    both = docs.limit(30).union(bad).union(docs.selectExpr("doc_id", "cast(NULL AS string) text", "lang", "source", "n_chars").limit(2))
    both = both.union(docs.orderBy("doc_id").limit(1))  # a row that repeats an id
    out = both
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns
    assert out.filter("text IS NULL").count() == 0
    assert out.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").count() == 0


def test_stages_on_an_empty_table_and_with_clashing_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for name in ("_name", "_found", "_spans", "id", "row", "node", "kept", "_place"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    for rows in (docs.limit(0), docs):
        out = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf_dir)
            assert out.columns == docs.columns
        assert corpus_pipeline.tokens(spark, out, sf_dir).count() == out.count()
