"""Importance resampling against counting feature by feature."""

import random
import zlib

import numpy as np
import pytest

from quillmill.llm import importance as imp

TARGET = ["alpha beta gamma delta", "the of and alpha", None, "", "x" * 90 + " beta", "Zeta eta 12 théta"]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def run(spark, rows, target, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    return ordered(imp.resample(docs, aim, **more).select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("ngrams, piece", [(1, 1 << 21), (2, 1 << 21), (2, 64), (3, 40), (2, 5)])
def test_equals_brute_force(spark, texts, monkeypatch, ngrams, piece):
    monkeypatch.setattr(imp, "SLICE", piece)
    rows = [*texts[:-2], (texts[-2][0], texts[-2][1][:4000]), (None, "a text without an id " * 9), (None, None), (1, texts[0][1]), (1, "another text of the same id " * 5)]
    rows += [(900, "w" * 200 + " " + "é" * 150 + " short"), (901, "A-b_C1 ÄÖ x y \u0000z " * 30)]
    more = dict(ngrams=ngrams, min_words=5, percent=40, buckets=500)
    assert run(spark, rows, TARGET, **more) == ordered(imp.brute_force(rows, TARGET, **more))


def test_ranks_are_whole_over_many_partitions_and_ties(spark):
    rows = [(i, f"w{i % 7} " * 25) for i in range(400)] + [(i, "one word") for i in range(400, 450)]
    got = run(spark, rows, TARGET)
    assert got == ordered(imp.brute_force(rows, TARGET))
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 101))


def test_empty_tables(spark):
    assert run(spark, [], TARGET) == []
    rows = [(1, "a b c " * 10), (2, None)]
    assert run(spark, rows, []) == ordered(imp.brute_force(rows, []))


def test_clashing_columns_and_bounds(docs, empty):
    assert imp.resample(docs, docs).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert imp.resample(docs, docs).count() == docs.count()
    with pytest.raises(ValueError):
        imp.streams(docs, buckets=70_000)


def test_checksums_of_words_and_of_joined_words():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcxyz\xc3\xa9") for _ in range(rng.choice([1, 2, 5, 9, 47, 48, 49, 50, 130]))) for _ in range(300)]
    got = imp.Words([b" ".join(words[:150]), b"-".join(words[150:])])
    assert got.crc.tolist() == [zlib.crc32(w) for w in words]
    assert got.spaced.tolist() == [zlib.crc32(b" " + w) for w in words]
    pairs = imp.appended(got.crc[:-1], got.spaced[1:], got.length[1:] + 1)
    assert pairs.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def test_streams_are_packed_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(imp, "SLICE", 1000)
    docs = spark.createDataFrame([(1, "word " * 5000), (2, "a b"), (3, "y" * 9000)], "doc_id long, text string").coalesce(1)
    rows = imp.streams(docs).collect()
    assert max(len(r["stream"]) for r in rows) <= 2 * 2 * 210
    assert sum(len(r["stream"]) for r in rows) == 2 * (9999 + 3 + 1)
    assert sum(len(r["docs"]) for r in rows if r["whole"]) == 1
    assert np.frombuffer(rows[0]["stream"], np.uint16).max() < imp.BUCKETS


def test_query_equals_brute_force_on_its_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    got = imp.op12_importance(spark, sf_dir)
    assert ordered(got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == ordered(imp.brute_force(docs, target))


def test_query_equals_its_sql(compare):
    compare(imp.op12_importance, imp.SQL)
