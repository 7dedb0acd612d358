"""Suffix and substring dedup against dictionaries of all runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import _pointers, _repeats, substring_dedup, suffix_dedup


def suffix(docs):
    return sorted((tuple(r) for r in suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


def substring(docs):
    return sorted((tuple(r) for r in substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=repr)


def test_suffix(docs, texts):
    assert suffix(docs) == sorted(suffix_dedup.brute_force(texts), key=repr)


def test_substring(docs, texts):
    assert substring(docs) == sorted(substring_dedup.brute_force(texts), key=repr)


@pytest.mark.parametrize("limit", ["BUCKET_ROWS", "HEAVY_ROWS", "BROADCAST_ROWS"])
def test_limits_change_nothing(docs, texts, monkeypatch, limit):
    monkeypatch.setattr(_repeats, limit, {"BUCKET_ROWS": 1, "HEAVY_ROWS": 1, "BROADCAST_ROWS": -1}[limit])
    assert suffix(docs) == sorted(suffix_dedup.brute_force(texts), key=repr)
    assert substring(docs) == sorted(substring_dedup.brute_force(texts), key=repr)


def test_long_texts_are_cut_in_overlapping_stretches(spark):
    x = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3 * (1 << 20)))
    rows = [(1, x), (2, "start " + x[2_090_000:2_105_000])]
    got = {r[0]: r for r in suffix(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[2][2] >= 15_000 and got[1][2] >= 15_000


@pytest.mark.parametrize("run", [suffix, substring])
def test_empty_table(empty, run):
    assert run(empty) == []


def odd_ids():
    """Several texts without an id, several of one id, and repeated rows, with passages in common."""
    rng = random.Random(8)
    x, y, z = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(120)) for c in "xyz")
    part = " ".join(z.split()[20:100])
    rows = [(None, x + " " + part + " " + x[:70]), (None, y), (None, "few words"), (3, y[:40] + " " + part), (4, "t " + x)]
    return rows + [(5, y), (5, part + " end"), (5, z), (7, "short"), (7, z), (7, z), (9, None), (9, x), (None, None)]


@pytest.mark.parametrize("limit", [None, "BUCKET_ROWS", "HEAVY_ROWS", "BROADCAST_ROWS"])
def test_texts_without_id_and_texts_that_share_one(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(_repeats, limit, {"BUCKET_ROWS": 1, "HEAVY_ROWS": 1, "BROADCAST_ROWS": -1}[limit])
    rows = odd_ids()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert suffix(frame) == sorted(suffix_dedup.brute_force(rows), key=repr)
    want = substring_dedup.brute_force([(-1 if i is None else i, t) for i, t in rows])
    assert substring(frame) == sorted(((None if i == -1 else i, *r) for i, *r in want), key=repr)


def test_a_long_text_of_words(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(9999)}" for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[250_000:253_000])), (3, " ".join(words[:49]))]
    got = {r[0]: r for r in substring(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [got[i][2] for i in (1, 2, 3)] == [0, 3000, 0]


def test_factors_are_copies_of_what_they_name(docs, texts):
    words = {i: (t or "").split() for i, t in texts}
    gone = {i: set() for i in words}
    got = substring_dedup.factors(docs).collect()
    for r in got:
        own, source = words[r["doc_id"]], words[r["source_id"]]
        assert r["source_id"] < r["doc_id"] and r["words"] >= 50
        assert own[r["start"] : r["start"] + r["words"]] == source[r["source_start"] : r["source_start"] + r["words"]]
        gone[r["doc_id"]] |= set(range(r["start"], r["start"] + r["words"]))
    assert sorted((i, len(g)) for i, g in gone.items()) == sorted((r[0], r[2]) for r in substring_dedup.brute_force(texts))
    assert any(r["words"] == 400 for r in got)  # a copied document is one factor


def test_levels_of_refinement_double_and_leave_out_what_is_alone():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 3000).astype(np.uint64)
    x[1000:1300] = x[:300]
    grams = np.array([hash(tuple(x[i : i + 8])) for i in range(len(x))])
    levels = list(_pointers.refined(grams, 8, 200))
    assert [d for d, _ in levels] == [8, 16, 32, 64, 128, 200]
    for depth, ids in levels:
        seen: dict = {}
        for i in range(len(x) - depth + 1):
            assert seen.setdefault(ids[i], tuple(x[i : i + depth])) == tuple(x[i : i + depth])
        assert len({tuple(x[i : i + depth]) for i in range(len(x) - depth + 1)}) == len(seen)


def test_longest_earlier_beginnings():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, 400).astype(np.uint64)
    owner = np.sort(rng.integers(0, 9, 400))[rng.permutation(400)]
    grams = np.array([hash(tuple(x[i : i + 2])) for i in range(len(x))])
    long, source = _pointers.longest_earlier(x, grams, 2, 64, owner)
    for i in range(400):
        best = 0
        for j in range(400):
            if owner[j] < owner[i]:
                n = 0
                while i + n < 400 and j + n < 400 and x[i + n] == x[j + n]:
                    n += 1
                best = max(best, n)
        assert best // 2 == long[i] // 2 and long[i] <= best
        if long[i]:
            assert owner[source[i]] < owner[i] and (x[i : i + long[i]] == x[source[i] : source[i] + long[i]]).all()


def test_keep_columns(docs):
    got = suffix_dedup.suffix_dedup(docs, keep=["s1", "key"])
    assert got.columns == ["doc_id", "s1", "key", "n_bytes", "n_removed", "n_spans", "kept"]
