"""Near-dedup and components against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import _components, near_dedup
from quillmill.llm._components import components
from quillmill.llm._scratch import Scratch


def found(frame, words=2):
    return sorted((tuple(r) for r in near_dedup.near_duplicates(frame, words=words).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("words", [2, 5])
def test_equals_all_pairs(docs, texts, words):
    assert found(docs, words) == sorted(near_dedup.brute_force(texts, words), key=repr)


@pytest.mark.parametrize("limits", [dict(NODE_ROWS=2, NODE_PAIRS=1, BROADCAST_ROWS=-1), dict(NODE_UNITS=1, FEW=1, FIRST=20)])
def test_limits_change_nothing(docs, texts, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    assert found(docs) == sorted(near_dedup.brute_force(texts), key=repr)


def pairs_at_the_threshold(n, shared=0):
    """n pairs of documents with a similarity of exactly 0.8, all with ``shared`` pairs of words in common."""
    rows = []
    for k in range(n):
        common = [f"boiler{j}" for j in range(shared)] + [f"w{k}x{j}" for j in range(81 - shared)]
        rows += [(2 * k + c, " ".join(common + [f"e{k}x{j}x{c}" for j in range(10)])) for c in range(2)]
    return rows


@pytest.mark.parametrize("shared", [0, 60])
def test_links_at_the_threshold_are_found_in_branched_nodes(spark, monkeypatch, shared):
    """Every node is branched on until it holds a pair; with boilerplate, unlike documents share most of their nodes for long."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 8)
    monkeypatch.setattr(near_dedup, "NODE_PAIRS", 20)
    monkeypatch.setattr(near_dedup, "FEW", 2)
    rows = pairs_at_the_threshold(100, shared)
    got = found(frame(spark, rows))
    links = sum(c == i - 1 for i, _, c, _ in got if i % 2)
    assert links >= 0.99 * 100 and all(c in (i, i - 1) for i, _, c, _ in got)


def test_a_large_group_of_near_copies_contracts(spark, monkeypatch):
    """Copies of one text in one node of far more pairs than a task takes, and a link that only one of them has."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 20)
    monkeypatch.setattr(near_dedup, "NODE_PAIRS", 200)
    base = [f"w{j}" for j in range(100)]
    rows = [(k, " ".join(base[:k] + [f"own{k}"] + base[k + 1 :])) for k in range(1, 90)]
    rows += [(500, " ".join(base[:1] + ["own1"] + base[2:88] + [f"tail{j}" for j in range(12)]))]
    rows += [(600 + k, " ".join(base[:60] + [f"other{k}x{j}" for j in range(40)])) for k in range(30)]
    assert found(frame(spark, rows)) == sorted(near_dedup.brute_force(rows), key=repr)


def a_template(n, common=120, own=20, pairs=50, words=5):
    """n unlinked documents of ``common`` and ``own`` words, and pairs of them that just reach a similarity of 0.8."""
    boiler = [f"boiler{j}" for j in range(common)]
    rows = [(k, " ".join(boiler + [f"own{k}x{j}" for j in range(own)])) for k in range(n)]
    total, same = common + own, common
    while 100 * (same - words + 1) < 80 * (2 * (total - words + 1) - (same - words + 1)):
        same += 1
    for p in range(pairs):
        shared = boiler + [f"pair{p}x{j}" for j in range(same - common)]
        rows += [(n + 2 * p + c, " ".join(shared + [f"end{p}x{c}x{j}" for j in range(total - same)])) for c in range(2)]
    return rows


def test_a_template_of_many_unlinked_documents_is_bounded(spark, monkeypatch):
    """Nothing contracts and a large share of each node stays together: those that resemble their node leave it."""
    rows_of = {}

    class Counted(Scratch):
        def put(self, df, name):
            out = super().put(df, name)
            if name.rstrip("0123456789") in ("member", "dense", "tasks"):
                rows_of[name] = out.count()
            return out

    monkeypatch.setattr(near_dedup, "Scratch", Counted)
    n, pairs = 4000, 50
    rows = a_template(n, pairs=pairs)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    want = {i: n + 2 * ((i - n) // 2) if i >= n else i for i, _ in rows}
    assert sum(got[i] == want[i] for i in range(n, n + 2 * pairs)) >= 0.99 * 2 * pairs
    assert all(got[i] in (i, want[i]) for i in want)
    assert sum(rows_of.values()) <= 100 * len(rows)


@pytest.mark.parametrize("limits, all_leave", [
    (dict(NODE_ROWS=2, NODE_PAIRS=1, FEW=2, DENSE_ROWS=3, HUBS=2, CELLS=64), True), (dict(NODE_ROWS=4, NODE_PAIRS=4, FEW=2, DENSE_ROWS=1, PROBED=2), False),
])
def test_leaving_a_node_changes_nothing(docs, texts, spark, monkeypatch, limits, all_leave):
    """Blocks of few members, some or all members leaving, and ids with several texts."""
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    if all_leave:
        judged = near_dedup._judged
        monkeypatch.setattr(near_dedup, "_judged", lambda *a: judged(*a).withColumn("leaves", F.lit(True)))
    template = [(10_000 + i, t) for i, t in a_template(24, pairs=6, words=2)]
    both = [*texts, *template]
    assert found(frame(spark, both)) == sorted(near_dedup.brute_force(both), key=repr)
    again = frame(spark, [*template, *[(i, t + " extra") for i, t in template[:5]]])
    assert {r[0]: r[2] for r in found(again)} == {r[0]: r[2] for r in near_dedup.brute_force(template)}


def test_few_rows_are_not_dealt_to_many_tasks(spark, docs, texts, monkeypatch):
    """With many shuffle partitions each table of a run is written by few tasks, with the same result."""
    files = {}

    class Counted(Scratch):
        def put(self, df, name):
            out = super().put(df, name)
            files[name] = len(out.inputFiles())
            return out

    monkeypatch.setattr(near_dedup, "Scratch", Counted)
    monkeypatch.setattr(near_dedup, "TASKS", 3)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert found(docs) == sorted(near_dedup.brute_force(texts), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "links1" in files and max(files.values()) <= 3


def test_empty_table(empty):
    assert near_dedup.near_duplicates(empty).collect() == []


def test_nothing_linked(spark):
    assert found(frame(spark, [(1, "a b c"), (2, "d e f")])) == [(1, 2, 1, True), (2, 2, 2, True)]


def test_rows_without_id_and_rows_that_repeat_one(spark):
    rows = [(None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (9, "A B C"), (9, "q r s t"), (12, "q r s t"), (20, "u v"), (20, "x y z"), (31, "x y z"), (31, "u v")]
    want = [(None, 2, None, True), (None, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (9, 3, 4, False), (12, 3, 4, False)]
    want += [(20, 1, 20, True), (20, 2, 20, True), (31, 2, 20, False), (31, 1, 20, False)]
    assert found(frame(spark, rows)) == sorted(want, key=repr)


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-20_000])), (3, " ".join(long[:1000]))]
    assert [r[2] for r in found(frame(spark, rows), words=5)] == [1, 1, 3]


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_components_of_chains_and_stars(spark, monkeypatch, block):
    monkeypatch.setattr(_components, "BLOCK_EDGES", block)
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    links = chain + star + [(7, 7), (900, 3)]
    rng.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()))
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {900: 3, 3: 3}
    assert got == want
