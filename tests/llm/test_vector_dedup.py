"""Embedding near-dedup against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import _flat_graph as flat
from quillmill.llm import vector_dedup as vd


def planted(rng, n, dim=24, groups=(2, 2, 3, 5, 9, 60), noise=0.12):
    """n vectors without links, and groups around some of them."""
    x = rng.normal(size=(n, dim))
    more = [x[k] + noise * np.linalg.norm(x[k]) / np.sqrt(dim) * rng.normal(size=(m, dim)) for k, m in enumerate(groups)]
    return np.concatenate([x, *more])


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, s1 long, kept boolean").repartition(3)


def told(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def wide(rows):
    return [(i, None if v is None else [None if a is None else float(a) for a in v], None, None, None) for i, v in rows]


def compared(got, want):
    """(found links, links): nothing else may be found, and components hold only linked vectors."""
    a, b = {r[0]: r for r in got}, {r[0]: r for r in want}
    assert a.keys() == b.keys() and len(got) == len(want)
    assert all(a[i][1] <= b[i][1] for i in a)
    return sum(r[1] for r in got), sum(r[1] for r in want)


def test_small_table_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = planted(rng, 150)
    rows = [(3 * k + 1, v) for k, v in enumerate(x.tolist())]
    rows += [(1000 + k, rows[5][1]) for k in range(7)] + [(2000, (2 * x[9]).tolist()), (2001, (1e200 * x[9]).tolist()), (2002, (1e-200 * x[9]).tolist())]
    rows += [(2100, None), (2101, []), (2102, [0.0] * 24), (2103, [float("nan")] + [1.0] * 23), (2104, [None] + [1.0] * 23), (2105, [float("inf")] * 24), (2106, [1.0, 2.0])]
    rows += [(None, rows[5][1])]
    want = sorted(vd.brute_force(rows), key=repr)
    assert sum(r[1] for r in want) > 3000
    assert told(vd.near_vectors(frame(spark, wide(rows)))) == want
    twice = wide(rows) + wide(rows[:20])  # repeated rows are one vector
    assert told(vd.near_vectors(frame(spark, twice))) == sorted(want + [r for r in vd.brute_force(rows) if r[0] in {i for i, _ in rows[:20]}], key=repr)


def test_shards_blocks_and_guests(spark, monkeypatch):
    """Many small shards, each of several blocks: every pair is counted once, and few are missed."""
    rng = np.random.default_rng(2)
    x = planted(rng, 900, groups=[2] * 60 + [120])
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    want = sorted(vd.brute_force(rows), key=repr)
    monkeypatch.setattr(vd, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vd, "MAX_LISTS", 12)
    got = told(vd.near_vectors(frame(spark, wide(rows))))
    found, links = compared(got, want)
    assert found >= 0.98 * links
    assert sum(a != b for a, b in zip(got, want)) <= 0.05 * len(want)


def test_recall_is_audited_and_mended(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate(planted(rng, 600, groups=[2] * 80, noise=0.28).tolist())]
    monkeypatch.setattr(vd, "BLOCK_ROWS", 10)
    monkeypatch.setattr(vd, "REPLICAS", 1)
    monkeypatch.setattr(vd, "SAMPLE_ROWS", 100)
    seen = []
    real = vd.recall
    monkeypatch.setattr(vd, "recall", lambda *a: seen.append(real(*a)) or seen[-1])
    found, links = compared(told(vd.near_vectors(frame(spark, wide(rows)))), sorted(vd.brute_force(rows), key=repr))
    assert seen[0] < vd.TARGET and len(seen) > 1
    assert found >= 0.95 * links


def test_links_at_the_threshold_are_exact(spark):
    at = [1.0, 0.0, 0.0]
    rows = [(1, at)] + [(2 + k, [c, float(np.sqrt(1 - c * c)), 0.0]) for k, c in enumerate([0.95, 0.95 - 1e-9, 0.95 + 1e-9, 0.9500001, 0.9499999])]
    assert told(vd.near_vectors(frame(spark, wide(rows)))) == sorted(vd.brute_force(rows), key=repr)


def test_empty_null_and_single(spark):
    assert told(vd.near_vectors(frame(spark, []))) == []
    assert told(vd.near_vectors(frame(spark, wide([(1, None), (None, None)])))) == [(1, 0, 1, True), (None, 0, None, True)]
    assert told(vd.near_vectors(frame(spark, wide([(7, [1.0, 1.0])])))) == [(7, 0, 7, True)]
    with pytest.raises(ValueError):
        vd.near_vectors(frame(spark, []), cosine=1.5)


def test_graph_reaches_every_node():
    rng = np.random.default_rng(4)
    x = planted(rng, 3000, dim=32, groups=[2] * 50 + [200]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = flat.Graph.build(x)
    q, p, _ = g.search(x)
    assert (np.isin(np.arange(len(x)), q[q == p])).mean() > 0.98
    assert (g.links >= 0).sum(1).max() <= 2 * flat.DEGREE
    q, p, s = g.search(x, 0.9, np.arange(len(x))[:, None])
    both = np.zeros((len(x), len(x)), bool)
    both[q[s >= 0.95], p[s >= 0.95]] = True
    true = x @ x.T >= 0.95
    assert ((both | both.T) & true).sum() >= 0.99 * true.sum()


def test_pruning_keeps_far_directions():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0.98, -0.2], [0, 1]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = flat.pruned(x, np.array([0]), np.array([[1, 2, 3, 4, -1]]))[0]
    assert 1 in kept and 3 in kept and 2 not in kept


def test_query_equals_brute_force_on_its_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert told(vd.op13_vector_dedup(spark, sf_dir)) == sorted(vd.brute_force(rows), key=repr)
