"""Connected components of a table of links, by alternating large and small stars.

First each task replaces its links, BLOCK_EDGES at a time, by a forest that joins the
same nodes; where one block holds all links that is the result.  Then every round hangs each node's larger neighbours, then its smaller ones, on the
least node it knows; it ends with every node linked to the least of its
component, after a number of rounds that grows with the logarithm of the links.
Each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm._scratch import Scratch

#: Links that a task contracts at once.
BLOCK_EDGES = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes of the links but the least ones."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    r, c = at[: len(u)], at[len(u) :]
    top = np.arange(len(ids))
    while True:
        p, q = top[r], top[c]
        if (p == q).all():
            break
        now = np.arange(len(ids))
        np.minimum.at(now, p, q)
        np.minimum.at(now, q, p)
        while (now[now] != now).any():
            now = now[now]
        top = now[top]
    hung = top != np.arange(len(ids))
    return ids[hung], ids[top[hung]]


def _contracted(block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> pd.DataFrame:
            both = pd.concat(held, ignore_index=True)
            return pd.DataFrame(dict(zip("uv", forest(both["u"].to_numpy(), both["v"].to_numpy()))))

        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n > block:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def components(links: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """(id, component) for every node of links (a long, b long); component is the least id reachable."""

    def put(df: DataFrame, n: int) -> DataFrame:
        return scratch.put(df, f"{name}{n}")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    blocks = max(1, -(-links.count() // BLOCK_EDGES))
    few = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(blocks)
    edges = put(few.mapInPandas(_contracted(BLOCK_EDGES), "u long, v long"), 0)
    if blocks == 1:
        return _named(edges)
    edges = edges.distinct()
    now, n = state(edges), 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # What the small star needs is each node's least smaller neighbour.
        large = put(large, 2 * n + 1)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = put(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), 2 * n + 2)
        was, now = now, state(edges)
        for k in (2 * n, 2 * n + 1):
            scratch.drop(f"{name}{k}")
        n += 1
        if was == now:
            break
    return _named(edges)


def _named(edges: DataFrame) -> DataFrame:
    tops = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)
