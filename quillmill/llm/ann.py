"""Approximate nearest neighbours over balanced posting lists.

Largest inner product becomes smallest distance by one more component that
brings every vector to the largest norm.  Centroids are fitted on a bounded
sample; every vector is indexed, in its nearest list and, at a boundary, in
others whose distance is within ``REPLICA_RATIO``.  Lists are kept balanced:
clusters of the sample over twice the mean are split, and each list is stored
as blocks of about ``BLOCK_ROWS`` rows, so none outgrows a task.  A query walks
an in-memory graph of the centroids best first, and searches the lists whose
distance is within a ratio of the nearest one's (more, if those hold too few
vectors).  The ratio is fitted to each table: ``FIT_QUERIES`` of the queries are
compared with every vector, and it is widened until the lists they search hold
``TARGET`` of their true neighbours; it is ``PROBE_RATIO`` at least.  Scores are
exact, in double precision, on the original vectors.

Equal vectors are one entry that keeps the smallest ids an answer can need
(``k`` + 1), which loses nothing: ties go to smaller ids.

Defined results: null and zero vectors, and ones with null or non-finite
components, take no part, nor do vectors whose length is not the most common
one; rows with a null id are ignored; equal rows are one; an empty table gives
an empty result; with fewer than ``k`` candidates all are returned; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm._native import table
from quillmill.llm._scratch import Scratch

K = 20
#: Vectors the centroids are fitted on, at most about so many.
SAMPLE_ROWS = 20_000
LIST_ROWS = 200
MAX_LISTS = 4096
BLOCK_ROWS = 1024
QUERY_ROWS = 256
REPLICAS = 2
REPLICA_RATIO = 1.05
PROBE_RATIO = 1.18
#: Queries the ratio is fitted on, and the share of their neighbours it must reach.
FIT_QUERIES = 128
TARGET = 0.99
#: Components of queries that are broadcast at once; more queries are searched in turns.
TURN_VALUES = 1 << 24
NEIGHBOURS = 16


class Centroids:
    """Fitted centroids and the graph over them."""

    def __init__(self, points: np.ndarray, norm: float):
        self.points, self.norm, self.ratio = points, norm, PROBE_RATIO
        d = ((points**2).sum(1)[:, None] + (points**2).sum(1)) - 2 * points @ points.T
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1, kind="stable")[:, : min(NEIGHBOURS, len(points) - 1)]
        links = [set(r.tolist()) for r in near]
        for i, r in enumerate(near):
            for j in r:
                links[j].add(i)
            if i:  # a chain keeps the graph in one piece
                links[i].add(i - 1)
                links[i - 1].add(i)
        self.links = [np.fromiter(sorted(s), np.int64) for s in links]

    @staticmethod
    def fit(sample: np.ndarray, lists: int, norm: float) -> Centroids:
        rng = np.random.default_rng(7)
        c = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
        for _ in range(8):
            near = np.argmax(sample @ c.T - 0.5 * (c**2).sum(1), 1)
            size = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, sample)
            c[size > 0] = total[size > 0] / size[size > 0, None]
            # A cluster of over twice the mean gives one of the smallest a seed of its own.
            big, small = np.flatnonzero(size > 2 * len(sample) / len(c)), np.argsort(size, kind="stable")
            for b, s in zip(big, small):
                if size[s] * 4 < size[b]:
                    own = np.flatnonzero(near == b)
                    c[s] = sample[own[rng.integers(len(own))]]
        return Centroids(c, norm)

    def extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            x = x * (self.norm / np.sqrt((x**2).sum(1, keepdims=True)))
            return np.hstack([x, np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1, keepdims=True), 0))])

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every vector's own list and of its replicas."""
        e = self.extended(x, query=False)
        d = np.sqrt(np.maximum((e**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * e @ self.points.T, 0))
        near = np.argsort(d, 1, kind="stable")[:, :REPLICAS]
        dn = np.take_along_axis(d, near, 1)
        row, col = np.nonzero(dn <= dn[:, :1] * REPLICA_RATIO)
        return row, near[row, col]

    def probe(self, q: np.ndarray, size: np.ndarray, need: int) -> list[int]:
        """Lists for one query: best-first over the graph, pruned by the ratio of distances."""
        e = self.extended(q[None], query=True)[0]
        seen = np.zeros(len(self.points), bool)
        heap: list[tuple[float, int]] = []

        def look(at: np.ndarray) -> None:
            at = at[~seen[at]]
            seen[at] = True
            for dist, i in zip(np.sqrt(((self.points[at] - e) ** 2).sum(1)).tolist(), at.tolist()):
                heapq.heappush(heap, (dist, i))

        look(np.unique(np.linspace(0, len(self.points) - 1, 8).astype(np.int64)))
        taken: list[tuple[float, int]] = []
        best, beyond = np.inf, 0
        while heap:
            dist, i = heapq.heappop(heap)
            best = min(best, dist)
            have = sum(size[j] for d, j in taken if d <= best * self.ratio) if beyond else 0
            if dist > best * self.ratio:
                beyond += 1
                if beyond > NEIGHBOURS and have >= need:
                    break
            taken.append((dist, i))
            look(self.links[i])
        taken.sort()
        out, have = [], 0
        for dist, i in taken:
            if dist > best * self.ratio and have >= need:
                break
            out.append(i)
            have += int(size[i])
        return out


def _usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids): each vector with its k + 1 smallest ids; equal vectors are brought together in each task first."""
    kind = dict(rows.dtypes)["vec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            met: dict[bytes, list[int]] = {}
            for i, v in zip(pdf["id"], pdf["vec"]):
                met.setdefault(v.tobytes(), []).append(i)
            out = [(np.frombuffer(v, pdf["vec"].iloc[0].dtype), i) for v, ids in met.items() for i in sorted(set(ids))[: k + 1]]
            yield pd.DataFrame(dict(vec=[v for v, _ in out], id=[i for _, i in out]))

    some = rows.mapInPandas(run, f"vec {kind}, id long").withColumn("name", F.xxhash64("vec"))
    first = Window.partitionBy("name", "vec").orderBy("id")
    some = some.withColumn("_n", F.dense_rank().over(first)).filter(F.col("_n") <= k + 1)
    return some.groupBy("name", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).drop("name")


def _reached(postings: DataFrame, asked: np.ndarray, k: int) -> list[list[set[int]]]:
    """For each query the lists that hold each of its k true nearest entries, by comparing it with every posting."""
    spark, most = postings.sparkSession, REPLICAS * (k + 1)
    shared = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, held = shared.value, None
        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                s = q @ x.T
                c = np.argpartition(-s, most - 1, 1)[:, :most] if s.shape[1] > most else np.tile(np.arange(s.shape[1]), (len(q), 1))
                r = np.repeat(np.arange(len(q)), c.shape[1])
                c = c.ravel()
                other = (x[c] != q[r]).any(1)  # a query is no neighbour of its own
                r, c = r[other], c[other]
                now = [r, part["entry"].to_numpy()[c], part["list"].to_numpy()[c], s[r, c]]
                held = [np.concatenate(x) for x in zip(held, now)] if held else now
                order = np.lexsort((held[2], held[1], -held[3], held[0]))
                start = np.searchsorted(held[0][order], np.arange(len(q)))
                order = order[np.arange(len(order)) - start[held[0][order]] < most]
                held = [h[order] for h in held]
        if held:
            yield pd.DataFrame(dict(zip(("q", "entry", "list", "score"), held)))

    near = postings.select("entry", "vec", "list").mapInPandas(run, "q int, entry long, list int, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "entry", "list")
    near = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    found: list[dict[int, set[int]]] = [{} for _ in asked]
    for r in sorted(near.collect(), key=lambda r: r["_r"]):
        mine = found[r["q"]]
        if r["entry"] in mine or len(mine) < k:
            mine.setdefault(r["entry"], set()).add(r["list"])
    return [list(f.values()) for f in found]


def _fit_ratio(model: Centroids, asked: np.ndarray, reached: list[list[set[int]]], size: np.ndarray, need: int) -> float:
    """The least ratio, about, by which the lists searched hold TARGET of the true neighbours."""
    e = model.extended(asked, query=True)
    d = np.sqrt(np.maximum((e**2).sum(1)[:, None] + (model.points**2).sum(1) - 2 * e @ model.points.T, 1e-30))
    best = d.min(1)
    needed = np.sort([min(d[i, j] for j in lists) / best[i] for i, mine in enumerate(reached) for lists in mine])
    if not len(needed):
        return PROBE_RATIO
    ratio = max(PROBE_RATIO, needed[int(np.ceil(TARGET * len(needed))) - 1])
    while ratio < (d.max(1) / best).max():  # the walk over the graph may miss lists
        model.ratio = ratio
        got = [set(model.probe(q, size, need)) for q in asked]
        if sum(bool(lists & g) for g, mine in zip(got, reached) for lists in mine) >= TARGET * len(needed):
            break
        ratio *= 1.02
    return float(ratio)


def _top(lead: np.ndarray, vec: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best different vec of each lead; one met in several lists counts once, at its best score."""
    order = np.lexsort((-score, vec, lead))
    first = np.ones(len(order), bool)
    first[1:] = (lead[order][1:] != lead[order][:-1]) | (vec[order][1:] != vec[order][:-1])
    order = order[first]
    order = order[np.lexsort((vec[order], -score[order], lead[order]))]
    start = np.flatnonzero(np.concatenate([[True], lead[order][1:] != lead[order][:-1]]))
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < n]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors`` but itself.

    ``queries`` are rows of the same kind; one that is also in ``vectors`` has the same id there.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        vec = F.transform(vec_col, lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(kind)
        return df.filter(F.col(id_col).isNotNull() & _usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))

    rows = clean(vectors)
    top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = top[0]["d"] if top else 0
    # An entry is known by its smallest id.
    own = scratch.put(_distinct(rows.filter(F.size("vec") == dim), k).withColumn("entry", F.get("ids", F.lit(0))), "vectors")
    n = own.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = clean(queries).filter(F.size("vec") == dim).dropDuplicates(["id"])
    lead = asked.groupBy(F.xxhash64("vec").alias("name"), "vec").agg(F.min("id").alias("lead"))
    lead = scratch.put(lead, "lead")
    asked = scratch.put(asked.withColumn("name", F.xxhash64("vec")).join(lead, ["name", "vec"]).select("id", "lead"), "asked")
    norm = own.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).collect()[0][0]

    # A bounded sample, by hash; the limit only holds off an unlucky hash.
    share = min(1.0, SAMPLE_ROWS / n)
    picked = own.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("entry", "vec")
    sample = sorted((r["entry"], r["vec"]) for r in picked.limit(2 * SAMPLE_ROWS).collect())
    sample = sample or [(0, own.limit(1).collect()[0]["vec"])]
    sample = np.array([v for _, v in sample], np.float64)
    sample = np.hstack([sample, np.sqrt(np.maximum(norm**2 - (sample**2).sum(1, keepdims=True), 0))])
    lists = int(max(1, min(n // LIST_ROWS, MAX_LISTS, len(sample) // 4)))
    fitted = Centroids.fit(sample, lists, norm)
    model = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                row, cluster = model.value.lists_of(np.stack(part["vec"].to_numpy()).astype(np.float64))
                yield part.iloc[row].assign(list=cluster.astype(np.int32))

    postings = scratch.put(own.select("entry", "vec").mapInPandas(assign, f"entry long, vec {kind}, list int"), "postings")
    counts = postings.groupBy("list").agg(F.count("*").alias("n"))  # at most MAX_LISTS rows
    size = np.zeros(lists, np.int64)
    for r in counts.collect():
        size[r["list"]] = r["n"]

    need = (k + 1) * REPLICAS * 4
    some = lead.orderBy(F.xxhash64("vec"), "lead").limit(FIT_QUERIES).collect()
    if some and lists > 1:
        some = np.array([r["vec"] for r in some], np.float64)
        fitted.ratio = _fit_ratio(fitted, some, _reached(postings, some, k), size, need)
        model = spark.sparkContext.broadcast(fitted)

    # Equal queries are searched once, and told apart at the end.
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                got = [model.value.probe(np.asarray(v, np.float64), size, need) for v in part["vec"]]
                where = np.repeat(np.arange(len(part)), [len(g) for g in got])
                yield part[["lead"]].iloc[where].assign(list=np.concatenate(got).astype(np.int32))

    probes = scratch.put(lead.select("lead", "vec").repartition(parts).mapInPandas(search, "lead long, list int"), "probes")

    def blocks(df: DataFrame, key: str, rows_each: int, *more: Column) -> DataFrame:
        each = F.broadcast(df.groupBy("list").agg(F.ceil(F.count("*") / rows_each).cast("int").alias("b")))
        return df.join(each, "list").groupBy("list", F.pmod(F.xxhash64(key), F.col("b")).alias(f"{key}_block")).agg(
            F.collect_list(key).alias(key), *more
        )

    def score(known):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[list[np.ndarray]] = []
            ids, vec = known.value

            def best() -> list[np.ndarray]:
                who, what, how = (np.concatenate(c) for c in zip(*held))
                at = _top(who, what, how, k + 1)
                return [who[at], what[at], how[at]]

            for pdf in batches:
                for q, e, ev in zip(pdf["lead"], pdf["entry"], pdf["entry_vec"]):
                    x, y = vec[np.searchsorted(ids, q)].astype(np.float64), ev.reshape(-1, dim).astype(np.float64)
                    s = x @ y.T
                    # Whatever ties with the last place stays.
                    floor = -np.partition(-s, k, 1)[:, k : k + 1] if s.shape[1] > k + 1 else -np.inf
                    r, c = np.nonzero(s >= floor)
                    held.append([q[r], e[c], s[r, c]])
                    if sum(len(h[0]) for h in held) > 400_000:
                        held = [best()]
                        if len(held[0][0]) > 200_000:
                            yield pd.DataFrame(dict(zip(("lead", "entry", "score"), held[0])))
                            held = []
            if held:
                yield pd.DataFrame(dict(zip(("lead", "entry", "score"), best())))

        return run

    # Vectors of queries go to every task once, not to every list.
    turns = max(1, -(-lead.count() * dim // TURN_VALUES))

    def turn(t: int) -> DataFrame:
        def mine(df: DataFrame) -> DataFrame:
            return df.filter(F.pmod(F.xxhash64("lead", F.lit(1)), F.lit(turns)) == t)

        got = mine(lead).select("lead", "vec").toPandas().sort_values("lead")
        if not len(got):
            return spark.createDataFrame([], "lead long, entry long, score double")
        vec = np.stack([np.asarray(v, "f4" if kind == "array<float>" else "f8") for v in got["vec"]])
        known = spark.sparkContext.broadcast((got["lead"].to_numpy(), vec))
        entries = blocks(postings, "entry", BLOCK_ROWS, F.flatten(F.collect_list("vec")).alias("entry_vec"))
        pairs = entries.join(blocks(mine(probes), "lead", QUERY_ROWS), "list").select("lead", "entry", "entry_vec")
        return pairs.mapInPandas(score(known), "lead long, entry long, score double")

    near = turn(0)
    for t in range(1, turns):
        near = near.union(turn(t))
    near = near.groupBy("lead", "entry").agg(F.max("score").alias("score"))
    order = Window.partitionBy("lead").orderBy(F.desc("score"), "entry")
    near = scratch.put(near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1), "near")
    # The ids of equal vectors tie: the smallest come first.
    each = near.join(own.select("entry", "ids"), "entry").select("lead", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("lead").orderBy(F.desc("score"), "vec_id")
    best_ids = each.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    answers = best_ids.groupBy("lead").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("a"))
    told = asked.join(answers, "lead").select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("a", lambda x: x["vec_id"] != F.col("id")), 1, k)).alias("rank", "x")
    )
    return told.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
