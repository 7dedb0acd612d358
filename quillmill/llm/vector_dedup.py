"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors are one node.  Lists are fitted on a bounded sample, and each node
goes to all lists whose centre is not farther than the nearest one by more than
twice the range (no pair within the range can then be apart), ``REPLICAS`` at
most: overlapping shards.  A task builds the pruned graph of a shard, or of a
block of a shard over ``BLOCK_ROWS``, so none outgrows a task.  The adjacency lists
that a node has in all its shards are united to one flat graph.  A node whose
united list has near neighbours in shards it isn't in joins these as well, so the
search goes on across shards where the graph does.

Then every node is searched for in each of its shards, from the shard's medoid and
its own place, and the beam widens over all nodes within reach of the range.  Links
are confirmed in double precision.  Blocks of one shard are searched against each
other.  A pair is counted in the first shard that both are in, so no pair leaves a
task: what does are a count for each node and its component as far as the task
knows it.  Last, some nodes, drawn by hash, are compared with every vector; if less
than ``TARGET`` of their links was found, all is done again with twice the beam and
more shards to a node, up to ``TRIES`` times.

Defined results, one row for each row of the input: vectors that are null, empty,
zero or hold null or non-finite components link with nothing, nor do those whose
length is not the most common one; a row without an id links with nothing, has no
component and is kept; rows that repeat an id and a vector are one vector; other
rows of one id are linked by their own vectors; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._components import components
from quillmill.llm._flat_graph import BEAM, Graph, padded
from quillmill.llm._native import table
from quillmill.llm._scratch import Scratch
from quillmill.llm.ann import Centroids, _usable
from quillmill.llm.near_dedup import _grouped

#: Vectors the lists are fitted on, at most about so many.
SAMPLE_ROWS = 20_000
MAX_LISTS = 4096
REPLICAS = 4
#: Nodes of one graph.
BLOCK_ROWS = 4096
#: Angles up to so many times that of the range are near.
REACH = 1.4
#: Links a node's united list has at most.
LINKS = 256
#: Nodes the recall is measured on, the share of their links that must be found, and how often.
AUDIT, TARGET, TRIES = 512, 0.98, 3
#: Cosines this close to the threshold are taken again in double precision.
DOUBT = 1e-4
ROWS = 4096


def _double(vecs) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vecs])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; those of extreme size are scaled first."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the vectors as they are, in double precision; what overflows or underflows is scaled first."""
    with np.errstate(all="ignore"):
        c = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        size = np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)
    odd = ~((size > 1e-200) & (size < 1e200))
    if odd.any():
        c[odd] = np.einsum("ij,ij->i", unit(x[odd]), unit(y[odd]))
    return c


def _linked(near: np.ndarray, x: np.ndarray, y: np.ndarray, xi: np.ndarray, yi: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs (xi, yi) of about ``near`` cosine are links."""
    ok = near >= cosine
    doubt = np.flatnonzero(np.abs(near - cosine) <= DOUBT)
    if len(doubt):
        ok[doubt] = cosines(x[xi[doubt]], y[yi[doubt]]) >= cosine
    return ok


def _lists(nodes: DataFrame, n: int, replicas: int) -> np.ndarray:
    """Centres of lists, from a bounded sample by hash; the limit only holds off an unlucky hash."""
    share = min(1.0, SAMPLE_ROWS / n)
    picked = nodes.filter(F.pmod(F.xxhash64("s2"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("s1", "vec")
    sample = sorted((r["s1"], r["vec"]) for r in picked.limit(2 * SAMPLE_ROWS).collect())
    if not sample:
        sample = [(0, nodes.limit(1).collect()[0]["vec"])]
    sample = unit(_double(v for _, v in sample))
    return Centroids.fit(sample, int(max(1, min(n * replicas // BLOCK_ROWS, MAX_LISTS, len(sample) // 4))), 1.0).points


def _sharded(nodes: DataFrame, centres: np.ndarray, replicas: int, cosine: float) -> DataFrame:
    """nodes with ``shards``, ascending."""
    slack = 2 * math.sqrt(max(0.0, 2 - 2 * cosine))
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # at most MAX_LISTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                part = pdf.iloc[a : a + ROWS]
                d = np.sqrt(np.maximum(1 + (c * c).sum(1) - 2 * unit(_double(part["vec"])) @ c.T, 0))
                near = np.argsort(d, 1, kind="stable")[:, :replicas]
                dn = np.take_along_axis(d, near, 1)
                yield part.assign(shards=[np.sort(r[ok]).astype(np.int32) for r, ok in zip(near, dn <= dn[:, :1] + slack)])

    return nodes.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", shards array<int>")


def _built(near: float, beam: int):
    """Over the rows of whole blocks: each node's links in its block, and the shards of its near ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, "task"):
            for _, block in pdf.groupby("task", sort=False):
                x = unit(_double(block["vec"])).astype(np.float32)
                links = Graph.build(x, beam).links
                node, own = block["s1"].to_numpy(), block["shards"].to_numpy()
                r, c = np.nonzero(links >= 0)
                to = links[r, c]
                close = np.einsum("ij,ij->i", x[r], x[to]) >= near
                starts = np.searchsorted(r, np.arange(len(x) + 1))
                reach = [None] * len(x)
                for i in np.unique(r[close]):
                    mine = slice(starts[i], starts[i + 1])
                    reach[i] = np.setdiff1d(np.concatenate([own[j] for j in to[mine][close[mine]]]), own[i])
                yield pd.DataFrame(dict(
                    s1=node, s2=block["s2"].to_numpy(), links=[node[to[a:b]] for a, b in zip(starts, starts[1:])], reach=pd.Series(reach, dtype=object)
                ))

    return run


def _tops(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is joined with by the pairs (a, b)."""
    top = np.arange(n)
    while True:
        now = top.copy()
        np.minimum.at(now, a, top[b])
        np.minimum.at(now, b, top[a])
        now = now[now]
        if (now == top).all():
            return top
        top = now


class _Met:
    """A task's table of which query and node are linked, and what follows from it."""

    def __init__(self, block: pd.DataFrame):
        self.graph, self.query = block[block["role"] == 1], block[block["role"] == 0]
        self.same = not len(self.query) and bool((block["i"] == block["j"]).all())
        if self.same:
            self.query = self.graph

    def found(self, cosine: float, near: float, beam: int) -> np.ndarray:
        """Which query and node are linked, both ways if they are the same."""
        g, q = self.graph, self.query
        gv = _double(g["vec"])
        qv = gv if self.same else _double(q["vec"])
        x = unit(gv).astype(np.float32)
        name = g["s1"].to_numpy()
        order = np.argsort(name, kind="stable")

        def places(lists: pd.Series) -> np.ndarray:
            r = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
            v = np.concatenate([*lists.to_numpy(), np.zeros(0, np.int64)]).astype(np.int64)
            at = np.minimum(np.searchsorted(name[order], v), len(name) - 1)
            here = name[order][at] == v
            return padded(r[here], order[at[here]], len(lists), max(1, np.bincount(r[here]).max(initial=0)))

        links = places(g["links"])
        starts = np.arange(len(g))[:, None] if self.same else places(q["links"])
        graph, y = Graph(x, links), x if self.same else unit(qv).astype(np.float32)
        out = np.zeros((len(q), len(g)), bool)
        for a in range(0, len(q), ROWS // 4):
            r, p, s = graph.search(y[a : a + ROWS // 4], near, starts[a : a + ROWS // 4], beam)
            some = s >= cosine - DOUBT
            r, p, s = r[some] + a, p[some], s[some].astype(np.float64)
            if self.same:
                r, p, s = (c[r != p] for c in (r, p, s))
            ok = _linked(s, qv, gv, r, p, cosine)
            out[r[ok], p[ok]] = True
        return out | out.T if self.same else out

    def rows(self, out: np.ndarray, shard: int) -> pd.DataFrame:
        """(s1, s2, n, top): new linked ids of each node, and the least id it is joined with."""
        g, q = self.graph, self.query
        both = [q, g] if not self.same else [g]
        earlier = np.unique(np.concatenate([*[v for b in both for v in b["shards"]], np.zeros(0, np.int64)]))
        earlier = earlier[earlier < shard]

        def mask(shards: pd.Series) -> np.ndarray:
            m = np.zeros((len(shards), len(earlier)), bool)
            r = np.repeat(np.arange(len(shards)), [len(v) for v in shards])
            v = np.concatenate([*shards.to_numpy(), np.zeros(0, np.int64)])
            some = v < shard
            m[r[some], np.searchsorted(earlier, v[some])] = True
            return np.packbits(m, axis=1)

        mq, mg = mask(q["shards"]), mask(g["shards"])
        copies_q, copies_g = q["copies"].to_numpy(), g["copies"].to_numpy()
        n_q, n_g = np.zeros(len(q), np.int64), np.zeros(len(g), np.int64)
        joined = []
        for a in range(0, len(q), ROWS // 16):  # few rows at a time: a block may be linked throughout
            r, c = np.nonzero(out[a : a + ROWS // 16])
            r += a
            joined.append((r, c))
            new = ~(mq[r] & mg[c]).any(1)
            np.add.at(n_q, r[new], copies_g[c[new]])
            if not self.same:
                np.add.at(n_g, c[new], copies_q[r[new]])
            if sum(len(x) for x, _ in joined) > 1 << 20:
                joined = [self._spanning(joined, len(q))]
        r, c = self._spanning(joined, len(q))
        rep = np.concatenate([q["rep"].to_numpy(), g["rep"].to_numpy()]) if not self.same else g["rep"].to_numpy()
        least = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[least] = np.arange(len(rep))
        top = _tops(rank[r], rank[c if self.same else c + len(q)], len(rep))[rank]
        frame = pd.concat([b[["s1", "s2", "rep"]] for b in both], ignore_index=True)
        frame["n"] = n_q if self.same else np.concatenate([n_q, n_g])
        frame["top"] = rep[least][top]
        return frame[(frame["n"] > 0) | (frame["top"] != frame["rep"])]

    def _spanning(self, joined: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """As few pairs (query, node) that join the same nodes."""
        r, c = (np.concatenate(x) for x in zip(*joined))
        shift = 0 if self.same else n
        m = n if self.same else n + len(self.graph)
        top = _tops(r, c + shift, m)
        if self.same:
            own = np.flatnonzero(top != np.arange(m))
            return own, top[own]
        own = np.arange(n, m)[top[n:] != np.arange(n, m)]  # with queries first, the least of a component of several is a query
        rest = np.flatnonzero(top[:n] != np.arange(n))
        first = np.full(m, -1, np.int64)
        first[top[own][::-1]] = own[::-1]
        return np.concatenate([top[own], rest]), np.concatenate([own, first[top[rest]]]) - n


def _searched(cosine: float, near: float, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, "task"):
            for _, block in pdf.groupby("task", sort=False):
                met = _Met(block)
                if len(met.query) and len(met.graph):
                    yield met.rows(met.found(cosine, near, beam), int(block["shard"].iloc[0]))

    return run


def _graph(placed: DataFrame, blocks: DataFrame, near: float, beam: int, scratch: Scratch, name: str) -> DataFrame:
    """placed with ``links`` of the flat graph, united over shards, and ``shards`` with those that near links lead to."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.withColumn("shard", F.explode("shards")).join(blocks, "shard")
    rows = rows.withColumn("task", F.xxhash64("shard", F.pmod(F.col("s2"), F.col("b")))).select("task", "s1", "s2", "vec", "shards")
    built = rows.repartition(parts, "task").sortWithinPartitions("task", "s1", "s2").mapInPandas(_built(near, beam), "s1 long, s2 long, links array<long>, reach array<int>")
    united = scratch.put(built, f"{name}-built").groupBy("s1", "s2").agg(
        F.slice(F.array_distinct(F.flatten(F.collect_list("links"))), 1, LINKS).alias("links"), F.flatten(F.collect_list("reach")).alias("reach")
    )
    both = placed.join(united, ["s1", "s2"])
    return scratch.put(both.withColumn("shards", F.array_sort(F.array_union("shards", "reach"))).drop("reach"), f"{name}-graph")


def _search(graph: DataFrame, blocks: DataFrame, cosine: float, near: float, beam: int) -> DataFrame:
    """(s1, s2, rep, n, top) for what each task finds out about a node."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = graph.withColumn("shard", F.explode("shards"))
    # Shards that grew beyond twice a block are cut further, in the blocks of the graph.
    now = rows.groupBy("shard").agg(F.count("*").alias("n")).join(blocks, "shard")
    now = F.broadcast(now.select("shard", (F.col("b") * F.greatest(F.lit(1), F.ceil(F.col("n") / (2 * F.col("b") * BLOCK_ROWS)))).cast("int").alias("b")))
    rows = rows.join(now, "shard").withColumn("own", F.pmod(F.col("s2"), F.col("b")).cast("int"))
    node = F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("role")))
    more = F.when(F.col("own") + 1 < F.col("b"), F.sequence(F.col("own") + 1, F.col("b") - 1)).otherwise(F.array().cast("array<int>"))
    query = F.transform(more, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("role")))
    rows = rows.withColumn("at", F.explode(F.concat(node, query))).select("shard", "at.*", "s1", "s2", "rep", "copies", "vec", "shards", "links")
    rows = rows.withColumn("task", F.xxhash64("shard", "i", "j"))
    dealt = rows.repartition(parts, "task").sortWithinPartitions("task", "role", "s1", "s2")
    return dealt.mapInPandas(_searched(cosine, near, beam), "s1 long, s2 long, rep long, n long, top long")


def recall(nodes: DataFrame, counts: DataFrame, cosine: float, sample: int = AUDIT) -> float:
    """The share of the links of some nodes, drawn by hash, that is in counts (s1, s2, n); the nodes are compared with every vector."""
    asked = nodes.orderBy(F.xxhash64("s2", F.lit(3)), "s1").limit(sample)
    some = asked.join(counts, ["s1", "s2"], "left").select("vec", "s1", "s2", F.coalesce("n", F.lit(0)).alias("n")).collect()
    if not some:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast((_double(r["vec"] for r in some), [(r["s1"], r["s2"]) for r in some]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names = shared.value
        u, total = unit(q), np.zeros(len(q), np.int64)
        at = {name: k for k, name in enumerate(names)}
        for pdf in batches:
            for a in range(0, len(pdf), ROWS):
                part = pdf.iloc[a : a + ROWS]
                v = _double(part["vec"])
                s = u @ unit(v).T
                r, c = np.nonzero(s >= cosine - DOUBT)
                ok = _linked(s[r, c], q, v, r, c, cosine)
                np.add.at(total, r[ok], part["copies"].to_numpy()[c[ok]])
                for k, name in enumerate(zip(part["s1"], part["s2"])):
                    if name in at and s[at[name], k] >= cosine - DOUBT:  # a node is no link of its own
                        total[at[name]] -= part["copies"].iloc[k]
        yield pd.DataFrame(dict(q=np.arange(len(q)), n=total))

    true = nodes.select("s1", "s2", "copies", "vec").mapInPandas(run, "q int, n long").agg(F.sum("n")).collect()[0][0] or 0
    return min(1.0, sum(r["n"] for r in some) / true) if true else 1.0


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors."""
    if not 0 < cosine <= 1:
        raise ValueError(f"cosine: {cosine}")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    near = math.cos(min(math.pi, REACH * math.acos(cosine)))
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    vec = F.transform(vec_col, lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(kind)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(_usable(F.col(vec_col)), vec).alias("vec"))
    top = rows.filter("vec IS NOT NULL AND id IS NOT NULL").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    fine = F.col("vec").isNotNull() & F.col("id").isNotNull() & (F.size("vec") == (top[0]["d"] if top else 0))
    name = lambda seed: F.when(fine, F.xxhash64(F.lit(seed), "vec"))
    rows = rows.select("id", name(0).alias("s1"), name(1).alias("s2"), "vec")
    nodes = rows.filter("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("vec").alias("vec"))
    nodes = scratch.put(nodes, "nodes")
    n = nodes.count()
    named = rows.select("id", "s1", "s2")
    if not n:
        return named.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    beam, replicas = BEAM, REPLICAS
    for k in range(TRIES):
        placed = scratch.put(_sharded(nodes, _lists(nodes, n, replicas), replicas, cosine), f"{k}-placed")
        sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("b"))
        blocks = F.broadcast(scratch.put(sizes, f"{k}-blocks"))  # at most MAX_LISTS rows
        graph = _graph(placed, blocks, near, beam, scratch, str(k))
        found = scratch.put(_search(graph, blocks, cosine, near, beam), f"{k}-found")
        counts = scratch.put(found.groupBy("s1", "s2").agg(F.sum("n").alias("n")), f"{k}-counts")
        for old in ("placed", "built", "graph", "blocks"):
            scratch.drop(f"{k}-{old}")
        if k == TRIES - 1 or recall(nodes, counts, cosine) >= TARGET:
            break
        beam, replicas = 2 * beam, replicas + 2
    joined = components(found.filter("top <> rep").select(F.col("rep").alias("a"), F.col("top").alias("b")).distinct(), scratch)
    own = nodes.select("s1", "s2", "rep", "copies").join(counts, ["s1", "s2"], "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    own = own.select("s1", "s2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    told = named.join(own, ["s1", "s2"], "left")
    component = F.coalesce("component_id", "id")
    return told.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def brute_force(rows: list[tuple], cosine: float = 0.95) -> list[tuple]:
    """The same rows by comparing all pairs; for tests.  Ids are not repeated with different vectors."""
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(a is not None and math.isfinite(a) for a in v) and any(v):
            fine[i] = np.array(v, np.float64)
    lengths = [len(v) for v in fine.values()]
    most = min(set(lengths), key=lambda d: (-lengths.count(d), d)) if lengths else 0
    ids = sorted(i for i, v in fine.items() if len(v) == most)
    links = {i: set() for i in ids}
    for k, i in enumerate(ids):
        rest = ids[k + 1 :]
        if rest:
            y = np.stack([fine[j] for j in rest])
            for j, c in zip(rest, cosines(np.broadcast_to(fine[i], y.shape), y)):
                if c >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    top = {}
    for i in ids:
        if i not in top:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in top:
                    top[j] = i
                    todo += links[j]
    return [(i, len(links.get(i, ())), top.get(i, i), i is None or top.get(i, i) == i) for i, _ in rows]
