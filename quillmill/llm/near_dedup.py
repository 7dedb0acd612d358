"""MinHash near-dedup by a chosen-path set similarity join.

In each of ``TREES`` independent trees a document begins in the node of its
first ``DEPTH`` minwise tokens.  A small node is compared exhaustively, on full
sets.  A larger one is branched on recursively: each node chooses one or two
further minwise functions by a hash of its own path, and every member goes on to
the child of its token under each.  So a pair of Jaccard similarity J meets in
1.5 * J children of a node on average, more than one at the threshold of 0.8,
and is never lost on the way down with a probability of over 0.62 at any depth:
all ``TREES`` trees miss a link of exactly 0.8 with probability 6e-7 in small
first nodes, and below 5e-4 however deep its nodes have to be branched.

What is known is used: documents with equal sets are one class, whose smallest
id stands for it.  The first ``FIRST`` trees are compared before the others, and
after each level the links found so far are contracted to components.  A node
of one component is done; in any other, only members of different components
are compared.  A node is small if it has at most ``NODE_PAIRS`` such pairs and
its texts fit a task; the members outside its largest component then meet that
component block by block, so no task holds more than ``NODE_ROWS`` of it.  In a
node that branches on, one member of the largest component is compared with all
others at once, so that groups of near copies contract instead of branching.

A member that resembles all of a large node would go on to nearly the whole of it
again and again, if nothing there is linked and contracts (pages of one template).
So its average similarity to the node is estimated from ``PROBES`` minwise tokens,
and where branching on would copy it to more rows than comparing it here, it leaves
the node: one level later it is compared with all members of other components, hubs
of a block against each block of the node, and only the others branch on.  While
comparing one member of the largest component still halves the pairs of such a
node, that is done instead.

Of nodes with the same members one is kept.  What leaves a task are merges of
components, fewer than its members.

Defined results, one row for each row of the input: null, empty and word-less
texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle, the whole sequence; rows that repeat an id are one
document with several texts, whose links are those of any of them; a row without
an id links with nothing, has no component and is kept; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import _hashing as H
from quillmill.llm._components import components
from quillmill.llm._native import table
from quillmill.llm._scratch import Scratch
from quillmill.llm._worker import text_batches, tidy

TREES = 20
#: Minwise tokens on the path to a tree's first nodes.
DEPTH = 3
#: Trees that are compared before the others.
FIRST = 4
#: Minwise functions that larger nodes choose from.
POOL = 128
#: Pairs of members of different components that one node compares; nodes of more branch on.
NODE_PAIRS = 320_000
#: Members, and shingles, that one task compares at once; a node of FEW members may have longer texts.
NODE_ROWS = 800
NODE_UNITS = 1_500_000
FEW = 8
#: Members of a block of a node that members leave.
DENSE_ROWS = 2000
#: Minwise tokens, and about how many members of a node, that average similarities are estimated from.
PROBES = 32
PROBED = 256
#: Values of an incidence matrix, and hubs, at once.
CELLS = 1 << 22
HUBS = 512
#: Members of nodes whose texts are fetched by broadcasting them; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SLICE = 1 << 19
#: Rows that are worth a task of their own, and rows with texts; the least number of tasks that a step is dealt to.
TASK_ROWS = 20_000
TASK_TEXTS = 2_000
TASKS = 24

_PLACES = TREES * DEPTH
_RNG = np.random.RandomState(77)
_XOR = _RNG.randint(0, 2**63 - 1, _PLACES + POOL, dtype=np.int64).astype(np.uint64)
_MULTIPLY = _RNG.randint(0, 2**63 - 1, _PLACES + POOL, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _minwise(flat: np.ndarray, starts: np.ndarray, places: range) -> np.ndarray:
    """Of each set, which begin at starts in flat, the minwise tokens of the places."""
    least = np.empty((len(starts), len(places)), np.uint32)
    for j, k in enumerate(places):
        v = flat ^ _XOR[k]
        v *= _MULTIPLY[k]
        v >>= np.uint64(32)
        least[:, j] = np.minimum.reduceat(v.astype(np.uint32), starts)
    return least


def _first_nodes(tokens: np.ndarray) -> np.ndarray:
    """Names of the first node of each tree, from the tokens of all."""
    name = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(H.B), (len(tokens), TREES))
    for level in range(DEPTH):
        name = H.mix(name * np.uint64(H.B) + tokens[:, level::DEPTH])
    return name.view(np.int64)


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]
    h, first, *_ = H.words(raw)
    p = H.prefix(h)
    n = np.diff(first)
    start = np.arange(len(h) + 1)
    grams = H.runs(p, start[: max(0, len(h) - words + 1)], start[words:]) if len(h) >= words else np.zeros(0, np.uint64)
    out = []
    for a, k in zip(first[:-1].tolist(), n.tolist()):
        if k >= words:
            out.append(np.unique(grams[a : a + k - words + 1]))
        elif k:
            out.append(H.mix(H.runs(p, np.array([a]), np.array([a + k])) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sliced(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of texts, about SLICE characters at a time."""
    at, size = [], 0
    for j, t in enumerate(texts):
        at.append(j)
        size += len(t) if isinstance(t, str) else 0
        if size >= SLICE:
            yield at
            at, size = [], 0
    if at:
        yield at


def _profile(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"], pdf["text"].tolist()
            for at in _sliced(texts):
                sets = shingles([texts[x] for x in at], words)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                sums, mixed = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                nodes: list = [None] * len(at)
                if len(some):
                    flat = np.concatenate([sets[x] for x in some])
                    starts = np.cumsum(n[some]) - n[some]
                    sums[some] = np.add.reduceat(flat, starts)
                    mixed[some] = np.bitwise_xor.reduceat(H.mix(flat + np.uint64(0x5851F42D4C957F2D)), starts)
                    for x, row in zip(some, _first_nodes(_minwise(flat, starts, range(_PLACES)))):
                        nodes[x] = row
                yield pd.DataFrame(dict(
                    id=ids.iloc[at].to_numpy(), n=n, s1=sums.view(np.int64), s2=mixed.view(np.int64), nodes=pd.Series(nodes, dtype=object)
                ))

    return run


def _signs(words: int):
    """(id, sign): a text's tokens under the functions that larger nodes choose from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].tolist()
            for at in _sliced(texts):
                sets = shingles([texts[x] for x in at], words)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                if len(some):
                    tokens = _minwise(np.concatenate([sets[x] for x in some]), np.cumsum(n[some]) - n[some], range(_PLACES, _PLACES + POOL))
                    yield pd.DataFrame(dict(id=ids[np.asarray(at)[some]], sign=list(tokens.view(np.int32))))

    return run


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows of whole keys from rows sorted by key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if held and (cut or k[0] != held[-1][key].iloc[-1]):
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield pdf.iloc[:cut]
        if cut < len(pdf):
            held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _shared(sets: list[np.ndarray], hubs: int) -> Iterator[tuple[int, np.ndarray]]:
    """How many elements each of the first ``hubs`` sets has in common with every set: (first hub, counts), HUBS at a time."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    if hubs <= FEW:
        starts, out = np.cumsum(size) - size, np.empty((hubs, n), np.int64)
        for i in range(hubs):
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            out[i] = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
        yield 0, out
        return
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    often = np.bincount(column)[column] > 1  # the others are in no intersection
    column, row = column[often], row[often]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    width = max(1, min(CELLS // n, int(column[-1]) + 1 if len(column) else 1))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1, width)) if len(column) else np.zeros(0, np.int64)
    for first in range(0, hubs, HUBS):
        last = min(hubs, first + HUBS)
        out = np.zeros((last - first, n), np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(column)]):
            m = np.zeros((n, width), np.float32)
            m[row[a:b], column[a:b] % width] = 1
            out += (m[first:last] @ m.T).astype(np.int64)
        yield first, out


def _merged(part: np.ndarray, sets: list[np.ndarray], hubs: int, percent: int) -> list[tuple[int, int]]:
    """(component, lesser component) for what links between the first ``hubs`` sets and all sets join."""
    size = np.array([len(x) for x in sets])
    if len(sets) == 2:
        if part[0] == part[1]:
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(part.max(), part.min())] if 100 * both >= percent * (size.sum() - both) else []
    own, at = np.unique(part, return_inverse=True)
    top = np.arange(len(own))
    if not hubs or len(own) == 1:
        return []
    for first, both in _shared(sets, hubs):
        rows = slice(first, first + len(both))
        r, c = np.nonzero(100 * both >= percent * (size[rows, None] + size - both))
        r, c = at[first + r], at[c]
        new = top[r] != top[c]
        r, c = r[new], c[new]
        while len(r):  # each component takes the least name it is linked with
            now = top.copy()
            p, q = top[r], top[c]
            np.minimum.at(now, p, q)
            np.minimum.at(now, q, p)
            now = now[now]
            if (now == top).all():
                break
            top = now[top]
        while (top[top] != top).any():
            top = top[top]
    return [(own[i], own[j]) for i, j in enumerate(top) if i != j]


def _compared(words: int, percent: int):
    """Over rows sorted by block and role: hubs (role 0) are compared with all of their block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, "block"):
            block, part, role, texts = (pdf[c].to_numpy() for c in ("block", "part", "role", "text"))
            ends = [*(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            found, first, size, held = [], 0, 0, []
            for begin, end in zip([0, *ends], ends):
                held.append((begin, end))
                size += sum(map(len, texts[begin:end]))
                if size < SLICE and end < len(block):
                    continue
                sets = shingles(texts[first:end].tolist(), words)
                for a, b in held:
                    found += _merged(part[a:b], sets[a - first : b - first], int((role[a:b] == 0).sum()), percent)
                first, size, held = end, 0, []
            if found:
                yield pd.DataFrame(found, columns=["a", "b"]).drop_duplicates()

    return run


def _gathered(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """Few rows in few tasks: what Spark deals to many partitions would mostly be tasks that begin and end."""
    return df.coalesce(max(TASKS, -(-rows // each)))


def _with_part(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """rows (id, ...) with ``part``, the component known so far."""
    if parts is None:
        return rows.withColumn("part", F.col("id"))
    return rows.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")


def _shapes(member: DataFrame, n: int) -> DataFrame:
    """Of each node with several components: what to do with it.

    member: (node, id, units, part), about n rows.  Of a result n and c are the members of the node and of its
    largest component ``big``, more and most their shingles; lead is a member of big.
    """
    each = member.groupBy("node", "part").agg(F.count("*").alias("c"), F.sum("units").alias("u"), F.min("id").alias("lead"))
    whole = _gathered(each, n).groupBy("node").agg(
        F.sum("c").alias("n"), F.sum("u").alias("units"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max(F.struct("c", "part", "lead", "u")).alias("big")
    ).filter("n > big.c")
    whole = whole.select("node", "n", "units", F.expr("(n * n - squares) div 2").alias("pairs"), F.expr("units - big.u").alias("outside"), "big")
    one = (F.col("n") <= NODE_ROWS) & (F.col("units") <= NODE_UNITS) | (F.col("n") <= FEW)
    fits = one | (F.col("n") > NODE_ROWS) & (F.col("outside") <= NODE_UNITS)
    small = fits & (F.col("pairs") <= NODE_PAIRS)
    # Where all are hubs there is one block; else those of big, or all the others of a node that branches on, are dealt out.
    dealt = F.when(small, F.col("big.c")).otherwise(F.col("n") - F.col("big.c"))
    weight = F.when(small, F.col("big.u")).otherwise(F.col("outside"))
    blocks = F.when(small & one, 1).otherwise(F.ceil(F.greatest(dealt / NODE_ROWS, weight / NODE_UNITS)).cast("int"))
    return whole.select(
        "node", "n", "units", "pairs", small.alias("small"), (small & one).alias("one"), blocks.alias("blocks"), F.col("big.part").alias("big"), F.col("big.lead").alias("lead")
    )


def _tasks(member: DataFrame, shapes: DataFrame) -> DataFrame:
    """(block, role, id, part): what is compared with what."""
    rows = member.join(shapes, "node")
    in_big = F.col("part") == F.col("big")
    hub = F.col("one") | F.col("small") & ~in_big | ~F.col("small") & (F.col("id") == F.col("lead"))
    spoke = F.when(F.col("small"), in_big).otherwise(~in_big)
    rows = rows.filter(hub | spoke).withColumn("role", F.when(hub, 0).otherwise(1))
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("b", F.explode(F.when(hub, all_blocks).otherwise(own)))
    return rows.select(F.xxhash64("node", "b").alias("block"), "role", "id", "part")


def _judged(member: DataFrame, large: DataFrame, signs: DataFrame, n: int) -> DataFrame:
    """(node, id, units, before, sign, leaves): whether comparing a member of a large node here costs fewer rows than branching on.

    A member's average similarity is the mean share, over PROBES minwise functions of the pool, of the node's most
    frequent token where the member has that token; the shares are those of about PROBED members.  It decides where
    a member is compared, not with what result.
    """
    rows = member.select("node", "id", "units").join(large.select("node", "n", F.col("units").alias("all"), F.col("pairs").alias("before")), "node").join(signs, "id")
    begin = F.pmod(F.xxhash64("node", F.lit(4)), F.lit(POOL - PROBES + 1)).cast("int") + 1
    rows = rows.withColumn("probe", F.slice("sign", begin, PROBES))
    some = rows.filter(F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("n") / PROBED)) == 0)
    counts = some.select("node", F.posexplode("probe").alias("at", "token")).groupBy("node", "at", "token").agg(F.count("*").alias("c"))
    modes = _gathered(counts, n).groupBy("node", "at").agg(F.max(F.struct("c", "token")).alias("top"), F.sum("c").alias("of"))
    modes = _gathered(modes, n).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("top.token").alias("token"), (F.col("top.c") / F.col("of")).alias("share")))).alias("modes")
    )
    same = F.zip_with("probe", "modes", lambda x, m: F.when(x == m["token"], m["share"]).otherwise(0.0))
    rows = rows.join(modes, "node", "left").withColumn("_s", F.coalesce(F.aggregate(same, F.lit(0.0), lambda a, x: a + x) / PROBES, F.lit(0.0)))
    # Of members of similarity s the share 2s / (1 + s) stays together in a child.
    rows = rows.withColumn("_b", F.greatest(F.lit(0.05), F.least(F.lit(0.99), 2 * F.col("_s") / (1 + F.col("_s")))))
    over = F.greatest(F.col("n") / NODE_ROWS, F.col("all") / NODE_UNITS, F.lit(1.0))
    rows = rows.withColumn("_g", 1.5 * F.col("_b") + 1e-6).withColumn("_l", F.log(over) / -F.log("_b"))
    branched = F.col("_g") * (F.pow("_g", F.col("_l")) - 1) / (F.col("_g") - 1)
    here = 2 + 1.5 * F.greatest(F.col("n") / DENSE_ROWS, F.col("all") / NODE_UNITS)
    return rows.select("node", "id", "units", "before", "sign", (branched > here).alias("leaves"))


def _dense_tasks(member: DataFrame, level: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes that members leave: (block, role, id, part) to compare now, and the nodes whose rest is compared one level later.

    member: (node, id, units, part, before, leaves), where before is the node's pairs one level earlier.
    """
    each = member.groupBy("node", "part").agg(
        F.count("*").alias("c"), F.sum("units").alias("u"), F.min_by("id", F.xxhash64("id", F.lit(level))).alias("lead"), F.max("before").alias("before"),
        F.count_if("leaves").alias("cl"), F.sum(F.when(F.col("leaves"), F.col("units")).otherwise(0)).alias("ul"),
    )
    whole = _gathered(each, n).groupBy("node").agg(
        F.sum("c").alias("n"), F.sum("u").alias("units"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max("before").alias("before"),
        F.max(F.struct("c", "part", "lead", "u", "cl", "ul")).alias("big"), F.sum("cl").alias("cl"), F.sum("ul").alias("ul"),
    ).filter("n > big.c").withColumn("pairs", F.expr("(n * n - squares) div 2"))

    def blocks(n: Column, units: Column) -> Column:
        return F.ceil(F.greatest(n / DENSE_ROWS, units / NODE_UNITS)).cast("int")

    out_l, out_u = F.col("cl") - F.col("big.cl"), F.col("ul") - F.col("big.ul")
    whole = whole.select(
        "node", "pairs", F.col("big.part").alias("big"), F.col("big.lead").alias("lead"),
        # The last level's comparisons joined half of the pairs or more, and many are left: one member again.
        ((2 * F.col("pairs") <= F.col("before")) & (F.col("pairs") > NODE_PAIRS)).alias("again"),
        blocks(F.col("n"), F.col("units")).alias("bs"), blocks(out_l, out_u).alias("bo"), blocks(F.col("big.cl"), F.col("big.ul")).alias("bg"),
    )
    rows = member.drop("before").join(whole, "node")
    in_big = F.col("part") == F.col("big")

    def own(n: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.greatest(F.col(n), F.lit(1))).cast("int")

    def task(kind: int, hub: Column, spoke: Column, role: int) -> Column:
        return F.struct(F.lit(kind).alias("k"), hub.alias("h"), spoke.alias("s"), F.lit(role).alias("role"))

    def each_of(n: Column, make) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), make)).otherwise(F.array().cast("array<struct<k:int,h:int,s:int,role:int>>"))

    lead = F.when(F.col("id") == F.col("lead"), each_of(F.col("bs"), lambda j: task(0, F.lit(0), j, 0))).when(
        ~in_big, F.array(task(0, F.lit(0), own("bs", 1), 1))
    )
    outside, inside = F.col("leaves") & ~in_big, F.col("leaves") & in_big
    # Kind 1: those that leave, outside the largest component, with all; kind 2: those inside it with the others outside.
    hubs = F.when(outside, each_of(F.col("bs"), lambda j: task(1, own("bo", 2), j, 0))).when(
        inside, each_of(F.col("bs"), lambda j: task(2, own("bg", 2), j, 0))
    ).otherwise(each_of(F.lit(0), lambda j: task(0, j, j, 0)))
    spokes = each_of(F.when(outside, own("bo", 2)).otherwise(F.col("bo")), lambda i: task(1, i, own("bs", 1), 1))
    others = each_of(F.when(~F.col("leaves") & ~in_big, F.col("bg")).otherwise(0), lambda i: task(2, i, own("bs", 1), 1))
    rows = rows.withColumn("_t", F.explode(F.when(F.col("again"), lead).otherwise(F.concat(hubs, spokes, others))))
    tasks = rows.select(F.xxhash64("node", "_t.k", "_t.h", "_t.s", F.lit(5)).alias("block"), F.col("_t.role").alias("role"), "id", "part")
    later = member.drop("before", "part").join(whole.filter("again").select("node", F.col("pairs").alias("before")), "node")
    return tasks, later.select("node", "id", "units", "before", "leaves")


def _children(rows: DataFrame) -> DataFrame:
    """(node, id, units): members of large nodes in the children that these choose."""

    def child(place: Column) -> Column:
        return F.xxhash64("node", place, F.get("sign", place))

    one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(POOL)).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(POOL - 1)), F.lit(POOL)).cast("int")
    both = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(2)) == 0, F.array(child(one), child(two))).otherwise(F.array(child(one)))
    return rows.select(F.explode(both).alias("node"), "id", "units")


def _links(reps: DataFrame, rows: DataFrame, links: DataFrame | None, words: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """(id, component) of what is linked.

    reps: (id, units, nodes); rows: (id, text); links: (a, b) known before, if any id has several texts.
    """
    parts_n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def done_with(level: int) -> None:
        for name in ("member", "shapes", "tasks", "dense") if level >= 0 else ():
            scratch.drop(f"{name}{level}")
        if level > 0:
            scratch.drop(f"judged{level - 1}")

    def first_nodes(a: int, b: int) -> DataFrame:
        return reps.select(F.explode(F.slice("nodes", a + 1, b - a)).alias("node"), "id", "units")

    parts = signs = signed = None
    docs, members = reps.count(), 0
    again = links is not None
    if again:
        parts = components(links, scratch, "star-")
    place, dense, waiting, level = first_nodes(0, FIRST), None, True, 0
    while place is not None or dense is not None:
        shapes = later = large = None
        work = []
        rows_n = docs * (FIRST if level == 0 else TREES - FIRST if level == 1 else 0) + 2 * members
        members = 0
        if place is not None:
            if again:  # an id may be in a node with several of its texts
                place = place.groupBy("node", "id").agg(F.max("units").alias("units"))
            sizes = place.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who")).filter("n > 1")
            here = _gathered(_gathered(sizes, rows_n).groupBy("n", "who").agg(F.min("node").alias("node")).select("node"), rows_n)
            member = scratch.put(_gathered(_with_part(place.join(here, "node"), parts), rows_n), f"member{level}")
            members = member.count()
            shapes = scratch.put(_gathered(_shapes(member, members), members), f"shapes{level}")
            work.append(_tasks(member, shapes))
        if dense is not None:
            held = scratch.put(_gathered(_with_part(dense, parts), rows_n), f"dense{level}")
            held_n = held.count()
            now, later = _dense_tasks(held, level, held_n)
            members += held_n
            work.append(now)
        tasks = scratch.put(_gathered(work[0] if len(work) == 1 else work[0].union(work[1]), members), f"tasks{level}")
        tasks_n = tasks.count()
        placed = rows.join(few(tasks), "id").repartition(parts_n, "block").sortWithinPartitions("block", "role", "id")
        compared = _gathered(placed, tasks_n, TASK_TEXTS).mapInPandas(tidy(_compared(words, percent)), "a long, b long")
        found = scratch.put(_gathered(compared.distinct(), tasks_n), f"links{level}")
        done_with(level - 1)
        place, dense = None, later if later is not None and later.limit(1).count() else None
        if shapes is not None:
            large = shapes.filter(~F.col("small"))
        if large is not None and large.limit(1).count():
            wide = member.join(large, "node", "left_semi").select("id").distinct()
            if signed is not None:
                wide = wide.join(signed, "id", "left_anti")
            wide = scratch.put(_gathered(wide, members), f"wide{level}")
            if wide.limit(1).count():
                own = rows.join(few(wide), "id", "left_semi").mapInPandas(tidy(_signs(words)), "id long, sign array<int>")
                own = scratch.put(own, f"signs{level}")
                signs, signed = (own, wide) if signs is None else (signs.union(own), signed.union(wide))
            judged = scratch.put(_gathered(_judged(member, large, signs, members), members), f"judged{level}")
            place = _children(judged.filter(~F.col("leaves")))
            left = judged.filter("leaves").select("node").distinct()
            if left.limit(1).count():
                more = judged.join(left, "node", "left_semi").groupBy("node", "id").agg(
                    F.max("units").alias("units"), F.max("before").alias("before"), F.max("leaves").alias("leaves")
                )
                dense = more if dense is None else dense.union(more)
        if waiting:
            rest = first_nodes(FIRST, TREES)
            place, waiting = rest if place is None else place.union(rest), False
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            parts = components(links, scratch, f"star{level}-")
            # What is known is the components: their links stand for all that led to them.
            links = parts.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        level += 1
    done_with(level - 1)
    return parts


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    text_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = scratch.put(rows.mapInPandas(tidy(_profile(words)), "id long, n long, s1 long, s2 long, nodes array<long>"), "profile")
    n = profile.count()
    known = profile.filter("id IS NOT NULL AND n > 0")
    classes = known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    members = profile.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    members = scratch.put(_gathered(members, n), "members")
    # The texts of an id are one document: its classes belong together.
    several = members.filter("id IS NOT NULL AND n > 0").groupBy("id").count().filter("count > 1").select("id")
    several = scratch.put(_gathered(members.join(several, "id", "left_semi").select("id", "rep").distinct(), n), "several")
    own = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    reps = known.join(classes.select(F.col("rep").alias("id"), "n", "s1", "s2"), ["id", "n", "s1", "s2"], "left_semi")
    reps = reps.select("id", F.col("n").alias("units"), "nodes")
    again = bool(several.limit(1).count())
    if again:
        own, reps = own.dropDuplicates(["id", "text"]), reps.dropDuplicates(["id", "nodes"])
    known_links = several.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")) if again else None
    reps = scratch.put(_gathered(reps, n), "reps")
    scratch.drop("profile")
    found = _links(reps, own, known_links, words, percent, scratch)
    scratch.drop("reps")
    if found is None:
        named = members.withColumn("component", F.lit(None).cast("long"))
    else:
        named = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return named.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def brute_force(texts: list[tuple[int, str | None]], words: int = 2, percent: int = 80) -> list[tuple]:
    """The same rows by comparing all pairs; for tests."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            p, q = sets[i], sets[j]
            if p and q and min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)):
                both = len(p & q)
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a, b = top(i), top(j)
                    root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), top(i), top(i) == i) for i in ids]
