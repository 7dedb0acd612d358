"""Where runs of L units occur again: sampled suffixes in q-gram buckets.

A unit is a byte or a word.  Of the q-grams in a run of L units the one with the
smallest hash (the rightmost of equals) is its anchor.  Equal runs have equal
anchors at the same offset, so only runs with one anchor gram need comparing,
and a stretch of starts that share an anchor is one row:

  sample   each document's anchors, each with its stretch of starts and the name
           (hash) of all the units its runs touch; equal names met in one batch
           are settled there, so thousands of copies do not all travel
  settle   anchors are bucketed by gram; in a bucket sorted by name, rows of one
           name are settled; a bucket with one name is done; of each name in a
           mixed bucket one row goes on.  Heavy buckets are spread by name
  compare  for those rows only, the text of the stretch is fetched and every
           suffix in it is refined with the others of its bucket: by
           ``suffix_dedup`` through bucket pointers, by ``substring_dedup`` through
           an index of the bucket; buckets too large for a task are refined by
           grouped counts instead, level by level

Two modes: ``any`` (a run occurs anywhere else) and ``earlier`` (it occurs in a
document with a smaller id; the source goes along).  Nothing is collected:
buckets are streamed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import _hashing as H
from quillmill.llm._scratch import Scratch
from quillmill.llm._worker import text_batches, tidy

#: Starts of runs handled at once; longer documents are cut into stretches that overlap.
SLICE = 1 << 19
#: Rows of a bucket compared in memory; larger buckets take the grouped count.
BUCKET_ROWS = 20_000
#: Buckets of more sampled rows are dealt out by name too, and known to be mixed.
HEAVY_ROWS = 2_000
#: So many heavy buckets are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Stands for a null id.
NO_ID = int(np.iinfo(np.int64).min)


def named_rows(docs: DataFrame, id_col: str, text_col: str, keep: dict[str, str], scratch: Scratch) -> DataFrame:
    """(id, row, text, *keep): ``row`` tells apart texts without an id and those that share one; elsewhere it is 0."""
    id_, text = F.col(id_col), F.col(text_col)
    rows = docs.select(F.coalesce(id_.cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), *[F.col(c).alias(x) for c, x in keep.items()])
    again = scratch.put(rows.groupBy("id").count().filter("count > 1").select("id"), "again")
    n = again.count()
    if not n:
        return rows.withColumn("row", F.lit(0).cast("long"))
    again = again.withColumn("_again", F.lit(True))
    rows = rows.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, "id", "left")
    return rows.withColumn("row", F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("_again")


@dataclass(frozen=True)
class Plan:
    unit: str  # byte or word
    length: int
    gram: int
    mode: str  # any or earlier


def _slices(texts: list[bytes]) -> Iterator[list[int]]:
    """Indices of texts, about SLICE bytes at a time; a longer text by itself."""
    at, size = [], 0
    for i, t in enumerate(texts):
        if at and size + len(t) >= SLICE:
            yield at
            at, size = [], 0
        at.append(i)
        size += len(t) + 1
    if at:
        yield at


def _elements(texts: list[bytes], plan: Plan):
    """Units as 64-bit names, first units of texts (n + 1), bytes, and each unit's start and end byte (None: units are bytes)."""
    if plan.unit == "word":
        return H.words(texts)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    return H.BYTE[buf], np.cumsum([0] + [len(t) for t in texts]), buf, None, None


def _stretches(texts: list[bytes], plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first unit, units, first units of texts): a single long text is cut into stretches of starts, whose runs overlap."""
    if len(texts) > 1:
        x, first, *_ = _elements(texts, plan)
        yield 0, x, first
        return
    whole = texts[0] if plan.unit == "byte" else H.words(texts)[0]
    step = 4 * SLICE
    for cut in range(0, max(1, len(whole) - plan.length + 1), step):
        part = whole[cut : cut + step + plan.length - 1]
        x = H.BYTE[np.frombuffer(part, np.uint8)] if plan.unit == "byte" else part
        yield cut, x, np.array([0, len(x)])


def _anchors(x: np.ndarray, first: np.ndarray, plan: Plan):
    """Arrays (text, anchor, first start, last start, gram, name); places are within the text."""
    n, L, k = len(x), plan.length, plan.gram
    if n < L:
        return None
    p = H.prefix(x)
    pos = np.arange(n - k + 1)
    grams = H.runs(p, pos, pos + k)
    low = np.uint64((1 << 24) - 1)
    assert n < 1 << 24
    v = (grams & ~low) | (low - pos.astype(np.uint64))
    width, have = L - k + 1, 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
    chosen = (low - (v & low)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(chosen)]
    ok = np.arange(len(chosen)) + L <= first[text + 1]
    s = np.flatnonzero(ok)
    if not len(s):
        return None
    new = np.ones(len(s), bool)
    new[1:] = (chosen[s[1:]] != chosen[s[:-1]]) | (text[s[1:]] != text[s[:-1]])
    at = np.flatnonzero(new)
    s1, s2 = s[at], s[np.append(at[1:], len(s)) - 1]
    a, t = chosen[s1], text[s1]
    name = H.mix(H.runs(p, s1, s2 + L) + ((a - s1) * 4096 + (s2 - s1)).astype(np.uint64))
    base = first[t]
    return t, a - base, s1 - base, s2 - base, grams[a].view(np.int64), name.view(np.int64)


_SAMPLE = "id long, row long, a int, s1 int, s2 int, key long, name long, many boolean, state int, src long, src_s int"
_SPOT = "id long, row long, a int, s1 int, s2 int, key long, many boolean, state int, src long, src_s int"
_PIECE = "id long, row long, a int, s1 int, s2 int, key long, many boolean, piece binary"
#: A stretch of starts found again, in ``earlier`` mode with its source.
FOUND = "id long, row long, s1 int, s2 int, src long, src_s int"
#: state: a row to be bucketed, a settled stretch of starts, or a row to be refined
OPEN, SETTLED, REFINE = 0, 1, 2


def _sample(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for pdf in batches:
            ids, own_rows = pdf["id"].to_numpy(), pdf["row"].to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
            rows = []
            for at in _slices(texts):
                for cut, part, own in _stretches([texts[j] for j in at], plan):
                    if (got := _anchors(part, own, plan)) is not None:
                        t, a, s1, s2, key, name = got
                        rows.append((ids[np.asarray(at)[t]], own_rows[np.asarray(at)[t]], a + cut, s1 + cut, s2 + cut, key, name))
            if not rows:
                continue
            i, r, a, s1, s2, key, name = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((a, i, name, key))
            i, r, a, s1, s2, key, name = (c[order] for c in (i, r, a, s1, s2, key, name))
            new = np.ones(len(i), bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(i)))
            many = np.repeat(size > 1, size)
            state = np.where(new, OPEN, SETTLED)
            if plan.mode == "earlier":  # the same document does not count
                state = np.where(i == np.repeat(i[at], size), np.where(new, OPEN, -1), SETTLED)
            frame = pd.DataFrame(dict(id=i, row=r, a=a, s1=s1, s2=s2, key=key, name=name, many=many, state=state, src=0, src_s=0))
            if plan.mode == "earlier":
                there = state == SETTLED
                frame["src"], frame["src_s"] = np.where(there, np.repeat(i[at], size), 0), np.where(there, np.repeat(s1[at], size), 0)
            yield frame[frame["state"] >= 0]
            if plan.mode == "earlier":
                # A later stretch of the first document is no source, but may be settled elsewhere.
                rest = frame[frame["state"] < 0]
                if len(rest):
                    yield rest.assign(state=OPEN)

    return run


def _settle(plan: Plan, heavy: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by (key, name, id, a).  At most two rows are held between batches.

    heavy: a bucket's names are in several tasks, and there is more than one.
    """
    cols = ["id", "row", "a", "s1", "s2", "key", "name", "many"]

    def run(batches):
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            now = pdf[cols].assign(told=False, sent=False)
            if held is not None:
                now = pd.concat([held, now], ignore_index=True)
            key, name, i = now["key"].to_numpy(), now["name"].to_numpy(), now["id"].to_numpy()
            new_key = np.ones(len(now), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= name[1:] != name[:-1]
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(now)))
            many = np.repeat((size > 1) | np.logical_or.reduceat(now["many"].to_numpy(bool), at), size)
            settled = many if plan.mode == "any" else i > np.repeat(i[at], size)
            key_at = np.flatnonzero(new_key)
            names = np.repeat(np.add.reduceat(new.astype(int), key_at), np.diff(np.append(key_at, len(now)))) + heavy
            refine = new & (names > 1)
            if plan.mode == "earlier":  # all stretches of the leading document
                refine = (names > 1) & ~settled
            told, sent = now["told"].to_numpy(bool), now["sent"].to_numpy(bool)
            out = now[["id", "row", "a", "s1", "s2", "key"]].assign(many=many)
            done = settled & ~told
            if done.any():
                lead = np.repeat(at, size)[done]
                from_, from_s = (i[lead], now["s1"].to_numpy()[lead]) if plan.mode == "earlier" else (0, 0)
                yield out[done].assign(state=SETTLED, src=from_, src_s=from_s)
            if (refine & ~sent).any():
                yield out[refine & ~sent].assign(state=REFINE, src=0, src_s=0)
            now = now.assign(many=many, told=told | settled, sent=sent | refine)
            tail, last = key_at[-1], at[-1]
            keep = [last] if heavy or tail == last else [tail, last]
            held = now.iloc[keep]
            if plan.mode == "earlier" and names[-1] == 1:
                # Unsent stretches of the leading document wait for a second name.
                wait = np.arange(len(now)) >= tail
                held = now[wait & (i == i[tail])]

    return run


def _contexts(plan: Plan) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From (id, row, text, spots) the bytes of each stretch."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, r, t, *spots in zip(*(pdf[c] for c in ("id", "row", "text", "a", "s1", "s2", "key", "many"))):
                raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
                if plan.unit == "word":
                    _, _, _, starts, ends = H.words([raw])
                for a, s1, s2, key, many in zip(*spots):
                    piece = raw[s1 : s2 + plan.length] if plan.unit == "byte" else raw[starts[s1] : ends[s2 + plan.length - 1]]
                    out.append((i, r, a, s1, s2, key, many, piece))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["id", "row", "a", "s1", "s2", "key", "many", "piece"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["id", "row", "a", "s1", "s2", "key", "many", "piece"])

    return run


def _runs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of every run of all rows."""
    n = (pdf["s2"] - pdf["s1"] + 1).to_numpy(np.int64)
    row = np.repeat(np.arange(len(pdf)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _merge(i: np.ndarray, r: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    """Starts, sorted by (i, r, s), as stretches."""
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    return pd.DataFrame(dict(id=i[at], row=r[at], s1=s[at], s2=s[np.append(at[1:], len(s)) - 1], src=0, src_s=0))


def _by_bucket(compare: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """compare() over whole buckets, from rows sorted by key; buckets are of at most BUCKET_ROWS rows."""

    def run(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            key = pdf["key"].to_numpy()
            if not len(key):
                continue
            cut = int(np.flatnonzero(key == key[-1])[0])
            held = pdf.iloc[cut:]
            for a in _parts(key[:cut]):
                yield from compare(pdf.iloc[a])
        if held is not None and len(held):
            yield from compare(held)

    return run


def _parts(key: np.ndarray) -> Iterator[slice]:
    """Slices of some thousand rows that end where a key ends."""
    at = 0
    while at < len(key):
        end = min(at + 4000, len(key))
        while end < len(key) and key[end] == key[end - 1]:
            end += 1
        yield slice(at, end)
        at = end


def _explode(plan: Plan, depths: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One row for each run of a bucket too large for a task, with its bucket identifiers at all depths."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4000):
                part = pdf.iloc[at : at + 4000]
                row, off = _runs(part)
                x, first, *_ = _elements([bytes(b) for b in part["piece"]], plan)
                p, begin = H.prefix(x), first[row] + off
                ids = np.stack([H.runs(p, begin, begin + d).view(np.int64) for d in depths], 1)
                yield pd.DataFrame(dict(
                    id=part["id"].to_numpy()[row], row=part["row"].to_numpy()[row], s=part["s1"].to_numpy()[row] + off,
                    key=part["key"].to_numpy()[row], ids=list(ids), many=part["many"].to_numpy(bool)[row],
                ))

    return run


def _large(pieces: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Refinement of buckets too large for a task: at each depth, suffixes alone in their bucket are left out."""
    depths = [plan.gram]
    while depths[-1] < plan.length:
        depths.append(min(2 * depths[-1], plan.length))
    runs = pieces.mapInPandas(_explode(plan, depths), "id long, row long, s int, key long, ids array<long>, many boolean")
    for level in range(len(depths)):
        runs = scratch.put(runs.withColumn("at", F.get("ids", F.lit(level))), f"runs{level}")
        held = runs.groupBy("key", "at").agg(F.count("*").alias("n"), F.min("id").alias("lead")).filter("n > 1")
        runs = runs.join(held, ["key", "at"])
        if level < len(depths) - 1:
            runs = runs.drop("at", "n", "lead")
    again = runs.filter(~F.col("many") if plan.mode == "any" else F.col("id") > F.col("lead"))
    return again.select("id", "row", F.col("s").alias("s1"), F.col("s").alias("s2"), F.col("lead").alias("src"), F.lit(None).cast("int").alias("src_s"))


def repeated_starts(docs: DataFrame, plan: Plan, compare: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], scratch: Scratch) -> DataFrame:
    """FOUND: stretches of starts of runs that occur again.  docs: (id long, row long, text string)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text_batches(docs.sparkSession)
    sample = scratch.put(docs.mapInPandas(tidy(_sample(plan)), _SAMPLE), "sample")
    bucketed = sample.filter(F.col("state") == OPEN).drop("state", "src", "src_s")
    heavy = scratch.put(bucketed.groupBy("key").count().filter(F.col("count") > HEAVY_ROWS).select("key"), "heavy")
    if heavy.count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    order = ("key", "name", "id", "a")
    light = bucketed.join(heavy, "key", "left_anti").repartition(n, "key").sortWithinPartitions(*order)
    spread = bucketed.join(heavy, "key", "left_semi").repartition(n, "key", "name").sortWithinPartitions(*order)
    spots = light.mapInPandas(tidy(_settle(plan, False)), _SPOT).union(spread.mapInPandas(tidy(_settle(plan, True)), _SPOT))
    spots = scratch.put(spots, "spots")
    todo = spots.filter(F.col("state") == REFINE)
    per_doc = todo.groupBy("id", "row").agg(F.collect_list(F.struct("a", "s1", "s2", "key", "many")).alias("x")).select(
        "id", "row", *[F.col(f"x.{c}").alias(c) for c in ("a", "s1", "s2", "key", "many")]
    )
    pieces = scratch.put(docs.join(per_doc, ["id", "row"]).mapInPandas(tidy(_contexts(plan)), _PIECE), "pieces")
    large = scratch.put(pieces.groupBy("key").count().filter(F.col("count") > BUCKET_ROWS).select("key"), "large")
    small = pieces.join(large, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key")
    found = small.mapInPandas(tidy(_by_bucket(compare)), FOUND)
    columns = [c.split()[0] for c in FOUND.split(", ")]
    done = [x.filter(F.col("state") == SETTLED).select(*columns) for x in (sample, spots)]
    out = done[0].union(done[1]).union(found)
    if large.limit(1).count():
        out = out.union(_large(pieces.join(large, "key", "left_semi"), plan, scratch).select(*columns))
    return out


def covered(s1: np.ndarray, s2: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of units that runs starting in [s1, s2] cover."""
    order = np.argsort(s1, kind="stable")
    a, b = s1[order].astype(np.int64), np.maximum.accumulate(s2[order].astype(np.int64) + length)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(a)) - 1]


def with_stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (id, row, ...) with arrays s1 and s2 of their stretches (null without any)."""
    per_doc = found.groupBy("id", "row").agg(F.collect_list(F.struct("s1", "s2")).alias("x"))
    return docs.join(per_doc.select("id", "row", F.col("x.s1").alias("s1"), F.col("x.s2").alias("s2")), ["id", "row"], "left")
