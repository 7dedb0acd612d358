"""Substring dedup by relative Lempel-Ziv parsing against the documents with smaller ids.

A reference block is a bucket: the stretches of words, of all documents, around
one anchor gram (``_repeats``), each different stretch once, at its smallest id.
A document is parsed against every block that holds one of its anchors, which are
all that can hold a window of it.  A stretch that a block holds whole, at a
smaller id, is one factor.  In the others the block is indexed by a suffix array
with the owner of each suffix (``_pointers``), and a stretch is parsed greedily:
the longest factor from a place on whose source is a document with a smaller id;
if it is long enough it is kept, and parsing goes on at the first window that
reaches over the factor's end, so that no window at a boundary is lost, else at
the next word.  Kept factors are the duplicate spans; adjoining ones join.

Defined results: null and empty texts have no words; texts under a window keep
everything; rows of one id are one document, which is no source for itself, and
each returns a row; a null id comes before all others; an empty table gives an
empty result; further columns are ignored unless named in ``keep``,
where names of results are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import _hashing as H
from quillmill.llm._native import kept_columns, table
from quillmill.llm._pointers import longest_earlier
from quillmill.llm._repeats import NO_ID, Plan, covered, named_rows, repeated_starts, with_stretches
from quillmill.llm._scratch import Scratch
from quillmill.llm._worker import tidy

LENGTH = 50
GRAM = 8


def _parsed(length: int):
    """The long factors of a block's stretches."""
    q = max(d for d in range(1, 9) if length % d == 0)  # the index compares in steps that windows are made of

    def compare(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        words, first, *_ = H.words([bytes(b) for b in pdf["piece"]])
        rows, n = np.arange(len(pdf)), np.diff(first)
        end = first[1:] + rows  # a unit of its own after each stretch, which no factor reaches over
        units = np.empty(len(words) + len(pdf), np.uint64)
        ends = np.zeros(len(units), bool)
        ends[end] = True
        units[~ends], units[ends] = words, H.mix(rows.astype(np.uint64) + np.uint64(1))
        row_of = np.repeat(rows, n + 1)
        p, start = H.prefix(units), np.arange(len(units))
        grams = H.runs(p, start, np.minimum(start + q, len(units)))
        long, source = longest_earlier(units, grams, q, 2 * length, pdf["id"].to_numpy()[row_of])
        s1, s2 = pdf["s1"].to_numpy(np.int64), pdf["s2"].to_numpy(np.int64)
        begin = first[:-1] + rows
        place = start - begin[row_of]
        at = np.flatnonzero((place <= (s2 - s1)[row_of]) & (long >= length) & ~ends)  # where a long factor may begin
        if not len(at):
            return
        reach = at + long[at] - length  # the last window in the factor
        after = np.searchsorted(at, reach, side="right")
        mine = row_of[at]
        step, taken = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])), []
        while len(step):
            taken.append(step)
            go = after[step]
            step = go[(go < len(at)) & (mine[np.minimum(go, len(at) - 1)] == mine[step])]
        taken = np.sort(np.concatenate(taken))
        at, reach = at[taken], reach[taken]
        row, src = row_of[at], row_of[source[at]]
        yield pd.DataFrame(dict(
            id=pdf["id"].to_numpy()[row], row=pdf["row"].to_numpy()[row], s1=s1[row] + place[at], s2=s1[row] + place[reach],
            src=pdf["id"].to_numpy()[src], src_s=s1[src] + place[source[at]],
        ))

    return compare


def _found(rows: DataFrame, length: int, gram: int, scratch: Scratch) -> DataFrame:
    return repeated_starts(rows.select("id", "row", "text"), Plan("word", length, gram, "earlier"), _parsed(length), scratch)


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, start, words, source_id, source_start): the kept factors, in words; what goes on in one source is one factor.

    source_start is null where the source was found in a block too large for a task.
    """
    scratch = Scratch(docs.sparkSession, "factors")
    found = _found(named_rows(docs, id_col, text_col, {}, scratch), length, gram, scratch).distinct()
    order = Window.partitionBy("id", "row", "src", F.col("s1") - F.col("src_s")).orderBy("s1", "s2")
    reach = F.max("s2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("s1") > reach + 1, F.lit(True)) | F.col("src_s").isNull()
    found = found.withColumn("_new", fresh.cast("int")).withColumn("_factor", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = found.groupBy("id", "row", "src", (F.col("s1") - F.col("src_s")).alias("_by"), "_factor").agg(
        F.min("s1").alias("start"), (F.max("s2") - F.min("s1") + length).cast("long").alias("words"), F.min("src_s").alias("source_start")
    )
    no_id = F.lit(NO_ID)
    return whole.select(F.nullif("id", no_id).alias(id_col), "start", "words", F.nullif("src", no_id).alias("source_id"), "source_start")


def _cut(length: int, keep: Sequence[str]):
    def run(batches):
        for pdf in batches:
            n, gone, kept = [], [], []
            for t, s1, s2 in zip(pdf["text"], pdf["s1"], pdf["s2"]):
                words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
                n.append(len(words))
                if s1 is None or not len(s1):
                    gone.append(0)
                else:
                    a, b = covered(np.asarray(s1), np.asarray(s2), length)
                    gone.append(int((b - a).sum()))
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(words)]
                    words = [w for x, y in zip(edges[0::2], edges[1::2]) for w in words[x:y]]
                kept.append(b" ".join(words))
            yield pdf[["id", *keep]].assign(n_words=n, n_removed=gone, kept=pd.Series(kept, dtype=object))

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, *keep, n_words, n_removed, kept binary) for each row of docs."""
    keep = [c for c in kept_columns([id_col, *keep], ("n_words", "n_removed", "kept")) if c != id_col]
    scratch = Scratch(docs.sparkSession, "substring")
    inner = {c: f"_k{j}" for j, c in enumerate(keep)}
    rows = named_rows(docs, id_col, text_col, inner, scratch)
    found = _found(rows, length, gram, scratch)
    fields = [T.StructField("id", T.LongType()), *[rows.schema[x] for x in inner.values()]]
    fields += [T.StructField(x, T.LongType()) for x in ("n_words", "n_removed")] + [T.StructField("kept", T.BinaryType())]
    out = with_stretches(rows, found).mapInPandas(tidy(_cut(length, list(inner.values()))), T.StructType(fields))
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias(id_col), *[F.col(x).alias(c) for c, x in inner.items()], "n_words", "n_removed", "kept"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same rows as op8's by a dictionary of all windows; for tests."""
    docs = [(i, (t or "").encode("utf-8", "surrogatepass").split()) for i, t in texts]
    first: dict[tuple, int] = {}
    for i, w in docs:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
