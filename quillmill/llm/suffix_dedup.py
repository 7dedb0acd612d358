"""Suffix dedup by bucket-pointer refinement: bytes covered by a run of L bytes that also starts anywhere else.

Suffixes begin in buckets of their first q bytes (``GRAM``).  A bucket of more
than one suffix is refined: its suffixes are sorted on the bucket identifiers of
the suffixes q bytes later, and the identifiers that this gives are reused at the
next level, which sorts on those 2q bytes later, and so on until the depth is L
(32, 64, 128, 200 bytes).  Suffixes alone in their bucket are done (``_pointers``).
Depth ends at L since deeper order does not change which bytes go.

Refinement needs the suffixes of a bucket and those at later offsets in one
task, so Spark deals them out by the anchor q-gram that equal runs have in common
(``_repeats``); stretches of suffixes with equal contexts count as one suffix each
from there on, and a stretch whose anchor is nowhere else is never refined.

Defined results: a null text is empty; texts under L bytes keep everything; runs
never cross documents; overlapping occurrences count; every row is a document of
its own, rows that repeat an id and rows without one too; an empty table gives an
empty result; further columns are ignored unless in ``keep``,
where names of results are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import _hashing as H
from quillmill.llm._native import kept_columns, table
from quillmill.llm._pointers import refined
from quillmill.llm._repeats import NO_ID, Plan, _merge, _runs, covered, named_rows, repeated_starts, with_stretches
from quillmill.llm._scratch import Scratch
from quillmill.llm._worker import tidy

LENGTH = 200
GRAM = 32


def _repeats_of(length: int, gram: int):
    """The starts of a bucket's runs that occur again, by refining all suffixes of its stretches."""

    def compare(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raws = [bytes(b) for b in pdf["piece"]]
        first = np.cumsum([0] + [len(b) for b in raws])
        p = H.prefix(H.BYTE[np.frombuffer(b"".join(raws), np.uint8)])
        n = len(p) - 1
        start = np.arange(n)
        grams = H.runs(p, start, np.minimum(start + gram, n)) + (start > n - gram) * start.astype(np.uint64)
        for _, ids in refined(grams, gram, length):
            pass
        row, off = _runs(pdf)
        bucket = ids[first[row] + off]  # of the runs alone: contexts overlap
        order = np.argsort(bucket, kind="stable")
        same = bucket[order][1:] == bucket[order][:-1]
        again = np.zeros(len(bucket), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        hit = np.flatnonzero(again & ~pdf["many"].to_numpy(bool)[row])
        if len(hit):
            i, r, s = pdf["id"].to_numpy()[row[hit]], pdf["row"].to_numpy()[row[hit]], pdf["s1"].to_numpy()[row[hit]] + off[hit]
            order = np.lexsort((s, r, i))
            yield _merge(i[order], r[order], s[order])

    return compare


def _cut(length: int, keep: Sequence[str]):
    def run(batches):
        for pdf in batches:
            n, gone, spans, kept = [], [], [], []
            for t, s1, s2 in zip(pdf["text"], pdf["s1"], pdf["s2"]):
                raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
                n.append(len(raw))
                if s1 is None or not len(s1):
                    gone.append(0)
                    spans.append(0)
                    kept.append(raw)
                    continue
                a, b = covered(np.asarray(s1), np.asarray(s2), length)
                gone.append(int((b - a).sum()))
                spans.append(len(a))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[0::2], edges[1::2])))
            yield pdf[["id", *keep]].assign(n_bytes=n, n_removed=gone, n_spans=spans, kept=pd.Series(kept, dtype=object))

    return run


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, *keep, n_bytes, n_removed, n_spans, kept binary) for each row of docs."""
    keep = [c for c in kept_columns([id_col, *keep], ("n_bytes", "n_removed", "n_spans", "kept")) if c != id_col]
    scratch = Scratch(docs.sparkSession, "suffix")
    inner = {c: f"_k{j}" for j, c in enumerate(keep)}
    rows = named_rows(docs, id_col, text_col, inner, scratch)
    plan = Plan("byte", length, gram, "any")
    found = repeated_starts(rows.select("id", "row", "text"), plan, _repeats_of(length, gram), scratch)
    fields = [T.StructField("id", T.LongType()), *[rows.schema[x] for x in inner.values()]]
    fields += [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    out = with_stretches(rows, found).mapInPandas(tidy(_cut(length, list(inner.values()))), T.StructType(fields))
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias(id_col), *[F.col(x).alias(c) for c, x in inner.items()], "n_bytes", "n_removed", "n_spans", "kept"
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same rows as op1's by a dictionary of all runs; for tests."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for _, t in texts]
    seen: dict[bytes, int] = {}
    for raw in raws:
        for s in range(len(raw) - length + 1):
            seen[raw[s : s + length]] = seen.get(raw[s : s + length], 0) + 1
    out = []
    for (i, _), raw in zip(texts, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[: len(raw)]])
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
