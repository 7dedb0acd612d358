"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams
(n up to ``ORDERS``) over a bounded sample of labelled documents.  A document is
ranked in the same way from its whole text, and compared to each profile by the
out-of-place distance: the sum, over the document's n-grams, of how far the two
ranks are apart, with a fixed distance for n-grams the profile lacks.

Defined results: a null text, an empty one and one without a letter are ``und``
with score 0; ties go to the language that sorts first; without labelled rows
everything is ``und``; repeated rows each get a row; an empty table gives an
empty result; further columns are ignored unless in ``keep`` (a name of a result is an error); whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm._native import kept_columns, table
from quillmill.llm._worker import text_batches, tidy

ORDERS = 3
PROFILE = 1000
DOCUMENT = 400
#: Labelled documents per language that a profile is learned from, about so many at most.
SAMPLE_DOCS = 2000
#: Languages learned, those with the most labelled documents; this bounds the model.
LANGUAGES = 500
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as numbers, each run of anything else as one 1, with a 1 at both ends."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.concatenate([[1], np.where(_LETTER[0][c], c, 1), [1]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 1) | (c[:-1] != 1)
    return c[keep]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (21 bits a letter; no two are one number) and their counts; none if there is no letter."""
    c = _codes(text)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [c[c > 1]]
    pair = (c[:-1] << 21) | c[1:]
    found.append(pair)
    inner = c[1:-1] != 1  # of three, the middle one is a letter
    found.append((pair[:-1][inner] << 21) | c[2:][inner])
    flat = np.sort(np.concatenate(found[:ORDERS]))
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[at], np.diff(np.append(at, len(flat)))


def ranked(text: str, top: int = DOCUMENT) -> np.ndarray:
    g, n = grams(text)
    return g[np.argsort(-n, kind="stable")[:top]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.all = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
        self.rank = np.full((len(self.names), len(self.all) + 1), PROFILE, np.int64)  # the last column: no such n-gram
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.all, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text) if isinstance(text, str) else ()
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.all, own)
        at[at == len(self.all)] = 0
        at = np.where(self.all[at] == own, at, len(self.all))
        r = self.rank[:, at]
        apart = np.where(r == PROFILE, PROFILE, np.abs(r - np.arange(len(own)))).sum(1)
        best = int(np.argmin(apart))
        return self.names[best], float(1.0 - apart[best] / (PROFILE * len(own)))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from about SAMPLE_DOCS documents, chosen by a hash of the id, of each of at most LANGUAGES languages."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_DOCS)) / F.col("count"))
    picked = rows.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64(F.lit("profile"), F.col("id")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                got = [grams(t) for t in part["text"] if isinstance(t, str)]
                if got:
                    g, at = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
                    yield pd.DataFrame(dict(lang=lang, gram=g, n=np.bincount(at, np.concatenate([n for _, n in got]), len(g)).astype(np.int64)))

    counted = picked.select("lang", "text").mapInPandas(tidy(count), "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= PROFILE).orderBy("lang", "r")
    profiles: dict[str, list[int]] = {}
    for r in top.collect():  # languages times PROFILE
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles)


def predicted(text: Column, model: Profiles) -> Column:
    """struct(lang_pred, score) of a text column; only the text goes through Python."""
    spark = SparkSession.active()
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    # Called non-deterministic so that a filter on the result is not pushed before it as a second evaluation.
    return F.pandas_udf(tidy(run), "lang_pred string, score double").asNondeterministic()(text)


def predict(docs: DataFrame, model: Profiles, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score) for each row of docs."""
    own = [F.col(c) for c in kept_columns(keep, ("lang_pred", "score"))]
    return docs.select(*own, predicted(F.col(text_col), model).alias("_p")).select(*own, "_p.lang_pred", "_p.score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))
