"""Target-distribution importance resampling by an external sort-count.

Each feature of a text, a run of one to ``ngrams`` words, falls into a bucket by
its CRC-32.  One pass writes the buckets of all features as packed 16-bit streams
with the offsets at which documents end.  The bucket counts of a corpus come from
sorting each stream and run-length encoding it; runs are summed up in a task and
then over tasks.  With the counts of source and target each bucket has a gain, and
a document's weight is gathered from the same streams by ``np.add.reduceat``.
Documents are drawn without replacement by Gumbel keys: weight plus noise that
depends on the id and ``salt`` alone, so a lost task makes the same rows again.

CRC-32 is linear, so nothing is hashed word by word: all words of a slice take
one byte further at a time, and the value of "a b" comes from those of "a" and
" b" by a table of the second one's length.

Memory of a task is bounded by ``SLICE`` bytes of text, however long a text is: a
longer one has several rows of streams, whose gains are added up again.

Defined results, one row for each row of the input: null, empty and word-less
texts have no features and weight 0; a null id is hashed as if it were an empty
one; equal scores rank by smaller id, null ids last, and then by text; repeated
rows rank one after another; an empty source gives an empty result; an empty
target gives gains from the source alone; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._native import table
from quillmill.llm._scratch import Scratch

BUCKETS = 10_000
NGRAMS = 2
#: Bytes of text that are worked on at once; a longer text is cut between words.
SLICE = 1 << 21
#: Words of up to so many bytes are appended by table.
LENGTHS = 48
#: x30-x39 and x61-x7A and what is beyond ASCII are of words; A-Z has become a-z.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
STREAMS = "docs array<struct<row:long,id:long,name:long>>, whole boolean, words array<long>, ends array<long>, stream binary"


@functools.cache
def _byte_table() -> np.ndarray:
    """What one more byte does to the register of a CRC-32."""
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> np.uint32(1)) ^ np.uint32(0xEDB88320), v >> np.uint32(1))
    return v


@functools.cache
def _shift_tables() -> np.ndarray:
    """[length, k, v]: what byte k of value v of a CRC-32 becomes once ``length`` further bytes follow."""
    out = np.zeros((LENGTHS + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    step = _byte_table()
    for n in range(1, LENGTHS + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of each with a space before it."""
    step, length = _byte_table(), ends - starts
    full = np.uint32(0xFFFFFFFF)
    order = np.argsort(-length, kind="stable")
    out = []
    for first in (full, step[(full ^ np.uint32(0x20)) & 255] ^ (full >> np.uint32(8))):
        reg = np.full(len(starts), first, np.uint32)
        at, rank = starts[order], -length[order]
        for j in range(int(min(length.max(initial=0), LENGTHS))):
            n = int(np.searchsorted(rank, -j, side="left"))  # words longer than j come first
            reg[:n] = step[(reg[:n] ^ buf[at[:n] + j]) & 255] ^ (reg[:n] >> np.uint32(8))
        for k in range(int(np.searchsorted(rank, -LENGTHS, side="left"))):
            a = int(at[k])
            rest = buf[a + LENGTHS : a - int(rank[k])].tobytes()
            reg[k] = np.uint32(zlib.crc32(rest, int(reg[k] ^ full))) ^ full
        crc = np.empty_like(reg)
        crc[order] = reg ^ full
        out.append(crc)
    return out[0], out[1]


def appended(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of both parts and the second one's length."""
    tables, out = _shift_tables(), np.empty_like(crc)
    short = length <= LENGTHS
    n, c = length[short], crc[short]
    out[short] = tables[n, 0, c & 255] ^ tables[n, 1, (c >> np.uint32(8)) & 255] ^ tables[n, 2, (c >> np.uint32(16)) & 255] ^ tables[n, 3, c >> np.uint32(24)]
    for k in np.flatnonzero(~short):
        zeros, left = int(crc[k]), int(length[k])
        while left:  # through LENGTHS zero bytes at a time
            m = min(left, LENGTHS)
            zeros = int(np.bitwise_xor.reduce(tables[m, np.arange(4), [(zeros >> s) & 255 for s in (0, 8, 16, 24)]]))
            left -= m
        out[k] = zeros
    return out ^ other


class Words:
    """The words of texts one after another: their CRC-32, those with a space before, and the text each is of."""

    def __init__(self, raws: list[bytes], carry: Words | None = None, ngrams: int = NGRAMS):
        buf = _LOWER[np.frombuffer(b"\n".join(raws), np.uint8)]
        gap = np.zeros(len(buf) + 2, bool)
        gap[1:-1] = _WORD[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[0::2], edge[1::2]
        self.crc, self.spaced = word_crcs(buf, starts, ends)
        self.length = ends - starts
        offs = np.cumsum([0] + [len(r) + 1 for r in raws])
        self.text = np.searchsorted(offs, starts, side="right") - 1
        self.carried = 0
        if carry is not None and ngrams > 1:
            tail = slice(max(0, len(carry.crc) - ngrams + 1), None)
            self.carried = len(carry.crc[tail])
            for name in ("crc", "spaced", "length"):
                setattr(self, name, np.concatenate([getattr(carry, name)[tail], getattr(self, name)]))
            self.text = np.concatenate([np.zeros(self.carried, self.text.dtype), self.text])

    def features(self, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of the features that end in a word that is not carried, by text."""
        found, owner, crc = [], [], self.crc
        for n in range(1, ngrams + 1):
            if n > 1:
                crc = appended(crc[:-1], self.spaced[n - 1 :], self.length[n - 1 :] + 1)
            low = max(0, self.carried - n + 1)
            own = self.text[low + n - 1 :]
            same = own == self.text[low : len(self.text) - n + 1]
            found.append((crc[low:][same] % np.uint32(buckets)).astype(np.uint16))
            owner.append(own[same])
        bucket, text = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(text, kind="stable")
        return bucket[order], text[order]


def _pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """A long text in pieces of about ``size`` bytes that end between words."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw):  # to the end of the word that stands there
            part = _WORD[_LOWER[np.frombuffer(raw, np.uint8, min(size, len(raw) - end), end)]]
            stop = int(np.argmin(part))
            if not part[stop]:
                end += stop
                break
            end += len(part)
        yield raw[at:end]
        at = end


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Packed bucket streams of some documents each; ``whole`` says that no other row has more of them.

    docs has their (row, id, name of the text), words their numbers of words, ends
    the offsets in the stream at which their features end.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError(f"buckets: {buckets}")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("name"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"),
    )

    def packed(owner: list[dict], whole: bool, words: Words, n: int) -> pd.DataFrame:
        bucket, text = words.features(ngrams, buckets)
        own = np.bincount(words.text[words.carried :], minlength=n)
        ends = np.searchsorted(text, np.arange(n), side="right")
        return pd.DataFrame(dict(docs=[owner], whole=[whole], words=[own], ends=[ends], stream=[bucket.tobytes()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, held, size = [], [], 0
            for row, i, name, raw in zip(pdf["row"], pdf["id"], pdf["name"], pdf["raw"]):
                own = dict(row=row, id=None if pd.isna(i) else int(i), name=name)
                if len(raw) > SLICE:
                    words = None
                    for piece in _pieces(raw, SLICE):
                        words = Words([piece], words, ngrams)
                        yield packed([own], False, words, 1)
                    continue
                owner.append(own)
                held.append(raw)
                size += len(raw)
                if size > SLICE:
                    yield packed(owner, True, Words(held), len(held))
                    owner, held, size = [], [], 0
            if held:
                yield packed(owner, True, Words(held), len(held))

    return rows.mapInPandas(run, STREAMS)


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): each stream is sorted and run-length encoded, and the runs of a task are summed up before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("stream"):
                s = np.sort(np.frombuffer(x.as_buffer(), np.uint16), kind="stable")
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
                total[s[first]] += np.diff(np.append(first, len(s)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of its share in the target over that in the source, both smoothed by one."""
    s, t, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _gathered(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, id, name, n_words, n_features, total) for each document."""
    shared = packed.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for owner, whole, words, ends, raw in pdf[["docs", "whole", "words", "ends", "stream"]].itertuples(index=False):
                g = shared.value[np.frombuffer(raw, np.uint16)]
                n = np.diff(ends, prepend=0)
                total = np.zeros(len(n), np.int64)
                if len(g):
                    total[n > 0] = np.add.reduceat(g, (ends - n)[n > 0])
                yield pd.DataFrame(dict(
                    row=[d["row"] for d in owner], id=pd.array([d["id"] for d in owner], "Int64"), name=[d["name"] for d in owner], whole=whole,
                    n_words=words, n_features=n, total=total,
                ))

    each = packed.mapInPandas(run, "row long, id long, name long, whole boolean, n_words long, n_features long, total long")
    kept = ["row", "id", "name", "n_words", "n_features", "total"]
    parts = each.filter(~F.col("whole")).groupBy("row", "id", "name").agg(*[F.sum(c).alias(c) for c in kept[3:]])
    return each.filter("whole").select(*kept).union(parts.select(*kept))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 25,
    min_words: int = 20, ngrams: int = NGRAMS, buckets: int = BUCKETS, salt: int = 7,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for each row of docs.

    ``percent`` of the documents of at least ``min_words`` words are drawn, those of
    the highest score; rank is 1, 2, 3 and so on for them and null for the others.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    own = scratch.put(streams(docs, id_col, text_col, ngrams, buckets), "source")
    aim = scratch.put(streams(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text")), "id", "text", ngrams, buckets), "target")

    def counted(packed: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(packed, buckets).collect():  # at most one row for each bucket
            out[r["bucket"]] = r["n"]
        return out

    each = _gathered(own, gains(counted(own), counted(aim)))
    # Floors go down, and remainders of Python and SQL differ for negative totals.
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = each.select("id", "name", "n_features", (F.col("n_words") >= min_words).alias("long_enough"), weight.alias("weight"), (weight + noise).alias("score"))
    order = [F.col("long_enough").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("name")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The place in a sorted partition is the id that Spark numbers it by; what comes before a partition is the sum of the others' sizes.
    placed = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.put(placed.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    for name in ("source", "target"):
        scratch.drop(name)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("long_enough").alias("m")).orderBy("part").collect()  # a row for each partition
    drawn, before, starts = percent * sum(r["m"] for r in sizes) // 100, 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(starts, "part").select(
        F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("long_enough") & (rank <= drawn), rank).alias("rank")
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple[int | None, str | None]], target: list[str | None], percent: int = 25, min_words: int = 20, ngrams: int = NGRAMS, buckets: int = BUCKETS, salt: int = 7) -> list[tuple]:
    """The same rows, feature by feature; for tests."""
    import hashlib
    import re

    def words(text: str | None) -> list[str]:
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def hashed(text: str | None) -> list[int]:
        w = words(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, ngrams + 1) for k in range(len(w) - n + 1)]

    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, found in [(s, [hashed(x) for _, x in docs]), (t, [hashed(x) for x in target])]:
        for f in found:
            for b in f:
                counts[b] += 1
    gain = gains(s, t).tolist()
    rows = []
    for i, text in docs:
        f = hashed(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES_SQL = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
#: CRC-32 of the bytes of f, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_SQL} AS w FROM documents),
df AS (SELECT r, unnest({_FEATURES_SQL}) AS f FROM d),
bf AS (SELECT unnest({_FEATURES_SQL}) AS f FROM (SELECT {_WORDS_SQL} AS w FROM benchmark)),
fb AS (SELECT f, {_CRC_SQL} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
sc AS (SELECT bucket, count(*) AS s FROM df JOIN fb USING (f) GROUP BY 1),
tc AS (SELECT bucket, count(*) AS t FROM bf JOIN fb USING (f) GROUP BY 1),
al AS (SELECT (SELECT count(*) FROM df)::double AS ss, (SELECT count(*) FROM bf)::double AS tt),
ga AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * (tt + {BUCKETS}))))::bigint AS gain
  FROM sc FULL JOIN tc USING (bucket), al),
we AS (SELECT r, count(*) AS n, sum(gain)::bigint AS total FROM df JOIN fb USING (f) JOIN ga USING (bucket) GROUP BY 1),
sd AS (SELECT doc_id, r, len(w) >= 20 AS enough, coalesce(n, 0)::bigint AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::bigint AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS noise FROM d LEFT JOIN we USING (r)),
ra AS (SELECT *, weight + noise AS score, row_number() OVER (ORDER BY enough DESC, weight + noise DESC, doc_id) AS place FROM sd)
SELECT doc_id, n_features, weight, score::bigint AS score, CASE WHEN enough AND place <= 25 * (SELECT count(*) FROM sd WHERE enough) // 100 THEN place END::bigint AS rank FROM ra
"""
