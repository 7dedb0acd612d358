"""Fill-in-middle transformation with a sparse index of checkpoints.

A text is counted once, block by block: its units (lines, or code points) and
its code points.  On the way the byte and code-point offset behind every
``EVERY``-th unit is recorded, so the index takes memory for one unit in
``EVERY``.  Each of the two cuts is found by a binary search for the last
checkpoint before it and a short rescan from there; nothing else is read twice.
Which documents are rearranged, where and in which order depends on the
document's id and ``salt`` alone, so a lost task makes the same rows again.

Defined results, one row for each row of the input: a null text is an empty one;
an empty text, one that contains a mark, and one beyond ``rate`` stay plain, the
text as it is; a null id is hashed as if it were an empty one; repeated rows give
equal rows; an empty table gives an empty result; columns named in ``keep`` are
carried along, and one that has the name of a result is an error.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._native import table

PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
#: Units from one checkpoint to the next.
EVERY = 256
#: Bytes that are counted at once.
BLOCK = 1 << 20
#: Percent of documents that are rearranged, and of those, percent with the suffix first.
RATE, SPM = 100, 50
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _leads(raw: np.ndarray) -> np.ndarray:
    """Where a code point begins."""
    return (raw & 0xC0) != 0x80


def _ends(raw: np.ndarray, low: int, unit: str) -> np.ndarray:
    """Byte offsets in raw, which stands at ``low`` of its text, behind which a unit is over."""
    if unit == "line":
        return np.flatnonzero(raw == 10) + 1
    at = np.flatnonzero(_leads(raw))
    return at[1:] if low == 0 else at


class Checkpoints:
    """The index of one text: units, code points, and where every ``EVERY``-th unit ends."""

    def __init__(self, raw: np.ndarray, unit: str = "line", every: int = EVERY, block: int = BLOCK):
        self.raw, self.unit = raw, unit
        self.units = self.chars = last = 0
        self.marks, self.bytes, self.points = [0], [0], [0]
        for low in range(0, len(raw), block):
            part = raw[low : low + block]
            ends = _ends(part, low, unit)
            own = np.arange((-self.units - 1) % every, len(ends), every)
            if len(own):
                before = np.concatenate([[0], np.cumsum(_leads(part), dtype=np.int32)])[ends[own]]
                self.marks += (self.units + 1 + own).tolist()
                self.bytes += (low + ends[own]).tolist()
                self.points += (self.chars + before).tolist()
            self.units += len(ends)
            self.chars += int(np.count_nonzero(_leads(part)))
            last = low + int(ends[-1]) if len(ends) else last
        self.units += len(raw) > last  # what follows the last end is a unit too

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` units."""
        if units >= self.units:
            return len(self.raw), self.chars
        k = bisect_right(self.marks, units) - 1
        at, points, left = self.bytes[k], self.points[k], units - self.marks[k]
        limit = self.bytes[k + 1] + 1 if k + 1 < len(self.bytes) else len(self.raw)
        while left:
            part = self.raw[at : min(at + BLOCK, limit)]
            ends = _ends(part, at, self.unit)
            ends = ends[1:] if len(ends) and ends[0] == 0 else ends  # of the unit before
            step = int(ends[min(left, len(ends)) - 1]) if len(ends) else len(part)
            left -= min(left, len(ends))
            points += int(np.count_nonzero(_leads(part[:step])))
            at += step
        return at, points


def _rearranged(raw: bytes, name: str, unit: str, rate: int, spm: int) -> tuple:
    """The results for one text; ``name`` is the hexadecimal hash that decides."""
    index = Checkpoints(np.frombuffer(raw, np.uint8), unit)
    n = index.units
    h1, h2, h3, h4 = (int(name[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not raw or any(m in raw for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, raw
    (a, ca), (b, cb) = (index.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < spm:
        return n, "spm", ca, cb - ca, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", ca, cb - ca, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",), unit: str = "line",
    rate: int = RATE, spm: int = SPM, salt: int = 7,
) -> DataFrame:
    """(*keep, n, form, prefix_chars, middle_chars, output) for each row of docs.

    unit: "line" (with its line break) or "char" (a code point).  form: plain, psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    if unit not in ("line", "char"):
        raise ValueError(f"unit: {unit}")
    if clash := {k.lower() for k in keep} & set(RESULTS):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    inner = {c: f"_k{j}" for j, c in enumerate(dict.fromkeys(keep))}
    rows = docs.select(*[F.col(c).alias(x) for c, x in inner.items()], named.alias("_name"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))
    kinds = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, names, raws = [batch.column(c) for c in inner.values()], batch.column("_name"), batch.column("_raw")
            made, first, size = [], 0, 0
            for k in range(len(raws)):
                made.append(_rearranged(raws[k].as_py(), names[k].as_py(), unit, rate, spm))
                size += len(made[-1][-1])
                if size > 4 * BLOCK or k == len(raws) - 1:  # results leave a few megabytes at a time
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*made), kinds)]
                    yield pa.RecordBatch.from_arrays([*[c.slice(first, len(made)) for c in own], *columns], [*inner.values(), *kinds.names])
                    made, first, size = [], k + 1, 0

    shape = ", ".join([*[f"{x} {rows.schema[x].dataType.simpleString()}" for x in inner.values()], "n long, form string, prefix_chars long, middle_chars long, output binary"])
    return rows.mapInArrow(run, shape).withColumnsRenamed({x: c for c, x in inner.items()}).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: no part contains a mark, so the marks alone tell the parts."""
    part = F.split(output, "<[PSM]>", -1)
    get = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(get(1), get(3), get(2))).otherwise(F.concat(get(2), get(3), get(1)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS u1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS u2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM own
), cut AS (
  SELECT *, array_to_string(units[1:least(u1, u2)], '') AS p, array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS m,
    array_to_string(units[greatest(u1, u2) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""


def brute_force(text: str | None, doc_id: int | None, unit: str = "line", rate: int = RATE, spm: int = SPM, salt: int = 7) -> tuple:
    """The same results for one text, by taking it apart whole; for tests."""
    import hashlib
    import re

    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    name = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m.decode() in text for m in MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
