"""Secret scan: known shapes, and strings of high sliding-window Shannon entropy.

The entropy of a window of ``WINDOW`` characters is kept by incremental counts:
with S the sum of c*log2(c) over the counts c of the window's characters,
entropy is log2(WINDOW) - S/WINDOW, and a step of the window changes two counts.
Candidate strings are judged by the threshold of their character class; the
allow-list (identifiers such as UUIDs, placeholders, plain words) suppresses
entropy findings only, never the known shapes.

All of it is DataFrame functions in one narrow stage.  Null texts count as
empty, repeated rows each get their own result, empty tables give empty
results, other columns are ignored unless named in ``keep`` (a name of a result is an error), and long texts
are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._native import find_spans, kept_columns, let, render, table, tag

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = KINDS[:3]
WINDOW = 20
#: (class, what all characters of the string must match, bits per character)
CLASSES = (("digit", "^[0-9+/_=-]+$", 3.0), ("hex", "^[0-9A-Fa-f]+$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.7), ("base64", "^[A-Za-z0-9+/_=-]+$", 3.9))
#: Strings that look random and are no secrets: UUIDs, placeholders, words of one case or with
#: a capital, names of several such words run together, rules, dates, and digits counted up.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|dummy|sample|changeme",
    r"^[+/_=-]*([A-Z]?[a-z]+|[A-Z]+)([+/_=-]+([A-Z]?[a-z]+|[A-Z]+))*[+/_=-]*$",
    r"^[a-z]*([A-Z][a-z]+)+$",
    r"^[+/_=-]+$",
    r"^([0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}[+/_=-]*)+$",
    r"^0?(1234567890?)+[0-9]?$",
)


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """Largest entropy in bits of any ``window`` consecutive characters (0 if shorter)."""

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(F.lit(0.0))

    def bump(counts: Column, at: Column, by: int) -> Column:
        return F.transform(counts, lambda c, j: F.when(j == at, c + by).otherwise(c))

    def slide(codes: Column, letters: int | Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.get(codes, i - window)
            c_new, c_old = F.get(acc["counts"], new), F.get(acc["counts"], old)
            # Where the window moves and both are one character, its count stays.
            moved = acc["s"] + weight(c_new + 1) - weight(c_new) - weight(c_old) + weight(c_old - 1)
            s = F.when(i < window, acc["s"] + weight(c_new + 1) - weight(c_new)).when(new == old, acc["s"]).otherwise(moved)
            counts = F.when(i < window, bump(acc["counts"], new, 1)).when(new == old, acc["counts"]).otherwise(
                bump(bump(acc["counts"], new, 1), old, -1)
            )
            h = F.log2(F.lit(float(window))) - s / window
            top = F.when((i >= window - 1) & (h > acc["best"]), h).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), s.alias("s"), top.alias("best"))

        start = F.struct(F.array_repeat(F.lit(0), letters).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["best"])

    def coded(chars: Column) -> Column:
        return let(
            F.array_distinct(chars),
            lambda letters: let(
                F.transform(chars, lambda ch: (F.array_position(letters, ch) - 1).cast("int")),
                lambda codes: slide(codes, F.size(letters)),
            ),
        )

    return let(F.split(string, "(?!^)(?!$)"), coded)


def _random_looking(m: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | m.rlike(pattern)
    floor = F.lit(99.0)
    for _, shape, bits in reversed(CLASSES):
        floor = F.when(m.rlike(shape), F.lit(bits)).otherwise(floor)
    return F.when(allowed, False).otherwise(window_entropy(m) >= floor)


def secret_spans(text: Column) -> Column:
    """array<struct<s,k,e,kind,m>> of base spans and of entropy spans."""
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    assign = F.filter(
        find_spans(text, ASSIGN, named), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6
    )
    access = find_spans(text, ACCESS, F.contains(text, F.lit("AKIA")))
    return F.concat(
        tag(assign, "assign", 0), tag(access, "access", 1), tag(find_spans(text, HEX), "hex", 2),
        tag(F.filter(find_spans(text, CANDIDATE), lambda x: _random_looking(x["m"])), "entropy", 3),
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``docs`` with ``spans`` array<struct<s,k,e,kind,m>> (k orders the kinds)."""
    own = [F.col(c) for c in kept_columns([id_col, *keep], ("spans",))]
    return docs.select(*own, secret_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["k"] < len(BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans")
    )


def _duck(kind: str, order: int, pattern: str, ok: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} k, '{kind}' kind, s, s + length(m) e FROM (
    SELECT doc_id, unnest(ms) m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))) s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') ms, string_split_regex(t, '{pattern}') ps FROM d)) WHERE {ok}"""


_KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_KEYED = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""
_ENTROPY = f"""list_max(list_transform(range(1, length(m) - {WINDOW} + 2), lambda i: log2({WINDOW}) - list_sum(list_transform(
  map_values(list_histogram(string_split(m[i:i+{WINDOW - 1}], ''))), lambda c: c * log2(c))) / {WINDOW}.0))"""
_NOT_ALLOWED = " AND ".join(f"NOT regexp_matches(m, '{p}')" for p in ALLOW)
_FLOOR = "CASE " + " ".join(f"WHEN regexp_matches(m, '{shape}') THEN {bits}" for _, shape, bits in CLASSES) + " END"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), a AS (
{_duck('assign', 0, _KEYED + '[A-Za-z0-9+/_.=-]+', f"length(regexp_extract(m, '{_KEYED.replace(chr(39), chr(39) * 2)}([A-Za-z0-9+/_.=-]+)', 1)) >= 6")}
UNION ALL {_duck('access', 1, 'AKIA[A-Z0-9]+', 'length(m) >= 20')}
UNION ALL {_duck('hex', 2, '[0-9a-f]+', 'length(m) >= 24')}
UNION ALL {_duck('entropy', 3, '[A-Za-z0-9+/_=-]{20,}', f'{_NOT_ALLOWED} AND {_ENTROPY} >= {_FLOOR}')})
SELECT d.doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (k = 0) n_assign, count(*) FILTER (k = 1) n_access, count(*) FILTER (k = 2) n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) spans FROM a GROUP BY 1) USING (doc_id)
"""
