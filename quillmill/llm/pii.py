"""Personal data: regular expressions propose, checksums confirm, context scores.

A span's score is that of its kind, and ``CONTEXT_GAIN`` more where one of the
kind's words stands within ``CONTEXT_CHARS`` characters before or after it.  The
base kinds always count; of the added ones, spans of at least ``ADMIT`` do: IBANs,
whose checksum is evidence enough, and national phone numbers that context names.

All of it is DataFrame functions, so one narrow JVM stage without a shuffle.

Defined results: a null text counts as empty (no spans); repeated rows each get
their own result; an empty table gives an empty result; further columns of the
input are ignored by ``scan_pii`` unless named in ``keep`` (a name of a result is an error); long texts are read
whole (every pattern uses possessive runs and run-start guards, so a long run
of letters or digits costs linear time and no stack).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm._native import cut, find_spans, fresh, kept_columns, let, pieces, render, running, table, tag

# A match inside a run of word characters succeeds exactly if the one from the
# start of the run does, so only run starts (or the end of the last match) are tried.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])"

LOCAL = r"0[0-9]{1,4}[\x20/.-][0-9][\x20/.0-9-]+[0-9]"

KINDS = ("email", "ip", "card", "phone", "iban", "local")
BASE_KINDS = KINDS[:4]
#: Words that make a kind likelier, looked for on both sides of the span.
CONTEXT = {
    "email": "e?mail|contact|write|correo|courriel",
    "ip": "ip|host|server|address|addr|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|fax|telefon|telefono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "local": "phone|tel|telephone|call|mobile|fax|telefon|telefono",
}
#: In hundredths.
BASE_SCORE = {"email": 80, "ip": 50, "card": 70, "phone": 50, "iban": 80, "local": 40}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 20
ADMIT = 60
_SCORED = "array<struct<s:int,k:int,e:int,kind:string,m:string,points:int>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _whole_words(words: str) -> str:
    return f"(^|[^a-z])({words})([^a-z]|$)"


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def step(acc: Column, ch: Column) -> Column:
        d = ch.cast("int")
        twice = d * 2
        add = F.when(acc["odd"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
        return F.struct((acc["sum"] + add).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), "(?!^)(?!$)"), start, step, lambda a: a["sum"] % 10 == 0)


def mod97(iban: Column) -> Column:
    """True if an IBAN without spaces has remainder 1 after its letters became numbers."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(rem: Column, ch: Column) -> Column:
        return F.when(ch.between("0", "9"), (rem * 10 + (F.ascii(ch) - 48)) % 97).otherwise((rem * 100 + (F.ascii(ch) - 55)) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step, lambda r: r == 1)


def _octets_ok(m: Column) -> Column:
    return F.forall(
        F.split(m, r"\."),
        lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3)
        & (F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(part, F.lit("0"))), 1, 4).try_cast("int"), F.lit(999)) <= 255),
    )


def _confirmed(text: Column) -> Column:
    """array<struct<s,k,e,kind,m>> of confirmed spans of all kinds."""
    email = find_spans(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(find_spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: _octets_ok(x["m"]))

    def card_ok(x: Column) -> Column:
        digits = F.regexp_replace(x["m"], "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)

    def n_digits(x: Column) -> Column:
        return F.length(F.regexp_replace(x["m"], "[^0-9]", ""))

    card = F.filter(find_spans(text, CARD, text.rlike("[0-9][ -]?[0-9]")), card_ok)
    phone = F.filter(find_spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: n_digits(x).between(10, 15))
    iban = F.filter(
        find_spans(text, IBAN, text.rlike("[A-Z]{2}[0-9]{2}")),
        lambda x: mod97(F.replace(x["m"], F.lit(" "), F.lit(""))),
    )
    local = F.filter(find_spans(text, LOCAL, text.rlike("0[0-9]{1,4}[ /.-][0-9]")), lambda x: n_digits(x).between(8, 12))
    return F.concat(*[tag(c, k, i) for i, (k, c) in enumerate(zip(KINDS, (email, ip, card, phone, iban, local)))])


def _points(parts: Column, x: Column) -> Column:
    """Score of a span in hundredths, by the text's pieces."""
    before = cut(parts, F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0)), x["s"])
    near = F.translate(F.concat(before, F.lit("\n"), cut(parts, x["e"], x["e"] + CONTEXT_CHARS)), _UPPER, _LOWER)
    out = F.lit(0)
    for kind, words in CONTEXT.items():
        out = F.when(x["kind"] == kind, F.lit(BASE_SCORE[kind]) + F.when(near.rlike(_whole_words(words)), CONTEXT_GAIN).otherwise(0)).otherwise(out)
    return out


def pii_spans(text: Column) -> Column:
    """array<struct<s,k,e,kind,m,points>> of the spans that count; points are the score in hundredths."""

    def scored(spans: Column) -> Column:
        each = lambda parts: F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"], x["kind"], x["m"], _points(parts, x).alias("points")))
        return F.when(F.size(spans) > 0, let(pieces(text), each)).otherwise(F.array().cast(_SCORED))

    return F.filter(let(_confirmed(text), scored), lambda x: (x["k"] < len(BASE_KINDS)) | (x["points"] >= ADMIT))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``docs`` with ``spans`` array<struct<s,k,e,kind,m,points>> (k orders the kinds)."""
    own = [F.col(c) for c in kept_columns([id_col, *keep], ("spans",))]
    return docs.select(*own, pii_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def mask_pii(docs: DataFrame, text_col: str = "text", min_points: int = 0) -> DataFrame:
    """The same rows and columns with each span that counts, and has ``min_points``, replaced by ``[KIND]``.

    Of overlapping spans the first (by start, then kind) is replaced, and a
    later one that reaches further extends it.  Null texts stay null.
    """
    text, spans = F.col(text_col), fresh(docs, "_spans")
    work = docs.withColumn(spans, F.array_sort(F.filter(pii_spans(text), lambda x: x["points"] >= min_points)))

    def masked(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: x["e"]), lambda a, e: F.greatest(a, e), F.lit(0))

        def told(parts: Column) -> Column:
            def one(x: Column, at: Column) -> Column:
                return F.when(x["s"] >= at, F.concat(cut(parts, at, x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

            last = F.array_max(F.transform(xs, lambda x: x["e"]))
            return F.concat(F.array_join(F.zip_with(xs, ends, one), ""), cut(parts, last, F.length(text)))

        return F.when(F.size(xs) > 0, let(pieces(text), told)).otherwise(text)

    masked = let(F.col(spans), masked)
    return work.withColumn(text_col, masked).drop(spans)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_pii(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["k"] < len(BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"),
        F.array_join(F.transform(F.array_sort("spans"), lambda x: x["points"].cast("string")), ",").alias("points"),
    )


def _duck(kind: str, order: int, pattern: str, ok: str) -> str:
    near = f"""translate(substr(t, greatest(s + 1 - {CONTEXT_CHARS}, 1), least(s, {CONTEXT_CHARS})) || chr(10)
      || substr(t, s + length(m) + 1, {CONTEXT_CHARS}), '{_UPPER}', '{_LOWER}')"""
    points = f"{BASE_SCORE[kind]} + CASE WHEN regexp_matches({near}, '{_whole_words(CONTEXT[kind])}') THEN {CONTEXT_GAIN} ELSE 0 END"
    return f"""
  SELECT doc_id, {order} k, '{kind}' kind, s, s + length(m) e, {points} points FROM (
    SELECT doc_id, t, unnest(ms) m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)))::bigint s
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') ms, string_split_regex(t, '{pattern}') ps FROM d)) WHERE {ok}"""


_LUHN = """length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(
  range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN cast(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS int)
  ELSE (cast(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS int) * 2) // 10
     + (cast(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS int) * 2) % 10 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c:
  CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, b:
  CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1"""

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), a AS (
{_duck('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')}
UNION ALL {_duck('ip', 1, r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', "list_max(list_transform(string_split(m, '.'), lambda p: try_cast(p AS hugeint))) <= 255")}
UNION ALL {_duck('card', 2, r'[0-9](?:[\x20-]?[0-9])+', _LUHN)}
UNION ALL {_duck('phone', 3, r'\+[0-9][\x20().0-9-]+[0-9]', "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15")}
UNION ALL {_duck('iban', 4, r'\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b', _MOD97)}
UNION ALL {_duck('local', 5, LOCAL, "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 12")})
SELECT d.doc_id,
  coalesce(n_email, 0)::bigint n_email, coalesce(n_ip, 0)::bigint n_ip, coalesce(n_card, 0)::bigint n_card, coalesce(n_phone, 0)::bigint n_phone,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(points, '') points
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (k = 0) n_email, count(*) FILTER (k = 1) n_ip, count(*) FILTER (k = 2) n_card,
  count(*) FILTER (k = 3) n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) spans, string_agg(points::varchar, ',' ORDER BY s, k) points
  FROM a WHERE k < 4 OR points >= {ADMIT} GROUP BY 1) USING (doc_id)
"""
