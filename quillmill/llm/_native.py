"""Column helpers shared by the native (JVM-only) text operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int,m:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    own = {c.lower() for c in df.columns}
    while name.lower() in own:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it.

    A plain Python variable would put the whole expression into every lambda
    that uses it, to be evaluated again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of an array that are run through at once, and characters of a piece of text.
RUN, PIECE = 128, 512


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array what ``join`` makes of ``zero`` and all elements before it.

    An array that grows by one element is copied each time, so this is done in runs of
    RUN elements: within each of them, and over what each run makes as a whole.
    """

    def before(xs: Column, start: Column) -> Column:
        grown = F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, F.lit(-1)), x))))
        return F.slice(grown, F.lit(1), F.size(xs))

    def of(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, F.lit(RUN)))
        whole = lambda rs: F.transform(rs, lambda r: F.aggregate(r, zero, join))
        each = lambda rs: F.flatten(F.zip_with(rs, before(whole(rs), zero), before))
        return F.when(F.size(xs) > 0, let(runs, each)).otherwise(F.slice(xs, F.lit(1), F.lit(0)))

    return let(values, of)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points: places in it are then found without walking from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, a: Column, b: Column) -> Column:
    """The code points from a up to b of the text of ``pieces``."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    return F.when(first == last, F.substring(piece(first), a % PIECE + 1, b - a)).otherwise(F.concat(
        F.substring(piece(first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(piece(last), F.lit(1), b % PIECE),
    ))


def kept_columns(keep: Sequence[str], results: Sequence[str]) -> list[str]:
    """keep, each once; a ValueError for names that a result has (in any case, as Spark compares names)."""
    if clash := {k.lower() for k in keep} & set(results):
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    return list(dict.fromkeys(keep))


def find_spans(text: Column, pattern: str, maybe: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array<struct<s,e,m>>.

    Offsets are code points, end exclusive.  Spark has no function for match
    offsets, so the pieces between the matches (``split``) and the matches
    themselves are measured and summed up; texts without a match are not split.
    ``maybe`` is a cheap necessary condition (default: always look).
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if maybe is not None:
        found = F.when(maybe, found)
    none = F.array().cast(SPANS)

    def placed(ms: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(ms)), lambda p: F.length(p))

        def at(gs: Column) -> Column:
            lengths = F.zip_with(gs, ms, lambda g, m: g + F.length(m))
            starts = F.zip_with(running(lengths, lambda a, x: a + x, F.lit(0)), gs, lambda a, g: a + g)
            return F.zip_with(starts, ms, lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))

        return F.when(F.size(ms) > 0, let(gaps, at)).otherwise(none)

    return let(found, placed)


def tag(spans: Column, kind: str, order: int) -> Column:
    """Give each span its kind and the place of that kind in the listing."""
    return F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")
        ),
    )


def render(spans: Column) -> Column:
    """'kind:start:end' by start, then kind as listed, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )
