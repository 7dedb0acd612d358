"""URL rules by a sort-merge range join on reversed-host keys.

A host becomes its labels in reverse order, each followed by a dot, so a rule's
host and all its subdomains are one interval of keys.  Points (pages) and
interval starts (rules) are sorted together; a running ``last`` over that order
is the newest interval that began, and the stack of the rules nested around it
(at most one for each prefix of its key) holds every rule that can still be
active, longest first.  A second sweep does the same for the path prefixes of
the active hosts.  Hot hosts are split: pages are salted and the rules, far
fewer, are repeated for each salt.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and gets the default verdict; repeated pages each get a row; equal
rules with different verdicts block; empty tables give empty results or the
default verdict; further columns are ignored unless named in ``keep``,
where names of results are an error; pages without an id are judged like all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm._native import kept_columns, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """'www.example.com' -> 'com.example.www.'"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(points: DataFrame, rules: DataFrame, group: str, key: str, salts: int) -> DataFrame:
    """``points`` with ``_stack``: all rule keys that are a prefix of ``key``, longest first.

    rules: distinct (group, key).  points need a column ``_salt`` below ``salts``.
    """
    spot = rules.select(F.col(group), F.col(key), F.explode(F.sequence(F.lit(0), F.length(key))).alias("_n"))
    spot = spot.withColumn("_outer", F.substring(F.col(key), 1, F.col("_n")))
    outer = rules.select(F.col(group), F.col(key).alias("_outer"))
    stacks = spot.join(outer, [group, "_outer"]).groupBy(group, key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", "_outer")), asc=False), lambda x: x["_outer"]).alias("_nest")
    )
    starts = stacks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_point", F.lit(0))
    both = points.withColumn("_point", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = Window.partitionBy(group, "_salt").orderBy(key, "_point").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_nest", F.last("_nest", ignorenulls=True).over(order)).filter(F.col("_point") == 1)
    active = F.filter("_nest", lambda p: F.startswith(F.col(key), p))
    return swept.withColumn("_stack", F.coalesce(active, F.array().cast("array<string>"))).drop("_nest", "_point")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
    keep: Sequence[str] = (), default: str = DEFAULT, salts: int | None = None,
) -> DataFrame:
    """Rows of ``pages`` as (id, *keep, host, path, rule, verdict).

    rules: (host, path, verdict).  A rule fits its host and all subdomains if the
    page's path starts with the rule's; the longest (host + path) wins.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = kept_columns([id_col, *keep], ("host", "path", "rule", "verdict"))
    ruled = (
        rules.select(F.translate("host", UPPER, LOWER).alias("_rhost"), F.col("path").alias("_rpath"), "verdict")
        .groupBy("_rhost", "_rpath").agg(F.max("verdict").alias("_verdict"))
        .withColumn("_key", host_key(F.col("_rhost")))
    )
    top = F.substring_index("_key", ".", 1)
    points = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*own).alias("_own"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
        F.pmod(F.xxhash64(id_col, url_col), F.lit(salts)).cast("int").alias("_salt"),
    ).withColumn("_key", host_key(F.col("host"))).withColumn("_top", top)
    hosts = _sweep(points, ruled.select("_key").distinct().withColumn("_top", top), "_top", "_key", salts)

    # Each active host (at most one for each label) is a point of the second sweep; so is a page without any.
    paths = hosts.select("_row", "_own", "host", "path", "_salt", F.explode_outer("_stack").alias("_rkey"))
    by_path = _sweep(
        paths, ruled.select(F.col("_key").alias("_rkey"), F.col("_rpath").alias("path")), "_rkey", "path", salts
    ).withColumn("_rpath", F.try_element_at("_stack", F.lit(1)))
    best = by_path.groupBy("_row", "_own", "host", "path").agg(
        F.max(F.when(F.col("_rpath").isNotNull(), F.struct(
            (F.length("_rkey") - 1 + F.length("_rpath")).alias("n"), F.length("_rkey").alias("h"),
            F.col("_rkey").alias("_key"), F.col("_rpath").alias("_rpath"),
        ))).alias("_best")
    )
    judged = best.select("_own", "host", "path", F.col("_best._key").alias("_key"), F.col("_best._rpath").alias("_rpath"))
    return judged.join(ruled, ["_key", "_rpath"], "left").select(
        "_own.*", "host", "path", F.concat("_rhost", "_rpath").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict")
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])
    rules = spark.range(1).select(F.inline(each))
    return judge_urls(table(spark, sf_dir, "pages"), rules)


SQL = f"""
WITH p AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '{SPLIT}', 1), ''), '{UPPER}', '{LOWER}') host, coalesce(regexp_extract(url, '{SPLIT}', 2), '') path FROM pages),
r AS (SELECT list({{'h': h, 'p': q, 'v': v}}) rs FROM (VALUES {', '.join(str(r) for r in RULES)}) t(h, q, v)),
m AS (SELECT p.*, list_reverse_sort(list_transform(list_filter(rs, lambda r: (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)),
  lambda r: {{'n': length(r.h || r.p), 'h': length(r.h), 'rule': r.h || r.p, 'v': r.v}}))[1] b FROM p, r)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.v, '{DEFAULT}') verdict FROM m
"""
