"""Where the regions of a page are: learned from anchors, averaged, and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The static layouts (fractions of the page).
CROP_LAYOUT = (
    ("header", 0.0, 0.18, 0.0, 1.0), ("customer", 0.18, 0.35, 0.0, 0.55), ("billMeta", 0.18, 0.35, 0.52, 1.0),
    ("table", 0.35, 0.75, 0.0, 1.0), ("totals", 0.75, 0.92, 0.0, 1.0),
)
PAGE_LAYOUT = (
    ("header", 0.0, 0.18, None, None), ("customer", 0.18, 0.35, 0.6, 1.0), ("billMeta", 0.18, 0.35, 0.0, 0.6),
    ("table", 0.35, 0.75, None, None), ("totals", 0.75, 0.92, None, None),
)
TRAINED = (
    ("header", 0.0, 0.17, None, None), ("customer", 0.18, 0.16, 0.0, 0.6), ("billMeta", 0.18, 0.16, 0.6, 0.4),
    ("table", 0.36, 0.4, None, None), ("totals", 0.78, 0.14, None, None),
)
MIN_WIDTH, MIN_HEIGHT = 40, 24
LAYOUT = "region string, y double, h double, x double, w double"
DEFAULTS = {"customer": 0.18, "total": 0.75, "netTotal": 0.88}


def anchors(words: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, anchor, x, y): the last word that marks each anchor, the first for the bill number."""
    # Only words that can mark an anchor are turned into capitals and grouped; long s and its ligatures have the capital S.
    words = words.filter(F.col("text").rlike("[Nn][EeOo]|[Tt][Oo]|[Gg][Ss\u017f\ufb05\ufb06]"))
    words = words.select(id_col, "word_ix", "x0", "y0", F.upper(F.trim("text")).alias("_t"))
    t = F.col("_t")
    has = lambda w: F.contains(t, F.lit(w))
    rules = {
        "company": has("NEW") & (has("GOOD") | has("NITS")), "gstin": t == "GSTIN", "customer": t == "TO",
        "total": has("TOTAL") & ~has("NET"), "netTotal": has("NET") & has("TOTAL"), "billNo": t == "NO",
    }
    spot = F.struct("x0", "y0")
    last = [F.max_by(F.when(rule, spot), F.when(rule, F.col("word_ix"))).alias(n) for n, rule in rules.items() if n != "billNo"]
    first = F.min_by(F.when(rules["billNo"], spot), F.when(rules["billNo"], F.col("word_ix"))).alias("billNo")
    wide = words.groupBy(id_col).agg(*last, first)
    each = F.array(*[F.struct(F.lit(n).alias("anchor"), F.col(n).alias("p")) for n in rules])
    long = wide.select(id_col, F.explode(F.filter(each, lambda x: x["p"].isNotNull())).alias("a"))
    return long.select(id_col, "a.anchor", F.col("a.p.x0").alias("x"), F.col("a.p.y0").alias("y"))


def layouts_of(found: DataFrame, heights: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, region, y, h, x, w) from anchors and (id, height); missing anchors have their default places."""
    at = found.groupBy(id_col).agg(*[F.max(F.when(F.col("anchor") == n, F.col("y"))).alias(n) for n in ("customer", "total")])
    at = heights.join(at, id_col, "left")
    c = F.coalesce(F.col("customer") / F.col("height"), F.lit(DEFAULTS["customer"]))
    t = F.coalesce(F.col("total") / F.col("height"), F.lit(DEFAULTS["total"]))
    none = F.lit(None).cast("double")

    def region(name: str, y: Column, h: Column, x: Column = none, w: Column = none) -> Column:
        return F.struct(F.lit(name).alias("region"), y.alias("y"), h.alias("h"), x.alias("x"), w.alias("w"))

    all_ = F.array(
        region("header", F.lit(0.0), c), region("customer", c, F.lit(0.18), F.lit(0.0), F.lit(0.6)),
        region("billMeta", c, F.lit(0.18), F.lit(0.6), F.lit(0.4)), region("table", c + 0.18, F.greatest(F.lit(0.35), (t - 0.05) - (c + 0.18))),
        region("totals", F.greatest(F.lit(0.7), t - 0.05), F.least(F.lit(0.2), 1 - (t - 0.05))),
    )
    return at.select(id_col, F.explode(all_).alias("r")).select(id_col, "r.*")


def average(layouts: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(region, y, h, x, w): means over all samples; x and w too are divided by all of them."""
    n = F.count_distinct(id_col)
    return layouts.groupBy("region").agg(*[(F.sum(c) / n).alias(c) for c in ("y", "h", "x", "w")])


def train(words: DataFrame, heights: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(region, y, h, x, w): the layout of a template, from the words of its sample pages and (id, height)."""
    return average(layouts_of(anchors(words, id_col), heights, id_col), id_col)


#: Regions of a layout, at most; a page has a handful.
MOST_REGIONS = 64


def _regions(layout: DataFrame) -> Column:
    """The rows of a layout as an array literal, by which pages are unfolded instead of joined."""
    rows = layout.limit(MOST_REGIONS + 1).collect()
    if len(rows) > MOST_REGIONS:
        raise ValueError(f"a layout of more than {MOST_REGIONS} regions")
    kind = f"array<{layout.schema.simpleString()}>"
    return F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in layout.schema]) for r in rows]).cast(kind)


def _unfolded(pages: DataFrame, layout: DataFrame) -> DataFrame:
    """Each page with each region; the layout's columns are in ``_r``."""
    return pages.select("*", F.explode(_regions(layout)).alias("_r"))


def layout_for(templates: DataFrame, trained: DataFrame, default: DataFrame) -> DataFrame:
    """(template, region, y, h, x, w): the trained layout of each template, else the default one."""
    known = trained.select("template").distinct().withColumn("_k", F.lit(True))
    marked = templates.join(known, "template", "left")
    own = marked.filter("_k").drop("_k").join(trained, "template")
    other = _unfolded(marked.filter("_k IS NULL").drop("_k"), default)
    return own.unionByName(other.select(*templates.columns, "_r.*"))


def crop_boxes(pages: DataFrame, layout: DataFrame) -> DataFrame:
    """(…, region, sx, sy, sw, sh, out_w, out_h) in whole pixels for each page of (width, height) and each region.

    layout: (region, top, bottom, left, right), one row for each region.  Boxes under
    the least size are scaled up; empty ones are left out.
    """
    r = lambda c: F.floor(c + 0.5).cast("int")
    at = lambda c: F.col(f"_r.{c}")
    out = _unfolded(pages, layout).select(
        *pages.columns, at("region"), r(at("left") * F.col("width")).alias("sx"), r(at("top") * F.col("height")).alias("sy"),
        r((at("right") - at("left")) * F.col("width")).alias("sw"), r((at("bottom") - at("top")) * F.col("height")).alias("sh"),
    ).filter("sw > 0 AND sh > 0")
    small = (F.col("sw") < MIN_WIDTH) | (F.col("sh") < MIN_HEIGHT)
    scale = F.greatest(MIN_WIDTH / F.col("sw"), MIN_HEIGHT / F.col("sh"))
    grown = lambda c, least: F.when(small, F.greatest(F.lit(least), r(F.col(c) * scale))).otherwise(F.col(c))
    return out.withColumn("out_w", grown("sw", MIN_WIDTH)).withColumn("out_h", grown("sh", MIN_HEIGHT))


def _whole(size: Column) -> Column:
    """A size in whole pixels, one at least."""
    return F.greatest(F.lit(1), F.floor(size + 0.5).cast("int"))


def crop_plain(pages: DataFrame, layout: DataFrame) -> DataFrame:
    """(…, region, sx, sy, sw, sh, out_w, out_h): boxes in fractions of a pixel; without left and right, the full width.

    layout: (region, top, bottom, left, right), one row for each region.
    """
    at = lambda c: F.col(f"_r.{c}")
    x, y = F.coalesce(at("left") * F.col("width"), F.lit(0.0)), at("top") * F.col("height")
    w = F.coalesce(at("right") * F.col("width"), F.col("width").cast("double")) - x
    h = at("bottom") * F.col("height") - y
    return _unfolded(pages, layout).select(*pages.columns, at("region"), x.alias("sx"), y.alias("sy"), w.alias("sw"), h.alias("sh"), _whole(w).alias("out_w"), _whole(h).alias("out_h"))


def crop_trained(pages: DataFrame, layout: DataFrame) -> DataFrame:
    """(…, region, sx, sy, sw, sh, out_w, out_h) by a layout as training makes it; without x and w, the full width.

    layout: (region, y, h, x, w), one row for each region.
    """
    w = F.when(F.col("_r.w").isNull(), F.col("width").cast("int")).otherwise(_whole(F.col("_r.w") * F.col("width")))
    h = _whole(F.coalesce("_r.h", F.lit(0.0)) * F.col("height"))
    return _unfolded(pages, layout.select("region", "y", "h", "x", "w")).select(
        *pages.columns, F.col("_r.region"), F.coalesce(F.col("_r.x") * F.col("width"), F.lit(0.0)).alias("sx"),
        (F.coalesce("_r.y", F.lit(0.0)) * F.col("height")).alias("sy"), w.alias("sw"), h.alias("sh"), w.alias("out_w"), h.alias("out_h"),
    )


def route_words(words: DataFrame, pages: DataFrame, layout: DataFrame, id_col: str = "bill_id") -> DataFrame:
    """(id, region, word_ix, text): the region that holds each word's middle."""
    placed = words.join(pages, id_col)
    x, y = (F.col("x0") + F.col("x1")) / 2 / F.col("width"), (F.col("y0") + F.col("y1")) / 2 / F.col("height")
    inside = F.filter(_regions(layout), lambda r: (y >= r["top"]) & (y < r["bottom"]) & (x >= r["left"]) & (x < r["right"]))
    return placed.select(id_col, F.explode(inside).alias("_r"), "word_ix", "text").select(id_col, "_r.region", "word_ix", "text")
