"""The queries over photos of pages, and the same results in DuckDB SQL.

Pages are drawn from the parts, so an oracle knows where each lies without looking for edges.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import images, page
from quillmill.operators.layouts import CROP_LAYOUT, MIN_HEIGHT, MIN_WIDTH
from quillmill.plans.bill_queries import query
from quillmill.sources import rendered as R

PHOTOS = """ph AS (SELECT p_partkey id, p_partkey % 11 <> 0 page, 2 + p_partkey % 5 x0, 2 + p_partkey % 3 y0, 14 + (p_partkey * 7 + p_size) % 24 w,
  6 + (p_partkey * 3 + p_size) % 28 h, 10 + p_partkey % 20 ground, 200 + p_size light FROM part),
bx AS (SELECT *, page AND h + 1 > 10 AS cropped FROM ph)"""


@query("page_boxes", f"""WITH {PHOTOS} SELECT id AS image_id, CASE WHEN cropped THEN x0 - 1 END::int x, CASE WHEN cropped THEN y0 - 1 END::int y,
CASE WHEN cropped THEN w + 1 END::int w, CASE WHEN cropped THEN h + 1 END::int h, page AS has_contour FROM bx""")
def _(spark, d):
    found = page.page_boxes(R.photos(spark, d))
    return found.select("image_id", "x", "y", "w", "h", F.col("area").isNotNull().alias("has_contour"))


@query("photos_cleaned", f"""WITH {PHOTOS} SELECT id AS image_id, CASE WHEN cropped AND id % 13 <> 0 THEN w + 1 ELSE 48 END::int width, CASE WHEN cropped AND id % 13 <> 0 THEN h + 1 ELSE 40 END::int height,
CASE WHEN id % 13 = 0 THEN 'read: 100 bytes for 48 by 40 pixels' END failed FROM bx""")
def _(spark, d):
    """The whole chain; pictures that can't be read come out as they were."""
    return page.cleaned(R.photos(spark, d, torn=True)).select("image_id", "width", "height", "failed")


@query("sheet_skews", f"""WITH ti AS (SELECT row_number() OVER () - 1 k, u, v FROM (VALUES {", ".join(map(str, R.TILTS))}) t(u, v)),
sp AS (SELECT p_partkey id, u, v, u * u + v * v n, pow(10 + p_size % 4, 2)::bigint a, pow(5 + p_partkey % 4, 2)::bigint b FROM part JOIN ti ON k = p_partkey % {len(R.TILTS)}),
px AS (SELECT id, x, y FROM sp, (SELECT unnest(range(24)) x), (SELECT unnest(range(20)) y)
  WHERE pow((2 * x - 24) * u + (2 * y - 20) * v, 2) <= a * n AND pow((2 * y - 20) * u - (2 * x - 24) * v, 2) <= b * n),
ex AS (SELECT id, unnest([min(x), max(x)]) x, y FROM px GROUP BY id, y),
pt AS (SELECT DISTINCT id, x, y FROM ex),
dr AS (SELECT DISTINCT p.id, (q.x - p.x) // gcd(q.x - p.x, q.y - p.y) dx, (q.y - p.y) // gcd(q.x - p.x, q.y - p.y) dy FROM pt p JOIN pt q ON p.id = q.id AND (p.y < q.y OR p.y = q.y AND p.x < q.x)),
re AS (SELECT dr.id, dx, dy, (max(x * dx + y * dy) - min(x * dx + y * dy)) * (max(y * dx - x * dy) - min(y * dx - x * dy)) / (dx * dx + dy * dy)::double area,
  degrees(atan2(dy, dx)) angle0 FROM dr JOIN pt ON pt.id = dr.id GROUP BY dr.id, dx, dy),
an AS (SELECT *, angle0 + 45 - 90 * floor((angle0 + 45) / 90) - 45 angle FROM re),
le AS (SELECT id, min(area) least FROM an GROUP BY 1)
SELECT an.id AS image_id, round(min(least), 6) area, round(CASE WHEN abs(min(angle)) < 0.5 THEN 0 ELSE min(angle) END, 6) angle
FROM an JOIN le ON an.id = le.id AND area <= least + 1e-9 GROUP BY 1""")
def _(spark, d):
    """The oracle tries the directions between all outermost pixels."""
    return page.skews(R.sheets(spark, d)).select("image_id", F.round("area", 6).alias("area"), F.round("angle", 6).alias("angle"))


#: A photo's gray level at (x, y) of the row b.
_LEVEL = """CASE WHEN b.page AND {y} >= b.y0 AND {y} < b.y0 + b.h AND {x} >= b.x0 AND {x} < b.x0 + b.w THEN
  CASE WHEN b.h >= 12 AND {y} >= b.y0 + b.h // 2 AND {y} < b.y0 + b.h // 2 + 2 AND {x} >= b.x0 + 4 AND {x} < b.x0 + b.w - 4 THEN 60 ELSE b.light END ELSE b.ground END"""
_BETWEEN = "least(greatest(({i} + 0.5::double) * ({n} / {m}::double) - 0.5::double, 0), {n} - 1)"


def _mixed(level: str) -> str:
    """A level between four pixels, first down and then across."""
    at = lambda y, x: level.format(y=y, x=x)
    down = lambda x: f"({at('ya', x)} * (1 - fy) + {at('yb', x)} * fy)"
    return f"floor({down('xa')} * (1 - fx) + {down('xb')} * fx + 0.5)::bigint"


@query("region_pictures", f"""WITH {PHOTOS}, la AS (SELECT region, t::double t, b::double b, l::double l, r::double r FROM (VALUES {", ".join(map(str, CROP_LAYOUT))}) v(region, t, b, l, r)),
cr AS (SELECT region, floor(l * 48 + 0.5)::int sx, floor(t * 40 + 0.5)::int sy, floor((r - l) * 48 + 0.5)::int sw, floor((b - t) * 40 + 0.5)::int sh FROM la),
sc AS (SELECT *, sw < {MIN_WIDTH} OR sh < {MIN_HEIGHT} small, greatest({MIN_WIDTH} / sw::double, {MIN_HEIGHT} / sh::double) k FROM cr),
sz AS (SELECT *, CASE WHEN small THEN greatest({MIN_WIDTH}, floor(sw * k + 0.5)) ELSE sw END::int ow, CASE WHEN small THEN greatest({MIN_HEIGHT}, floor(sh * k + 0.5)) ELSE sh END::int oh FROM sc),
ry AS (SELECT *, unnest(range(oh)) i FROM sz), rx AS (SELECT *, unnest(range(ow)) j FROM ry),
po AS (SELECT *, {_BETWEEN.format(i="i", n="sh", m="oh")} py, {_BETWEEN.format(i="j", n="sw", m="ow")} px FROM rx),
pp AS (SELECT region, ow, oh, i, j, sy + floor(py)::int ya, sy + least(floor(py)::int + 1, sh - 1) yb, py - floor(py) fy, sx + floor(px)::int xa, sx + least(floor(px)::int + 1, sw - 1) xb, px - floor(px) fx FROM po)
SELECT b.id AS image_id, region, ow AS width, oh AS height, sum({_mixed(_LEVEL)})::bigint total, sum({_mixed(_LEVEL)} * (i * 31 + j))::bigint placed
FROM bx b, pp GROUP BY ALL""")
def _(spark, d):
    """Each region's picture, by its size and two sums over its gray levels, one of them by place."""
    import numpy as np
    import pandas as pd

    def sums(batches):
        for pdf in batches:
            out = []
            for i, region, w, h, rgba in pdf.itertuples(index=False):
                v = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)[..., 0].astype(np.int64)
                y, x = np.mgrid[0:h, 0:w]
                out.append((i, region, w, h, int(v.sum()), int((v * (y * 31 + x)).sum())))
            yield pd.DataFrame(out, columns=["image_id", "region", "width", "height", "total", "placed"])

    return page.region_pictures(R.photos(spark, d)).mapInPandas(sums, "image_id long, region string, width int, height int, total long, placed long")


_PATTERN = "((({x}) * p_size + ({y}) * 7 + p_partkey) % 256)"
_RGBA = "sha256(unhex(string_agg(printf('%02x%02x%02xff', r::int, g::int, b::int), '' ORDER BY i, j)))"


def _channels(mixed) -> str:
    v = _PATTERN
    return f"{mixed(v)} r, {mixed(f'({v} // 2)')} g, {mixed(f'(255 - {v})')} b"


@query("image_doubled", f"""WITH g AS (SELECT i, j, {_BETWEEN.format(i="i", n="12", m="24")} py, {_BETWEEN.format(i="j", n="16", m="32")} px FROM (SELECT unnest(range(24)) i), (SELECT unnest(range(32)) j)),
gg AS (SELECT i, j, floor(py)::int ya, least(floor(py)::int + 1, 11) yb, py - floor(py) fy, floor(px)::int xa, least(floor(px)::int + 1, 15) xb, px - floor(px) fx FROM g),
c AS (SELECT p_partkey, i, j, {_channels(_mixed)} FROM part, gg)
SELECT p_partkey AS image_id, 32 AS width, 24 AS height, {_RGBA} AS pixels FROM c GROUP BY 1""")
def _(spark, d):
    return page.resize(R.images(spark, d)).select("image_id", "width", "height", F.sha2("rgba", 256).alias("pixels"))


def _mirrored(i: str, k: int, n: int) -> str:
    return f"(CASE WHEN {i} + {k} < 0 THEN -({i} + {k}) WHEN {i} + {k} > {n - 1} THEN {2 * (n - 1)} - ({i} + {k}) ELSE {i} + {k} END)"


def _smoothed(v: str) -> str:
    taps = [(k, w) for k, w in zip(range(-2, 3), (1, 4, 6, 4, 1))]
    return "floor((" + " + ".join(f"{a * b} * {v.format(x=_mirrored('j', l, 16), y=_mirrored('i', k, 12))}" for k, a in taps for l, b in taps) + ") / 256.0::double + 0.5)"


@query("image_smoothed", f"""WITH c AS (SELECT p_partkey, i, j, {_channels(_smoothed)} FROM part, (SELECT unnest(range(12)) i), (SELECT unnest(range(16)) j))
SELECT p_partkey AS image_id, {_RGBA} AS pixels FROM c GROUP BY 1""")
def _(spark, d):
    return images.apply(R.images(spark, d), images.gaussian).select("image_id", F.sha2("rgba", 256).alias("pixels"))


@query("image_adaptive", f"""WITH t AS (SELECT unnest(range(-5, 6)) a), s AS (SELECT p_partkey, p_size, i, j, sum({_PATTERN.format(x="least(greatest(j + u.a, 0), 15)", y="least(greatest(i + t.a, 0), 11)")}) n
  FROM part, (SELECT unnest(range(12)) i), (SELECT unnest(range(16)) j), t, t u GROUP BY ALL),
c AS (SELECT p_partkey, i, j, CASE WHEN {_PATTERN.format(x="j", y="i")} > n / 121.0::double - 2 THEN 255 ELSE 0 END r, r AS g, r AS b FROM s)
SELECT p_partkey AS image_id, {_RGBA} AS pixels FROM c GROUP BY 1""")
def _(spark, d):
    return images.apply(R.images(spark, d), images.adaptive_threshold()).select("image_id", F.sha2("rgba", 256).alias("pixels"))
