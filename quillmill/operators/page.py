"""The page in a photo: its outline, cropping to it, turning it straight, and the pictures of its regions.

Steps take and give pixels (height, width, 4) of one picture, so memory is bounded
by the largest.  ``cleaned`` chains them over a table; a picture that a step fails
on comes out as it came in, with the step and the reason in ``failed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators import images as I
from quillmill.operators.layouts import CROP_LAYOUT, MIN_HEIGHT, MIN_WIDTH

# Edge thresholds, the least size of a crop, the least angle that is turned.
EDGE_LOW, EDGE_HIGH = 50, 150
LEAST_CROP = 10
LEAST_ANGLE = 0.5
#: Sharpness of the cubic curve between pixels.
CUBIC = -0.75


def luma(p: np.ndarray) -> np.ndarray:
    """Gray levels in whole numbers."""
    r, g, b = (p[..., k].astype(np.int64) for k in range(3))
    return (4899 * r + 9617 * g + 1868 * b + 8192) >> 14


# ---- connected pixels
def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of n things that each is connected with by the pairs (a, b)."""
    top = np.arange(n)
    while True:
        now = top.copy()
        np.minimum.at(now, a, top[b])
        np.minimum.at(now, b, top[a])
        now = now[now]
        if (now == top).all():
            return top
        top = now


def labels(mask: np.ndarray) -> np.ndarray:
    """Of each pixel of mask the number of its component, of neighbours on all eight sides, from 1 in the order of their first pixels; else 0.

    Pixels of a row are taken together as runs; runs of neighbouring rows that touch are joined.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # exclusive
    out = np.zeros(mask.shape, np.int64)
    if not len(row):
        return out
    wide = w + 2
    # Runs of the row above that begin up to this run's end and end from its start on.
    low = np.searchsorted(row * wide + end, (row - 1) * wide + start)
    high = np.searchsorted(row * wide + start, (row - 1) * wide + end, side="right")
    n = np.maximum(high - low, 0)
    mine = np.repeat(np.arange(len(row)), n)
    above = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    top = joined(mine, above, len(row))
    number = np.cumsum(top == np.arange(len(row)))[top]
    out[mask] = np.repeat(number, end - start)
    return out


def border(mask: np.ndarray) -> np.ndarray:
    """(x, y) of the outer border of the one component of mask, pixel by pixel, from its first pixel around."""
    m = np.pad(mask, 1)
    y, x = divmod(int(np.argmax(m)), m.shape[1])
    around = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))  # to the right, then clockwise
    first, points, way = (x, y), [(x, y)], 7
    begun: tuple | None = None
    while True:
        for k in range(8):
            turn = (way + k) % 8
            dx, dy = around[turn]
            if m[y + dy, x + dx]:
                break
        else:
            break  # one pixel
        step = (x, y, turn)
        if step == begun:
            break
        begun = begun or step
        x, y = x + dx, y + dy
        points.append((x, y))
        way = (turn + 6) % 8 if turn % 2 == 0 else (turn + 5) % 8  # what was seen to be empty last
    if len(points) > 1 and points[-1] == first:
        points.pop()
    return np.array(points) - 1


def area_of(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(np.int64), points[:, 1].astype(np.int64)
    return abs(int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def largest_contour(mask: np.ndarray) -> tuple[float, np.ndarray] | None:
    """(area, border) of the component whose border holds the largest area; of equals the one that begins last.  None if all are lines.

    Boxes bound areas, so few borders are followed.
    """
    own = labels(mask)
    y, x = np.nonzero(own)
    at = own[y, x] - 1
    n = int(own.max())
    box = [np.full(n, v) for v in (mask.shape[1], mask.shape[0], -1, -1)]
    for side, take, v in zip(box, (np.minimum, np.minimum, np.maximum, np.maximum), (x, y, x, y)):
        take.at(side, at, v)
    most = (box[2] - box[0]) * (box[3] - box[1])
    best: tuple[float, int, np.ndarray] | None = None
    for k in np.lexsort((-np.arange(n), -most)):
        if most[k] == 0 or best and most[k] < best[0]:
            break
        part = own[box[1][k] : box[3][k] + 1, box[0][k] : box[2][k] + 1] == k + 1
        points = border(part) + (box[0][k], box[1][k])
        found = area_of(points)
        if found > 0 and (best is None or (found, k) > best[:2]):
            best = (found, int(k), points)
    return (best[0], best[2]) if best else None


# ---- edges and the crop
def edges(p: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Canny's edges: gradients, thinned across their direction, kept where they hang together with a strong one."""
    g = np.pad(luma(p), 1, mode="edge")
    up, mid, down = g[:-2], g[1:-1], g[2:]
    smooth = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    dy = smooth[2:] - smooth[:-2]
    dx = (up + 2 * mid + down)[:, 2:] - (up + 2 * mid + down)[:, :-2]
    size = np.abs(dx) + np.abs(dy)
    around = np.pad(size, 1)

    def at(v: int, u: int) -> np.ndarray:
        return around[1 + v : 1 + v + size.shape[0], 1 + u : 1 + u + size.shape[1]]

    ax, ay = np.abs(dx), np.abs(dy) << 15
    flat = ax * 13573  # the tangent of 22.5 degrees in 1/32768
    level, steep = ay < flat, ay > flat + (ax << 16)
    across = (size > at(0, -1)) & (size >= at(0, 1))
    along = (size > at(-1, 0)) & (size >= at(1, 0))
    falling = (size > at(-1, -1)) & (size > at(1, 1))
    rising = (size > at(-1, 1)) & (size > at(1, -1))
    thin = np.where(level, across, np.where(steep, along, np.where((dx ^ dy) < 0, rising, falling)))
    weak = thin & (size > low)
    own = labels(weak)
    strong = np.zeros(own.max() + 1, bool)
    strong[own[weak & (size > high)]] = True
    strong[0] = False
    return strong[own]


def page_box(p: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) around the largest contour of the edges; None without one, or if it is small."""
    return box_of(largest_contour(edges(p)) if min(p.shape[:2]) else None)


def box_of(found: tuple[float, np.ndarray] | None) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) around a largest contour; None without one, or if it is small."""
    if found is None:
        return None
    (x, y), (u, v) = found[1].min(0), found[1].max(0)
    w, h = int(u - x) + 1, int(v - y) + 1
    return (int(x), int(y), w, h) if w > LEAST_CROP and h > LEAST_CROP else None


def crop_to_page(p: np.ndarray) -> np.ndarray:
    box = page_box(p)
    if box is None:
        return p
    x, y, w, h = box
    return p[y : y + h, x : x + w].copy()


# ---- straightening
def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y), in order."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def side(ps: np.ndarray) -> list:
        out: list = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    some = points.tolist()
    return np.array(side(some)[:-1] + side(some[::-1])[:-1])


def least_rectangle(points: np.ndarray) -> tuple[float, float]:
    """(area, angle) of the smallest rectangle around points: one of its sides lies on a side of the hull.

    The angle is that of a side against the x axis, y pointing down, from -45 up to 45
    degrees; of equal rectangles the one of the least angle counts.
    """
    corners = hull(points).astype(float)
    if len(corners) < 2:
        return 0.0, 0.0
    way = np.roll(corners, -1, 0) - corners
    way = way[: 1 if len(corners) == 2 else None]
    unit = way / np.hypot(way[:, 0], way[:, 1])[:, None]
    along, across = corners @ unit.T, corners @ np.stack([-unit[:, 1], unit[:, 0]])
    area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    angle = (np.degrees(np.arctan2(unit[:, 1], unit[:, 0])) + 45) % 90 - 45
    near = np.flatnonzero(area <= area.min() * (1 + 1e-12) + 1e-12)
    k = near[np.argmin(angle[near])]
    return float(area[k]), float(angle[k])


def skew(p: np.ndarray, quarter_turns: bool = False) -> float:
    """Degrees by which what isn't black is turned clockwise; 0 under LEAST_ANGLE, and without such pixels.

    quarter_turns: angles over 0 up to 90, as some versions of the image library give
    them; an upright page is then one of 90 degrees.
    """
    g = luma(p) != 0
    rows = np.flatnonzero(g.any(1))
    if not len(rows):
        return 0.0
    first, last = g[rows].argmax(1), g.shape[1] - 1 - g[rows][:, ::-1].argmax(1)  # no other pixel is at a corner
    _, angle = least_rectangle(np.concatenate([np.stack([first, rows], 1), np.stack([last, rows], 1)]))
    if quarter_turns and angle <= 0:
        angle += 90
    return angle if abs(angle) >= LEAST_ANGLE else 0.0


def turned(p: np.ndarray, angle: float) -> np.ndarray:
    """The picture turned counterclockwise around its middle, of the same size; between pixels by cubic curves, beyond the border its last pixels."""
    h, w = p.shape[:2]
    a = np.radians(angle)
    x, y = np.meshgrid(np.arange(w) - w / 2, np.arange(h) - h / 2)
    sx, sy = np.cos(a) * x - np.sin(a) * y + w / 2, np.sin(a) * x + np.cos(a) * y + h / 2
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)

    def weights(t: np.ndarray) -> list[np.ndarray]:
        far = lambda d: ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
        close = lambda d: ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
        return [far(t + 1), close(t), close(1 - t), far(2 - t)]

    wx, wy = weights(sx - x0), weights(sy - y0)
    out = np.zeros(p.shape)
    for j in range(4):
        yy = np.clip(y0 + j - 1, 0, h - 1)
        line = sum(p[yy, np.clip(x0 + i - 1, 0, w - 1)] * wx[i][..., None] for i in range(4))
        out += line * wy[j][..., None]
    return I._bytes(out)


def straighten(p: np.ndarray, quarter_turns: bool = False) -> np.ndarray:
    angle = skew(p, quarter_turns)
    return turned(p, angle) if angle else p


# ---- sizes and regions
def resized(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture in another size, weighted between the pixels on each side, first down and then across."""

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
        low = np.floor(s).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), s - low

    if (height, width) == p.shape[:2]:
        return p
    a, b, f = places(p.shape[0], height)
    x = p[a] * (1 - f)[:, None, None] + p[b] * f[:, None, None]
    a, b, f = places(p.shape[1], width)
    return I._bytes(x[:, a] * (1 - f)[:, None] + x[:, b] * f[:, None])


def doubled(p: np.ndarray) -> np.ndarray:
    return resized(p, 2 * p.shape[1], 2 * p.shape[0])


def regions_of(p: np.ndarray, layout: Sequence[tuple] = CROP_LAYOUT) -> list[tuple[str, np.ndarray]]:
    """(region, pixels) of each region (name, top, bottom, left, right) of a page; small ones in the least size, empty ones left out."""
    h, w = p.shape[:2]
    whole = lambda v: int(np.floor(v + 0.5))
    out = []
    for name, top, bottom, left, right in layout:
        sx, sy, sw, sh = whole(left * w), whole(top * h), whole((right - left) * w), whole((bottom - top) * h)
        part = p[sy : sy + sh, sx : sx + sw]
        if sw <= 0 or sh <= 0 or not part.size:
            continue
        if sw < MIN_WIDTH or sh < MIN_HEIGHT:
            scale = max(MIN_WIDTH / sw, MIN_HEIGHT / sh)
            part = resized(part, max(MIN_WIDTH, whole(sw * scale)), max(MIN_HEIGHT, whole(sh * scale)))
        out.append((name, part))
    return out


# ---- tables of pictures
Step = Callable[[np.ndarray], np.ndarray]
#: The steps of a photo of a page, in order.
STEPS: tuple[tuple[str, Step], ...] = (
    ("crop", crop_to_page), ("straighten", straighten), ("smooth", I.gaussian),
    ("threshold", lambda p: I.adaptive_threshold(gaussian=True)(np.concatenate([np.repeat(luma(p)[..., None], 3, 2), p[..., 3:]], 2).astype(np.uint8))),
)
CLEANED = "image_id long, width int, height int, rgba binary, failed string"


def _pixels(rgba: bytes | None, width: int | None, height: int | None) -> np.ndarray:
    if rgba is None or pd.isna(width) or pd.isna(height):
        raise ValueError("no picture")
    if width < 1 or height < 1 or len(rgba) != 4 * width * height:
        raise ValueError(f"{len(rgba)} bytes for {int(width)} by {int(height)} pixels")
    return np.frombuffer(rgba, np.uint8).reshape(int(height), int(width), 4).copy()


#: What a task holds of results before it hands them on: rows, and bytes of pictures.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def _each(images: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` of each row (id, width, height, rgba): the rows it makes, handed on together up to BATCH_BYTES."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, size = [], 0
        for pdf in batches:
            for row in pdf[["image_id", "width", "height", "rgba"]].itertuples(index=False):
                own = run(*row)
                made += own
                size += sum(len(v) for r in own for v in r if isinstance(v, bytes))
                if len(made) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pd.DataFrame(made, columns=names, dtype=object)
                    made, size = [], 0
        if made:
            yield pd.DataFrame(made, columns=names, dtype=object)

    return images.select("image_id", "width", "height", "rgba").mapInPandas(task, schema)


def cleaned(images: DataFrame, steps: Sequence[tuple[str, Step]] = STEPS) -> DataFrame:
    """The pictures after the steps, and ``failed``: null, or the step and the reason, and then the picture is as it was."""

    def run(i: int, width: int, height: int, rgba: bytes) -> list[tuple]:
        at = "read"
        try:
            p = _pixels(rgba, width, height)
            for at, step in steps:
                p = step(p)
            return [(i, p.shape[1], p.shape[0], p.tobytes(), None)]
        except Exception as e:  # whatever is wrong with one picture must not end the task of the others
            return [(i, *(None if pd.isna(v) else int(v) for v in (width, height)), rgba, f"{at}: {e}")]

    return _each(images, run, CLEANED)


BOXES = "image_id long, area double, x int, y int, w int, h int, failed string"


def page_boxes(images: DataFrame) -> DataFrame:
    """(image_id, area, x, y, w, h, failed): the largest contour and the box that a crop takes; null without one."""

    def run(i: int, width: int, height: int, rgba: bytes) -> list[tuple]:
        try:
            p = _pixels(rgba, width, height)
            found = largest_contour(edges(p))
            return [(i, found[0] if found else None, *(box_of(found) or (None,) * 4), None)]
        except Exception as e:
            return [(i, *[None] * 5, f"read: {e}")]

    return _each(images, run, BOXES)


SKEWS = "image_id long, area double, angle double"


def skews(images: DataFrame) -> DataFrame:
    """(image_id, area of the least rectangle around what isn't black, angle by which it is turned)."""

    def run(i: int, width: int, height: int, rgba: bytes) -> list[tuple]:
        p = _pixels(rgba, width, height)
        y, x = np.nonzero(luma(p))
        return [(i, least_rectangle(np.stack([x, y], 1))[0] if len(x) else 0.0, skew(p))]

    return _each(images, run, SKEWS)


REGIONS = "image_id long, region string, width int, height int, rgba binary"


def region_pictures(images: DataFrame, layout: Sequence[tuple] = CROP_LAYOUT) -> DataFrame:
    """(image_id, region, width, height, rgba): a picture of each region of each page."""

    def run(i: int, width: int, height: int, rgba: bytes) -> list[tuple]:
        return [(i, name, p.shape[1], p.shape[0], p.tobytes()) for name, p in regions_of(_pixels(rgba, width, height), layout)]

    return _each(images.filter(F.col("rgba").isNotNull()), run, REGIONS)


def resize(images: DataFrame, times: int = 2) -> DataFrame:
    """The pictures ``times`` as wide and high."""
    return I.apply(images, partial(_times, times))


def _times(times: int, p: np.ndarray) -> np.ndarray:
    return resized(p, times * p.shape[1], times * p.shape[0])
