"""Contours, crops, angles and sizes against plain Python."""

import math

import numpy as np
import pytest

from quillmill.operators import images as I
from quillmill.operators import page as P


def gray(v):
    v = np.asarray(v, np.uint8)
    return np.dstack([v, v, v, np.full_like(v, 255)])


def flooded(mask):
    """Component numbers by flooding from each first pixel."""
    out = np.zeros(mask.shape, int)
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            todo, n = [(y, x)], out.max() + 1
            out[y, x] = n
            while todo:
                a, b = todo.pop()
                for u in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for v in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[u, v] and not out[u, v]:
                            out[u, v] = n
                            todo.append((u, v))
    return out


def area_by_cells(part):
    """The area within a component's outer border: holes filled, then whole and half cells of four pixels."""
    m = np.pad(part, 1)
    seen, todo = np.zeros(m.shape, bool), [(0, 0)]
    seen[0, 0] = True
    while todo:
        y, x = todo.pop()
        for u, v in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= u < m.shape[0] and 0 <= v < m.shape[1] and not m[u, v] and not seen[u, v]:
                seen[u, v] = True
                todo.append((u, v))
    m = (~seen).astype(int)
    n = m[:-1, :-1] + m[1:, :-1] + m[:-1, 1:] + m[1:, 1:]
    return (n == 4).sum() + (n == 3).sum() / 2


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.7, 0.95])
def test_components_and_contours_equal_flooding(share):
    rng = np.random.default_rng(int(share * 100))
    for _ in range(40):
        mask = rng.random(rng.integers(1, 14, 2)) < share
        own = flooded(mask)
        assert (P.labels(mask) == own).all()
        areas = []
        for k in range(1, own.max() + 1):
            part = own == k
            points = P.border(part)
            areas.append(area_by_cells(part))
            assert P.area_of(points) == areas[-1]
            (x, y), (u, v) = points.min(0), points.max(0)
            ys, xs = np.nonzero(part)
            assert (x, y, u, v) == (xs.min(), ys.min(), xs.max(), ys.max())
            assert all(part[b, a] for a, b in points)
        found = P.largest_contour(mask)
        if not areas or max(areas) == 0:
            assert found is None
        else:
            last = max(k for k, a in enumerate(areas) if a == max(areas)) + 1
            assert found[0] == max(areas) and own[found[1][0][1], found[1][0][0]] == last


def plain_edges(g, low=50, high=150):
    """The same edges, pixel by pixel."""
    h, w = len(g), len(g[0])
    px = lambda y, x: g[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    dx = [[sum(k * (px(y + j, x + 1) - px(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)]
    dy = [[sum(k * (px(y + 1, x + j) - px(y - 1, x + j)) for j, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)]
    size = lambda y, x: abs(dx[y][x]) + abs(dy[y][x]) if 0 <= y < h and 0 <= x < w else 0
    weak, strong = set(), []
    for y in range(h):
        for x in range(w):
            s, slope = size(y, x), math.degrees(math.atan2(abs(dy[y][x]), abs(dx[y][x])))
            if s <= low:
                continue
            if slope < 22.5:
                top = s > size(y, x - 1) and s >= size(y, x + 1)
            elif slope > 67.5:
                top = s > size(y - 1, x) and s >= size(y + 1, x)
            else:
                k = -1 if dx[y][x] * dy[y][x] < 0 else 1
                top = s > size(y - 1, x - k) and s > size(y + 1, x + k)
            if top:
                weak.add((y, x))
                if s > high:
                    strong.append((y, x))
    kept, todo = set(strong), list(strong)
    while todo:
        y, x = todo.pop()
        for n in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if n in weak and n not in kept:
                kept.add(n)
                todo.append(n)
    return [[(y, x) in kept for x in range(w)] for y in range(h)]


@pytest.mark.parametrize("seed", range(6))
def test_edges_equal_a_plain_model(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 256, (14, 17)) if seed % 2 else np.clip(np.add.outer(rng.integers(-9, 9, 14).cumsum() * 3, rng.integers(-9, 9, 17).cumsum() * 5) + 128, 0, 255)
    p = gray(v)
    assert P.edges(p).tolist() == plain_edges(P.luma(p).tolist())


def sheet(h, w, box, page=230, ground=20):
    v = np.full((h, w), ground)
    x, y, bw, bh = box
    v[y : y + bh, x : x + bw] = page
    v[y + bh // 3 : y + bh // 3 + 2, x + 4 : x + bw - 4] = 40  # a line of text
    return gray(v)


def test_crop_takes_the_page_and_leaves_what_has_none():
    for box in ((5, 4, 40, 30), (12, 9, 21, 25), (1, 1, 50, 38)):
        x, y, w, h = box
        p = sheet(44, 56, box)
        assert P.page_box(p) == (x - 1, y - 1, w + 1, h + 1)
        assert P.crop_to_page(p).shape == (h + 1, w + 1, 4)
    for p in (gray(np.full((20, 30), 90)), sheet(44, 56, (5, 4, 9, 9)), gray(np.zeros((1, 1))), gray(np.add.outer(np.zeros(20), np.arange(30) * 200 // 15 % 256 > 100) * 255)):
        assert P.page_box(p) is None and P.crop_to_page(p) is p


@pytest.mark.parametrize("angle", [-44, -30, -12.5, -3, -0.7, 0, 0.3, 0.7, 3, 12.5, 30, 44])
def test_planted_angles_are_found_and_undone(angle):
    y, x = np.mgrid[0:900, 0:900] - 450.0
    a = math.radians(angle)
    inside = (np.abs(x * math.cos(a) + y * math.sin(a)) < 330) & (np.abs(-x * math.sin(a) + y * math.cos(a)) < 220)
    p = gray(inside * 200)
    found = P.skew(p)
    assert found == 0 if abs(angle) < 0.5 else abs(found - angle) < 0.1
    straight = P.straighten(p)
    rows = (straight[..., 0] > 100).sum(1)
    assert abs(rows.max() - 660) < 6 and abs((rows > 330).sum() - 440) < 8
    if abs(angle) < 0.5:
        assert straight is p
        assert P.skew(p, quarter_turns=True) == (90.0 if angle == 0 else 0.0)


def test_least_rectangle_equals_trying_all_angles():
    rng = np.random.default_rng(8)
    for _ in range(25):
        points = rng.integers(0, 30, (rng.integers(1, 20), 2))
        area, angle = P.least_rectangle(points)
        best = min(
            np.ptp(points @ (math.cos(t), math.sin(t))) * np.ptp(points @ (-math.sin(t), math.cos(t))) for t in np.radians(np.arange(-45, 45, 0.05))
        )
        assert area <= best + 1e-9 and best <= area + 0.2 * math.sqrt(area + 1) + 1
        assert -45 <= angle < 45
        if len(points) > 2:
            t = math.radians(angle)
            assert abs(np.ptp(points @ (math.cos(t), math.sin(t))) * np.ptp(points @ (-math.sin(t), math.cos(t))) - area) < 1e-6


def test_turning_by_quarters_and_back():
    p = np.random.default_rng(1).integers(0, 256, (21, 21, 4)).astype(np.uint8)
    q = P.turned(p, 90)
    assert (q[1:, 1:] == np.rot90(p, 1)[:-1, 1:]).all() or (q[1:, :] == np.rot90(p, 1)[:-1, :]).all()
    assert (P.turned(p, 0) == p).all()


def test_sizes():
    p = np.random.default_rng(2).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    q = P.doubled(p)
    assert q.shape == (10, 14, 4) and (P.resized(p, 7, 5) == p).all()
    assert (q[0, 0] == p[0, 0]).all() and (q[-1, -1] == p[-1, -1]).all()
    n = p.astype(int)
    mixed = (9 * n[1, 1] + 3 * n[1, 2] + 3 * n[2, 1] + n[2, 2]) / 16
    assert (q[3, 3] == np.floor(mixed + 0.5)).all()
    flat = np.full((3, 4, 4), 77, np.uint8)
    assert (P.resized(flat, 9, 2) == 77).all()


def test_regions_have_their_boxes_and_least_sizes():
    p = np.random.default_rng(3).integers(0, 256, (200, 300, 4)).astype(np.uint8)
    own = dict(P.regions_of(p))
    assert own["customer"].shape == (34, 165, 4) and (own["customer"] == p[36:70, 0:165]).all()
    small = dict(P.regions_of(p[:30, :40]))
    assert all(r.shape[0] >= 24 and r.shape[1] >= 40 for r in small.values()) and len(small) == 5
    assert P.regions_of(p[:1, :1]) == [] or all(r.shape[1] >= 40 for _, r in P.regions_of(p[:1, :1]))


def test_a_picture_that_fails_leaves_the_others_alone(spark):
    good = sheet(44, 56, (5, 4, 40, 30))
    rows = [(1, 56, 44, bytearray(good.tobytes())), (2, 56, 44, bytearray(b"torn")), (3, 56, 44, None), (4, None, 44, bytearray(b"x")), (5, 0, 0, bytearray()), (6, 1, 1, bytearray(b"\0\0\0\0")), (None, 56, 44, bytearray(good.tobytes()))]
    df = spark.createDataFrame(rows, I.SCHEMA)
    got = {r["image_id"]: r for r in P.cleaned(df).collect()}
    assert len(got) == 7
    want = good
    for _, step in P.STEPS:
        want = step(want.copy())
    assert bytes(got[1]["rgba"]) == bytes(got[None]["rgba"]) == want.tobytes() and (got[1]["width"], got[1]["height"], got[1]["failed"]) == (41, 31, None)
    assert set(np.unique(want[..., 0])) <= {0, 255}
    assert bytes(got[2]["rgba"]) == b"torn" and got[2]["failed"] == "read: 4 bytes for 56 by 44 pixels"
    assert got[3]["rgba"] is None and got[3]["failed"] == got[4]["failed"] == "read: no picture" and got[5]["failed"].startswith("read") and got[6]["failed"] is None

    def broken(p):
        raise ZeroDivisionError("a step")

    torn = {r["image_id"]: r for r in P.cleaned(df, [("crop", P.crop_to_page), ("odd", broken)]).collect()}
    assert bytes(torn[1]["rgba"]) == good.tobytes() and torn[1]["failed"] == "odd: a step"
    boxes = {r["image_id"]: r for r in P.page_boxes(df).collect()}
    assert tuple(boxes[1][c] for c in "xywh") == (4, 3, 41, 31) and boxes[6]["x"] is None and boxes[2]["failed"]
    assert P.cleaned(df.limit(0)).count() == 0 and P.region_pictures(df.filter("image_id = 1")).count() == 5


def test_pictures_are_dealt_over_all_cores(spark, sf_dir):
    """A file of a few parts is one task by its bytes, though each picture takes milliseconds."""
    from quillmill.sources import rendered as R

    least = 4 * spark.sparkContext.defaultParallelism
    for pictures in (R.photos(spark, sf_dir), R.sheets(spark, sf_dir), R.images(spark, sf_dir)):
        assert pictures.rdd.getNumPartitions() >= least


def test_results_of_small_pictures_leave_a_task_together(spark):
    p = np.full((4, 4, 4), 255, np.uint8)
    rows = [(i, 4, 4, bytearray(p.tobytes()) if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, rgba binary").coalesce(1)
    made = P.page_boxes(df).mapInPandas(lambda batches: ([b.assign(n=len(b))[["image_id", "n"]] for b in batches]), "image_id long, n int").collect()
    assert sorted(r["image_id"] for r in made) == list(range(30))
    assert {r["n"] for r in made} == {30}
    failed = {r["image_id"] for r in P.page_boxes(df).filter("failed IS NOT NULL").collect()}
    assert failed == {i for i in range(30) if i % 3 == 0}
