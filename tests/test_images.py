"""Pixel operators against plain Python."""

import numpy as np

from quillmill.operators import images as I
from quillmill.sources import scans


def picture(h=7, w=9, seed=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)


def test_grayscale_and_sharpen():
    p = picture()
    g = I.grayscale(p.copy())
    r = p[2, 3].astype(float)
    assert g[2, 3, 0] == int(r[0] * 0.3 + r[1] * 0.59 + r[2] * 0.11 + 0.5)
    s = I.sharpen(g.copy())
    x = g[..., 0].astype(int)
    assert s[2, 3, 0] == min(255, max(0, 5 * x[2, 3] - x[1, 3] - x[3, 3] - x[2, 2] - x[2, 4]))
    assert (s[0] == g[0]).all() and (s[:, -1] == g[:, -1]).all()


def test_otsu_separates_two_levels():
    p = np.zeros((4, 4, 4), np.uint8)
    p[:2], p[2:] = 20, 200
    t = I.otsu(p)
    assert 20 <= t < 200
    assert set(np.unique(I.threshold(t)(p.copy())[..., 0])) == {0, 255}


def test_adaptive_threshold_and_blur_keep_flat_pictures():
    p = np.full((13, 13, 4), 90, np.uint8)
    assert (I.adaptive_threshold()(p.copy())[..., 0] == 255).all()
    assert (I.gaussian(p.copy())[..., 0] == 90).all() and (I.box_blur(p.copy())[..., 0] == 90).all()
    assert (I.brightness()(p.copy())[..., 0] == 128).all()


def test_brightness_scales_and_measures_sample():
    p = np.zeros((5, 5, 4), np.uint8)
    p[..., 0] = np.arange(25).reshape(5, 5) * 4
    mean = p[..., 0].mean()
    assert I.brightness()(p.copy())[2, 2, 0] == int(int(p[2, 2, 0]) * 128 / mean + 0.5)
    q = picture(6, 7)
    m, gray = I.measures(q), [[sum(int(v) for v in px[:3]) / 3 for px in row] for row in q]
    edge = [abs(gray[y][x] * 2 - gray[y][x + 1] - gray[y + 1][x]) for y in range(1, 5, 2) for x in range(1, 6, 2)]
    mean = sum(edge) / len(edge)
    assert abs(m["variance"] - sum((e - mean) ** 2 for e in edge) / len(edge)) < 1e-6
    flat = [g for row in gray for g in row][::4]
    assert abs(m["mean"] - sum(flat) / len(flat)) < 1e-9 and abs(m["span"] - (max(flat) - min(flat))) < 1e-9


def test_frames(spark):
    p = picture()
    df = spark.createDataFrame([(1, 9, 7, bytearray(p.tobytes()))], I.SCHEMA)
    assert I.measured(df).first()["image_id"] == 1
    assert I.preprocess(df).count() == 1


def test_injected_scanner(spark):
    def scanner():
        return lambda raw: {"text": raw.decode(), "confidence": 80, "words": [dict(text=raw.decode(), confidence=None, x0=0.0, y0=0.0, x1=5.0, y1=5.0)]}

    df = spark.createDataFrame([(1, bytearray(b"TOTAL 5"))], "bill_id long, content binary")
    assert tuple(scans.scan(df, scanner).first()) == (1, "TOTAL 5", 0.8)
    assert scans.scan(df, scanner, words=True).first()["confidence"] == 0.0


def test_enhance_is_its_steps_in_order(spark):
    p = picture()
    got = I.enhance(spark.createDataFrame([(1, 9, 7, bytearray(p.tobytes()))], I.SCHEMA)).first()["rgba"]
    want = I.brightness()(I.box_blur(I.sharpen(I.contrast(1.4)(I.grayscale(p.copy())))))
    assert bytes(got) == want.tobytes()
