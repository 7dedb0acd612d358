"""Pixel operators on (image_id, width, height, rgba binary) rows, with NumPy in mapInPandas.

Each row is one image, so memory is bounded by the largest; results are rounded
as bytes clamped to 0..255.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "image_id long, width int, height int, rgba binary"


def _bytes(x: np.ndarray) -> np.ndarray:
    """Halves go up."""
    return np.floor(np.clip(x, 0, 255) + 0.5).astype(np.uint8)


def _pixels(rgba: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4).copy()


def grayscale(p: np.ndarray) -> np.ndarray:
    g = _bytes(p[..., 0] * 0.3 + p[..., 1] * 0.59 + p[..., 2] * 0.11)
    p[..., :3] = g[..., None]
    return p


def contrast(factor: float = 1.3) -> Callable[[np.ndarray], np.ndarray]:
    def run(p: np.ndarray) -> np.ndarray:
        p[..., :3] = _bytes((p[..., :1].astype(float) - 128) * factor + 128)
        return p

    return run


def _kernel(p: np.ndarray, center: float, cross: float, corner: float, divisor: float = 1) -> np.ndarray:
    """3 by 3 over the first channel of the inner pixels; the border stays."""
    x = p[..., 0].astype(float)
    if min(x.shape) < 3:
        return p
    out = center * x[1:-1, 1:-1] + cross * (x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:])
    if corner:
        out = out + corner * (x[:-2, :-2] + x[:-2, 2:] + x[2:, :-2] + x[2:, 2:])
    p[1:-1, 1:-1, :3] = _bytes(out / divisor)[..., None]
    return p


def sharpen(p: np.ndarray) -> np.ndarray:
    return _kernel(p, 5, -1, 0)


def box_blur(p: np.ndarray) -> np.ndarray:
    return _kernel(p, 1, 1, 1, 9)


def threshold(limit: float = 150) -> Callable[[np.ndarray], np.ndarray]:
    def run(p: np.ndarray) -> np.ndarray:
        p[..., :3] = np.where(p[..., :1] > limit, 255, 0)
        return p

    return run


def brightness(target: float = 128) -> Callable[[np.ndarray], np.ndarray]:
    """Scales the first channel so that its mean is the target; nearly black pictures stay."""

    def run(p: np.ndarray) -> np.ndarray:
        mean = p[..., 0].mean() if p.size else target
        if mean >= 1:
            p[..., :3] = _bytes(p[..., :1].astype(float) * (target / mean))
        return p

    return run


def gaussian(p: np.ndarray) -> np.ndarray:
    """5 by 5 binomial; edges are mirrored."""
    w = np.array([1, 4, 6, 4, 1]) / 16
    x = np.pad(p[..., :3].astype(float), ((2, 2), (2, 2), (0, 0)), mode="reflect" if min(p.shape[:2]) > 2 else "edge")
    x = sum(w[i] * x[i : i + p.shape[0]] for i in range(5))
    p[..., :3] = _bytes(sum(w[i] * x[:, i : i + p.shape[1]] for i in range(5)))
    return p


def adaptive_threshold(size: int = 11, less: float = 2, gaussian: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """White where a pixel exceeds the mean around it less a constant; the mean is plain, or a whole number weighted by a bell curve."""

    def run(p: np.ndarray) -> np.ndarray:
        r = size // 2
        x = np.pad(p[..., 0].astype(float), r, mode="edge")
        if gaussian:
            w = np.exp(-((np.arange(size) - r) ** 2) / (2 * (0.3 * ((size - 1) * 0.5 - 1) + 0.8) ** 2))
            w /= w.sum()
            x = sum(w[i] * x[i : i + p.shape[0]] for i in range(size))
            mean = np.floor(sum(w[i] * x[:, i : i + p.shape[1]] for i in range(size)) + 0.5)
        else:
            s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            mean = (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2
        p[..., :3] = np.where(p[..., 0] > mean - less, 255, 0)[..., None]
        return p

    return run


def otsu(p: np.ndarray) -> int:
    """The threshold of greatest variance between classes, from 1 to 254."""
    h = np.bincount(p[..., 0].ravel(), minlength=256).astype(float)
    below, total = np.cumsum(h), h.sum()
    mass = np.cumsum(h * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    between = np.where((below > 0) & (above > 0), between, -1)
    return int(np.clip(np.argmax(between), 1, 254))


def measures(p: np.ndarray) -> dict:
    """Blur, brightness and contrast as the quality gate samples them: every second inner pixel, every fourth pixel."""
    gray = p[..., :3].astype(float).sum(2) / 3
    h, w = gray.shape
    y, x = np.arange(1, h - 1, 2)[:, None], np.arange(1, w - 1, 2)[None]
    edge = np.abs(gray[y, x] * 2 - gray[y, x + 1] - gray[y + 1, x]) if y.size and x.size else np.zeros(1)
    some = gray.ravel()[::4]
    return dict(
        variance=float(edge.var()), blurry=bool(edge.var() < 50), mean=float(some.mean()), bright_ok=bool(40 <= some.mean() <= 235),
        span=float(some.max() - some.min()), contrast_ok=bool(some.max() - some.min() >= 50), otsu=otsu(p),
    )


MEASURES = "image_id long, variance double, blurry boolean, mean double, bright_ok boolean, span double, contrast_ok boolean, otsu int"


def apply(images: DataFrame, *steps: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The images after the steps, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, w, h, rgba in pdf[["image_id", "width", "height", "rgba"]].itertuples(index=False):
                p = _pixels(rgba, w, h)
                for step in steps:
                    p = step(p)
                out.append((i, p.shape[1], p.shape[0], p.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "rgba"])

    return images.mapInPandas(run, SCHEMA)


def preprocess(images: DataFrame) -> DataFrame:
    return apply(images, grayscale, contrast(1.3), sharpen, lambda p: threshold(otsu(p))(p))


def enhance(images: DataFrame) -> DataFrame:
    """The other chain: more contrast, sharper, less noise, even brightness; no threshold."""
    return apply(images, grayscale, contrast(1.4), sharpen, box_blur, brightness())


def measured(images: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([dict(image_id=i, **measures(_pixels(x, w, h))) for i, w, h, x in pdf[["image_id", "width", "height", "rgba"]].itertuples(index=False)])

    return images.mapInPandas(run, MEASURES)
