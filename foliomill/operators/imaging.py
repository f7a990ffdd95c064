"""Pixel features in numpy, for use inside mapInPandas; what is decided from them stays a Column expression.

Borders are replicated. Kernel sizes follow the record format's documentation; exact parity with a native image library is not claimed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import page_mode


def _gauss(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _blur(img: np.ndarray, size: int) -> np.ndarray:
    """Separable Gaussian blur."""
    k, r = _gauss(size), size // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(img, pad, mode="edge")
        view = np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis)
        img = view @ k
    return img


def binarize(gray: np.ndarray) -> np.ndarray:
    """Ink as True: darker than the local Gaussian mean of 35 pixels by more than 11."""
    g = np.rint(_blur(gray.astype(float), 3))
    return g <= np.rint(_blur(g, 35)) - 11


def _slide(img: np.ndarray, size: int, axis: int, grow: bool) -> np.ndarray:
    """Running any (grow) or all (shrink) over a centred window; outside the image counts as neutral."""
    if size <= 1:
        return img
    before = size // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (before, size - 1 - before)
    sums = np.cumsum(np.pad(img.astype(np.int32), pad, constant_values=0 if grow else 1), axis=axis)
    zero = np.zeros_like(np.take(sums, [0], axis=axis))
    sums = np.concatenate([zero, sums], axis=axis)
    n = img.shape[axis]
    window = np.take(sums, np.arange(size, size + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)
    return window > 0 if grow else window == size


def opened(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Erosion, then dilation, by a w x h rectangle."""
    out = _slide(_slide(img, w, 1, False), h, 0, False)
    return _slide(_slide(out, w, 1, True), h, 0, True)


def closed(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Dilation, then erosion."""
    out = _slide(_slide(img, w, 1, True), h, 0, True)
    return _slide(_slide(out, w, 1, False), h, 0, False)


def grid_ratio(ink: np.ndarray) -> float:
    """Share of pixels on long straight rules."""
    h, w = ink.shape
    lines = opened(ink, max(10, w // 60), 1) | opened(ink, 1, max(10, h // 80))
    return float(lines.mean())


def without_rules(ink: np.ndarray) -> np.ndarray:
    """The page without its ruled lines."""
    h, w = ink.shape
    return ink & ~(opened(ink, max(12, w // 55), 1) | opened(ink, 1, max(12, h // 70)))


def components(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x0, y0, x1, y1 (exclusive) and area of each 8-connected component: row runs joined by union-find."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    last: list[tuple[int, int, int]] = []
    for y in range(ink.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ink[y].astype(np.int8), [0]])))
        row = []
        k = 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            me = len(parent)
            parent.append(me)
            boxes.append([a, y, b, y + 1, b - a])
            while k < len(last) and last[k][1] < a:
                k += 1
            j = k
            while j < len(last) and last[j][0] <= b:
                r, s = find(last[j][2]), find(me)
                if r != s:
                    parent[s] = r
                    p, q = boxes[r], boxes[s]
                    boxes[r] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]]
                j += 1
            row.append((a, b, me))
        last = row
    return [tuple(boxes[i]) for i in range(len(parent)) if find(i) == i]


def text_regions(ink: np.ndarray, mode: str, least: int = 50) -> list[tuple[int, int, int, int, int]]:
    """Components of the page closed along its lines, of at least so many pixels."""
    w = ink.shape[1]
    joined = closed(ink, max(18, w // 55), 3) if mode == "handwriting" else closed(ink, max(12, w // 70), 2)
    return [c for c in components(joined) if c[4] >= least]


def page_features(images: DataFrame) -> DataFrame:
    """path, width, height, ink_ratio, grid_ratio, components, small and mode of the rows of Spark's image source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, h, w, ch, data in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"]):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, ch).astype(float)
                gray = pixels[..., 0] if ch == 1 else pixels[..., :3] @ np.array([0.114, 0.587, 0.299])  # stored blue first
                ink = binarize(gray)
                found = components(ink)
                rows.append((path, w, h, float(ink.mean()), grid_ratio(ink), len(found), sum(10 <= c[4] <= 120 for c in found)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "ink_ratio", "grid_ratio", "components", "small"])

    flat = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    out = flat.mapInPandas(run, "path string, width int, height int, ink_ratio double, grid_ratio double, components int, small int")
    return out.withColumn("mode", page_mode(F.col("grid_ratio"), F.col("ink_ratio"), F.col("small")))
