"""Page-image kernels in NumPy; rows carry (height, width, image) with 8-bit pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_DESKEW_ANGLE


def deskew_angle(angle: Column) -> Column:
    """The turn that undoes a box's angle, or null where it is left alone."""
    turn = F.when(angle < -45, -(angle + 90)).otherwise(-angle)
    return F.when(F.abs(turn) <= MAX_DESKEW_ANGLE, turn)


def to_gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def box_angle(points: np.ndarray) -> float:
    """Angle in (-90, 0] of the smallest rectangle around points: one of its sides lies on the convex hull."""
    p = np.unique(points.astype(float), axis=0)
    if len(p) < 3:
        return 0.0

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    hull = np.array(chain(p) + chain(p[::-1]))
    if len(hull) < 3:
        return 0.0
    edge = np.roll(hull, -1, axis=0) - hull
    angles = np.unique(np.round(np.arctan2(edge[:, 1], edge[:, 0]) % (np.pi / 2), 12))
    turn = np.stack([np.cos(angles), np.sin(angles)])
    x, y = hull @ turn, hull @ np.stack([-turn[1], turn[0]])
    area = (x.max(0) - x.min(0)) * (y.max(0) - y.min(0))
    best = float(np.degrees(angles[area.argmin()]))
    return best - 90.0 if best > 0 else 0.0


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre, sampled by cubic convolution, borders repeated."""
    h, w = image.shape
    a = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    cx, cy = w // 2, h // 2
    sx = (x - cx) * np.cos(a) - (y - cy) * np.sin(a) + cx
    sy = (x - cx) * np.sin(a) + (y - cy) * np.cos(a) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = _cubic(sx - x0), _cubic(sy - y0)
    out = np.zeros((h, w))
    for j in range(4):
        rows = np.clip(y0 + j - 1, 0, h - 1)
        out += wy[j] * sum(wx[i] * image[rows, np.clip(x0 + i - 1, 0, w - 1)] for i in range(4))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _cubic(t: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    """Weights of the four neighbours about a place t of the way from the second to the third."""
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def deskew(image: np.ndarray) -> np.ndarray:
    dark = np.argwhere(image < 128)
    if not len(dark):
        return image
    angle = box_angle(dark)
    turn = -(90 + angle) if angle < -45 else -angle
    return image if abs(turn) > MAX_DESKEW_ANGLE or turn == 0 else rotate(image, turn)


def _blur(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    out = image.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        out = sum(kernel[i] * np.take(padded, range(i, i + out.shape[axis]), axis=axis) for i in range(len(kernel)))
    return out


def gaussian(size: int, sigma: float | None = None) -> np.ndarray:
    s = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * s * s))
    return k / k.sum()


def denoise(image: np.ndarray, h: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means; the windows are the usual library's defaults."""
    r, p = search // 2, patch // 2
    base = image.astype(float)
    padded = np.pad(base, r + p, mode="reflect" if min(image.shape) > r + p else "edge")
    rows, cols = image.shape
    total, weight = np.zeros_like(base), np.zeros_like(base)
    box = np.ones(patch) / patch
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            other = padded[r + p + dy : r + p + dy + rows, r + p + dx : r + p + dx + cols]
            w = np.exp(-_blur((base - other) ** 2, box) / (h * h))
            total += w * other
            weight += w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def binarize(image: np.ndarray, block: int = 31, offset: float = 10.0) -> np.ndarray:
    """White where a pixel is above the Gaussian mean of its block less the offset."""
    return np.where(image > np.rint(_blur(image, gaussian(block))) - offset, 255, 0).astype(np.uint8)


def preprocess(image: np.ndarray) -> np.ndarray:
    return binarize(denoise(deskew(to_gray(image))))


def degrade(image: np.ndarray, rotation: float, noise: bool, seed: int = 42) -> np.ndarray:
    """A scan's faults: the page turned on a white ground that grows to hold it, blur, Gaussian noise."""
    if rotation:
        h, w = image.shape
        a = np.radians(abs(rotation))
        up, side = int(np.ceil((h * np.cos(a) + w * np.sin(a) - h) / 2)), int(np.ceil((w * np.cos(a) + h * np.sin(a) - w) / 2))
        image = rotate(np.pad(image, ((max(up, 0) + 1,) * 2, (max(side, 0) + 1,) * 2), constant_values=255), rotation)
    if noise:
        image = np.clip(_blur(image, gaussian(5, 0.8)) + np.random.default_rng(seed).normal(0, 12, image.shape).astype(np.int16), 0, 255).astype(np.uint8)
    return image


def map_images(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Any chain of kernels in one pass over (doc_id, page_num, height, width, image)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [kernel(np.frombuffer(b, np.uint8).reshape(h, w, *(() if len(b) == h * w else (-1,)))) for b, h, w in zip(pdf["image"], pdf["height"], pdf["width"], strict=True)]
            yield pdf.assign(height=[x.shape[0] for x in out], width=[x.shape[1] for x in out], image=[x.tobytes() for x in out])

    want = df.select("doc_id", "page_num", F.col("height").cast("int"), F.col("width").cast("int"), "image")
    return want.mapInPandas(run, want.schema)
