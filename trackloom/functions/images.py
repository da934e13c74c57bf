"""Crops of persons as raw pixels: quality gate, garment regions and their dominant colour, as pandas UDFs.

A crop is three columns: bytes (blue, green, red of each pixel, row by row), height and width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from trackloom.functions.colours import PALETTE

# The least area and the least variance of the Laplacian of a crop that can be described, the least pixels
# of a garment region, and where garments lie: shares of the height, and of the width for both.
LEAST_AREA, LEAST_VARIANCE, LEAST_REGION = 400, 400.0, 150
REGIONS = {"upper": (0.25, 0.55), "lower": (0.60, 0.90)}
SIDES = (0.15, 0.85)


def pixels(data: bytes | None, height: int, width: int) -> np.ndarray:
    if data is None or height <= 0 or width <= 0 or len(data) != height * width * 3:
        return np.zeros((0, 0, 3), np.uint8)
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def laplacian_variance(grey: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, mirrored at the border."""
    g = np.pad(grey.astype(float), 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey.astype(float), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def is_low_quality(crop: np.ndarray) -> bool:
    if crop.shape[0] * crop.shape[1] < LEAST_AREA:
        return True
    grey = np.rint(crop @ np.array([0.114, 0.587, 0.299]))
    return laplacian_variance(grey) < LEAST_VARIANCE


def garment_region(crop: np.ndarray, part: str) -> np.ndarray:
    """The torso or the legs, without the crop's sides; the crop itself where nothing would be left."""
    h, w = crop.shape[:2]
    top, bottom = REGIONS[part]
    region = crop[int(h * top) : int(h * bottom), int(w * SIDES[0]) : int(w * SIDES[1])]
    return region if region.size else crop


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab of 8-bit sRGB pixels, scaled to 0 to 255 a channel."""
    c = rgb.astype(float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    x, y, z = (c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1, 1.088754])).T
    f = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.stack([np.rint(light * 2.55), np.rint(500 * (f(x) - f(y)) + 128), np.rint(200 * (f(y) - f(z)) + 128)], axis=1)


def dominant_colour(region: np.ndarray, k: int = 3, rounds: int = 20, seed: int = 0) -> str:
    """The palette's colour nearest to the largest of k clusters of the region's pixels in Lab; "unknown" for few pixels.

    k-means++ with a fixed seed, the best of five starts.
    """
    if region.shape[0] * region.shape[1] < LEAST_REGION:
        return "unknown"
    points, rng, best = lab(region.reshape(-1, 3)[:, ::-1]), np.random.default_rng(seed), (np.inf, None, None)
    for _ in range(5):
        centres = points[rng.integers(len(points))][None]
        for _ in range(k - 1):
            far = ((points[:, None] - centres[None]) ** 2).sum(2).min(1)
            pick = rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(points))
            centres = np.concatenate([centres, points[pick][None]])
        for _ in range(rounds):
            own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            moved = np.stack([points[own == i].mean(0) if (own == i).any() else centres[i] for i in range(k)])
            if np.abs(moved - centres).max() < 1:
                centres = moved
                break
            centres = moved
        gap = ((points[:, None] - centres[None]) ** 2).sum(2)
        if gap.min(1).sum() < best[0]:
            best = (gap.min(1).sum(), gap.argmin(1), centres)
    centre = best[2][np.argmax(np.bincount(best[1], minlength=k))]
    named = lab(np.array(list(PALETTE.values())))
    return list(PALETTE)[int(((named - centre) ** 2).sum(1).argmin())]


@F.pandas_udf(BooleanType())
def low_quality(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Whether a crop is too small or too blurred to be described; so without pixels."""
    return pd.Series([is_low_quality(pixels(d, h, w)) for d, h, w in zip(data, height, width, strict=True)])


@F.pandas_udf(StructType([StructField(part, StringType()) for part in REGIONS]))
def garment_colours(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The dominant colours of the upper and the lower garment."""
    crops = [pixels(d, h, w) for d, h, w in zip(data, height, width, strict=True)]
    return pd.DataFrame({part: [dominant_colour(garment_region(c, part)) if c.size else "unknown" for c in crops] for part in REGIONS})
