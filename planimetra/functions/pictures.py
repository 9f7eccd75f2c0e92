"""NumPy kernels for grey images of 8 bits."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Wider images are measured as thumbnails of this width; differences between frames are taken on thumbnails of THUMBNAIL.
WIDEST, THUMBNAIL = 640, (160, 120)


@lru_cache(maxsize=64)
def _shares(size: int, to: int) -> np.ndarray:
    """How much of each of size cells lies in each of to equal parts, in rows that sum to 1."""
    edge = np.linspace(0, size, to + 1)
    low, high = np.maximum(edge[:-1, None], np.arange(size)), np.minimum(edge[1:, None], np.arange(1, size + 1))
    return np.maximum(high - low, 0) * (to / size)


def shrunk(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over areas, rounded to whole values; an image that is smaller is stretched by the same rule."""
    return np.rint(_shares(image.shape[0], height) @ image.astype(float) @ _shares(image.shape[1], width).T)


def bounded(image: np.ndarray) -> np.ndarray:
    if image.shape[1] <= WIDEST:
        return image.astype(float)
    return shrunk(image, WIDEST, max(1, round(image.shape[0] * WIDEST / image.shape[1])))


def _bordered(image: np.ndarray) -> np.ndarray:
    """With a border of one, mirrored at the outermost row and column."""
    return np.pad(image, 1, mode="reflect") if min(image.shape) > 1 else np.pad(image, 1, mode="edge")


def sharpness(image: np.ndarray) -> float:
    """Variance of the sum of four neighbours less four times the pixel; 0 for no image."""
    if not image.size:
        return 0.0
    p = _bordered(bounded(image))
    return float(np.var(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]))


def texture(image: np.ndarray) -> float:
    """Twice the mean length of the gradient (weights 1, 2, 1 across), 100 at most; 0 for no image."""
    if not image.size:
        return 0.0
    p = _bordered(bounded(image))
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return min(100.0, 2 * float(np.mean(np.hypot(gx, gy))))


def difference(one: np.ndarray, two: np.ndarray) -> float:
    """Mean distance of two images' thumbnails, 0 to 255; 0 where either is empty."""
    return float(np.abs(shrunk(one, *THUMBNAIL) - shrunk(two, *THUMBNAIL)).mean()) if one.size and two.size else 0.0
