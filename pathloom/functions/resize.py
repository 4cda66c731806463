"""Image resizing with antialiasing: separable kernels, widened when shrinking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _box(x: np.ndarray) -> np.ndarray:
    return ((x > -0.5) & (x <= 0.5)).astype(float)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _hamming(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1, np.sinc(x) * (0.54 + 0.46 * np.cos(np.pi * x)), 0.0)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Filter -> (kernel, support at scale 1).
FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray] | None, float]] = {
    "NEAREST": (None, 0.0),
    "BOX": (_box, 0.5),
    "BILINEAR": (_triangle, 1.0),
    "HAMMING": (_hamming, 1.0),
    "BICUBIC": (_cubic, 2.0),
    "LANCZOS": (_lanczos, 3.0),
}


def _weights(old: int, new: int, kernel: Callable[[np.ndarray], np.ndarray], support: float) -> tuple[np.ndarray, np.ndarray]:
    """For each new pixel: the old ones it draws from, and how much."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    lo = np.maximum(np.floor(centre - support * wide + 0.5), 0).astype(int)
    n = int(np.ceil(support * wide)) * 2 + 1
    places = lo[:, None] + np.arange(n)
    w = kernel((places + 0.5 - centre[:, None]) / wide)
    w[(places >= old) | (places + 0.5 - centre[:, None] > support * wide)] = 0
    return np.minimum(places, old - 1), w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, method: str = "LANCZOS") -> np.ndarray:
    """[y, x(, channels)] at a new size; uint8 stays uint8, rounded. KeyError for
    an unknown filter."""
    kernel, support = FILTERS[method]
    h, w = image.shape[:2]
    if (w, h) == (width, height):
        return image
    if kernel is None:
        y, x = ((np.arange(height) + 0.5) * h / height).astype(int), ((np.arange(width) + 0.5) * w / width).astype(int)
        return image[y][:, x]
    out = image.astype(float)
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] == size:
            continue
        places, weights = _weights(out.shape[axis], size, kernel, support)
        moved = np.moveaxis(out, axis, 0)
        out = np.moveaxis(np.stack([np.tensordot(weights[i], moved[places[i]], axes=(0, 0)) for i in range(size)]), 0, axis)
        if image.dtype == np.uint8:
            out = np.clip(np.floor(out + 0.5), 0, 255)
    return out.astype(image.dtype)


def bilinear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Plain bilinear sampling at pixel centres, without antialiasing: for model outputs."""
    h, w = image.shape
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    return resize(image, width, height, "NEAREST")


#: Interpolations of model outputs.
INTERPOLATIONS = {"bilinear": bilinear, "nearest": nearest}


def white_borders(image: np.ndarray, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """Along each axis, all lines from the first to the last that is all zero get
    the background; others stay."""
    out, blank = image.copy(), ~image.any(axis=2)
    for axis in (0, 1):
        lines = np.flatnonzero(blank.all(axis=1 - axis))
        if len(lines):
            np.moveaxis(out, axis, 0)[lines[0] : lines[-1] + 1] = background
    return out
