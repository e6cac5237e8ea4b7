"""Pixel work on batches of equally large images; arrays are (images, height, width[, 3])."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def to_gray(rgb: np.ndarray) -> np.ndarray:
    """Luma bytes by BT.709, halves to even."""
    r, g, b = (rgb[..., c].astype(np.float64) for c in range(3))
    return np.clip(np.rint(0.2126 * r + 0.7152 * g + 0.0722 * b), 0, 255).astype(np.uint8)


def crop(gray: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part that begins at (x, y), moved into the image if need be, at least one pixel large."""
    height, width = gray.shape[1:3]
    x, y = min(max(x, 0), width - 1), min(max(y, 0), height - 1)
    return gray[:, y : y + max(1, min(h, height - y)), x : x + max(1, min(w, width - x))]


def center_crop(gray: np.ndarray, fraction: float) -> np.ndarray:
    """The middle part with this share of either edge; single precision, halves to even."""
    if fraction >= 1:
        return gray
    height, width = gray.shape[1:3]
    w, h = (max(1, int(np.rint(np.float32(n) * np.float32(fraction)))) for n in (width, height))
    return crop(gray, (width - w) // 2, (height - h) // 2, w, h)


def face_crop(gray: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The face's box grown to 1.7 times its size about its centre and kept within the image; for one image."""
    height, width = gray.shape[1:3]
    f = np.float32
    x1, y1, x2, y2 = map(f, box)
    sides = []
    for low, high, size in ((x1, x2, width), (y1, y2, height)):
        span = max((high - low) * f(1.7), f(1))
        begin = min(max((low + high) / f(2) - span / f(2), f(0)), f(size) - f(1))
        sides.append((int(begin), max(int(min(span, f(size) - begin)), 1)))
    return crop(gray, sides[0][0], sides[1][0], sides[0][1], sides[1][1])


def laplacian(gray: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel; edges are repeated outwards."""
    p = np.pad(gray.astype(np.int32), ((0, 0), (1, 1), (1, 1)), mode="edge")
    return p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * p[:, 1:-1, 1:-1]


def laplacian_variance(gray: np.ndarray) -> np.ndarray:
    """Population variance of each image's Laplacian, from whole-number moments."""
    lap = laplacian(gray).reshape(len(gray), -1).astype(np.int64)
    n = lap.shape[1]
    if not n:
        return np.zeros(len(gray))
    s, q = lap.sum(1), (lap * lap).sum(1)
    return (n * q - s * s) / float(n * n)


@lru_cache(256)
def _tent(src: int, dst: int) -> tuple[np.ndarray, np.ndarray]:
    """For each target place its first source place and weights, (dst, window), summing to 1."""
    scale = src / dst
    wide = max(scale, 1.0)
    centre = (np.arange(dst) + 0.5) * scale
    first = np.maximum(np.floor(centre - wide).astype(int), 0)
    last = np.minimum(np.ceil(centre + wide).astype(int), src - 1)
    at = first[:, None] + np.arange((last - first).max() + 1)
    weight = np.maximum(0.0, 1.0 - np.abs((at + 0.5 - centre[:, None]) / wide)) * (at <= last[:, None])
    total = np.zeros(dst)
    for k in range(weight.shape[1]):
        total += weight[:, k]
    lost = total <= 0
    if lost.any():
        first[lost], weight[lost], total[lost] = np.clip(centre[lost].astype(int), 0, src - 1), 0.0, 1.0
        weight[lost, 0] = 1.0
    return np.minimum(first[:, None] + np.arange(weight.shape[1]), src - 1), np.concatenate([weight, (1.0 / total)[:, None]], 1)


def _resize_axis(rgb: np.ndarray, size: int, axis: int) -> np.ndarray:
    at, weight = _tent(rgb.shape[axis], size)
    shape = [1] * rgb.ndim
    shape[axis] = size
    out = np.zeros(rgb.shape[:axis] + (size,) + rgb.shape[axis + 1 :])
    for k in range(at.shape[1]):
        out += np.take(rgb, at[:, k], axis).astype(np.float64) * weight[:, k].reshape(shape)
    return np.clip(np.rint(out * weight[:, -1].reshape(shape)), 0, 255).astype(np.uint8)


def resize_triangle(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    """Tent-filter resize, widened when shrinking; first along rows, then along columns, bytes after each."""
    if w != rgb.shape[2]:
        rgb = _resize_axis(rgb, w, 2)
    return rgb if h == rgb.shape[1] else _resize_axis(rgb, h, 1)


def fit_size(w: int, h: int, most: int) -> tuple[int, int]:
    """Size with neither edge above most, aspect kept, never larger, at least 1."""
    if w <= most and h <= most:
        return w, h
    scale = min(most / w, most / h)
    return max(1, int(np.rint(w * scale))), max(1, int(np.rint(h * scale)))


def resize_to_fit(rgb: np.ndarray, most: int) -> np.ndarray:
    w, h = fit_size(rgb.shape[2], rgb.shape[1], most)
    return resize_triangle(rgb, w, h)


def dhash64(rgb: np.ndarray) -> np.ndarray:
    """Signed 64-bit difference hash: bit 8 y + x is set where a 9 x 8 luma pixel is above its right neighbour."""
    small = to_gray(resize_triangle(rgb, 9, 8))
    bits = (small[:, :, :-1] > small[:, :, 1:]).reshape(len(rgb), 64)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def orient(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """Upright image for EXIF orientation 1 to 8; other values leave it."""
    if orientation in (5, 6, 7, 8):
        rgb = rgb.transpose(0, 2, 1, 3)
    if orientation in (2, 3, 6, 7):
        rgb = rgb[:, :, ::-1]
    if orientation in (3, 4, 7, 8):
        rgb = rgb[:, ::-1]
    return rgb


def detector_tensor(rgb: np.ndarray, w: int = 320, h: int = 240) -> np.ndarray:
    """(images, 3, h, w) float32 input of the face model."""
    return ((resize_triangle(rgb, w, h).astype(np.float32) - np.float32(127)) / np.float32(128)).transpose(0, 3, 1, 2)


#: Region variances kept for every photo, so that a change of mode needs no pixels.
REGIONS = {"var_full": 1.0, "var_object": 0.6, "var_half": 0.5, "var_portrait": 0.45}
MOMENTS = ("n_px", "sum_l", "sum_l2", "n_clipped", "sum_rg", "sum_rg2", "sum_yb2x", "sum_yb2x2", "energy", "energy_thirds")


def moments(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """Whole-number sums behind exposure, contrast, colour and composition, and the region variances."""
    gray = to_gray(rgb)
    height, width = gray.shape[1:3]
    flat = gray.reshape(len(gray), -1).astype(np.int64)
    r, g, b = (rgb[..., c].reshape(len(rgb), -1).astype(np.int64) for c in range(3))
    rg, yb = r - g, r + g - 2 * b
    energy = np.abs(laplacian(gray)).astype(np.int64)
    x_near, y_near = (np.any([np.abs(np.arange(n) - k * n / 3.0) <= max(n * 0.10, 1.0) for k in (1.0, 2.0)], axis=0) for n in (width, height))
    near = y_near[:, None] | x_near[None, :]
    out = {
        "n_px": np.full(len(gray), flat.shape[1], np.int64), "sum_l": flat.sum(1), "sum_l2": (flat * flat).sum(1), "n_clipped": ((flat <= 3) | (flat >= 252)).sum(1),
        "sum_rg": rg.sum(1), "sum_rg2": (rg * rg).sum(1), "sum_yb2x": yb.sum(1), "sum_yb2x2": (yb * yb).sum(1), "energy": energy.sum((1, 2)), "energy_thirds": (energy * near).sum((1, 2)),
    }
    return out | {name: laplacian_variance(center_crop(gray, share)) for name, share in REGIONS.items()}
