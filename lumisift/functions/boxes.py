"""A face model's output for a batch of photos, decoded in numpy: the main face of each, as detect_main_faces() finds it from tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lumisift.operators.faces import CENTER, CONFIDENCE, LAYERS, LEAST_AREA, OVERLAP, SIZE

_F = np.float32


@lru_cache(1)
def priors() -> np.ndarray:
    """(4420, 4) centres and sizes of the model's boxes, layer by layer, row by row, cell by cell, box by box."""
    out = []
    for columns, rows, edges in LAYERS:
        y, x, e = np.meshgrid(np.arange(rows, dtype=_F), np.arange(columns, dtype=_F), np.array(edges, _F), indexing="ij")
        sides = (np.minimum(e / _F(n), _F(1)) for n in (320, 240))
        out.append(np.stack([((x + _F(0.5)) / _F(columns)), ((y + _F(0.5)) / _F(rows)), *sides], -1).reshape(-1, 4))
    return np.concatenate(out)


def decoded(scores: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prior numbers, scores and boxes (x1, y1, x2, y2 in shares of the frame) of one photo's rows above the confidence, best first."""
    at = np.flatnonzero(scores > _F(CONFIDENCE))
    at = at[np.argsort(-scores[at], kind="stable")]
    prior, found = priors()[at], raw[at].astype(_F)
    centre = found[:, :2] * _F(CENTER) * prior[:, 2:] + prior[:, :2]
    half = (np.exp((found[:, 2:] * _F(SIZE)).astype(np.float64)).astype(_F) * prior[:, 2:]) / _F(2)
    return at, scores[at], np.concatenate([centre - half, centre + half], 1)


def _sides(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(high - low, _F(0))


def without_overlaps(boxes: np.ndarray) -> list[int]:
    """Places of the boxes, best first, that overlap none kept before too much."""
    area, kept = _sides(boxes[:, 0], boxes[:, 2]) * _sides(boxes[:, 1], boxes[:, 3]), []
    left = np.arange(len(boxes))
    while len(left):
        k, left = int(left[0]), left[1:]
        kept.append(k)
        both = _sides(np.maximum(boxes[k, 0], boxes[left, 0]), np.minimum(boxes[k, 2], boxes[left, 2])) * _sides(np.maximum(boxes[k, 1], boxes[left, 1]), np.minimum(boxes[k, 3], boxes[left, 3]))
        left = left[both / (area[k] + area[left] - both + _F(1e-5)) <= _F(OVERLAP)]
    return kept


def main_face(scores: np.ndarray, raw: np.ndarray, width: int, height: int) -> dict | None:
    """The largest face of a photo in its pixels, then the surest, then that of the lower prior; None without any."""
    prior, score, boxes = decoded(np.asarray(scores, _F).ravel(), np.asarray(raw, _F).reshape(-1, 4))
    kept = without_overlaps(boxes)
    boxes = np.clip(boxes[kept], _F(0), _F(1)) * np.array([width, height] * 2, _F)
    area = _sides(boxes[:, 0], boxes[:, 2]) * _sides(boxes[:, 1], boxes[:, 3])
    large = np.flatnonzero(area / _F(width * height) >= _F(LEAST_AREA))
    if not len(large):
        return None
    best = max(large.tolist(), key=lambda k: (area[k], score[kept[k]], -prior[kept[k]]))
    return dict(zip(("x1", "y1", "x2", "y2"), boxes[best].tolist(), strict=True)) | {"score": float(score[kept[best]])}
