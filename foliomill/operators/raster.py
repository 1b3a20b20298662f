"""Pixel kernels for page images, in numpy. They count; classes are decided on columns (pages.raster_decision, pages.map_visual).

Thresholding uses the mean of a 31-pixel box instead of a Gaussian one, edges are steep gradients, and closed regions are those that fill their
bounding rectangle; a contour library would give slightly other counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = "struct<horizontal_lines:int,vertical_lines:int,intersections:int,closed_regions:int,boxes:int,area:double,ink:double,edges:double,components:int>"


def _box_mean(x: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    padded = np.pad(x, half + 1, mode="edge")[:-1, :-1]
    sums = padded.cumsum(axis=0).cumsum(axis=1)
    h, w = x.shape
    return (sums[size - 1 + 1 : size + h, size : size + w] - sums[:h, size : size + w] - sums[size : size + h, :w] + sums[:h, :w]) / size**2


def _open(mask: np.ndarray, length: int) -> np.ndarray:
    """What runs of at least length along the rows leave."""
    h, w = mask.shape
    edge = np.zeros((h, w + 2), np.int8)
    edge[:, 1:-1] = mask
    change = np.diff(edge, axis=1)
    row, start = np.nonzero(change == 1)
    stop = np.nonzero(change == -1)[1]
    keep = stop - start >= length
    out = np.zeros((h, w + 1), np.int32)
    np.add.at(out, (row[keep], start[keep]), 1)
    np.add.at(out, (row[keep], stop[keep]), -1)
    return out.cumsum(axis=1)[:, :w] > 0


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Label (0 for outside) of each pixel, and (area, top, left, bottom, right) of each label from 1."""
    h, w = mask.shape
    edge = np.zeros((h, w + 2), np.int8)
    edge[:, 1:-1] = mask
    change = np.diff(edge, axis=1)
    row, start = np.nonzero(change == 1)
    stop = np.nonzero(change == -1)[1]
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for r in range(1, h):
        i, j = int(first[r - 1]), int(first[r])
        while i < first[r] and j < first[r + 1]:
            if start[j] < stop[i] + reach and start[i] < stop[j] + reach:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], np.int64)
    _, label = np.unique(roots, return_inverse=True) if len(roots) else (roots, roots)
    n = int(label.max(initial=-1)) + 1
    stats = np.zeros((n, 5), np.int64)
    stats[:, 1:3] = max(h, w)
    np.add.at(stats[:, 0], label, stop - start)
    np.minimum.at(stats[:, 1], label, row)
    np.minimum.at(stats[:, 2], label, start)
    np.maximum.at(stats[:, 3], label, row + 1)
    np.maximum.at(stats[:, 4], label, stop)
    labels = np.zeros((h, w), np.int32)
    for k in range(len(row)):
        labels[row[k], start[k] : stop[k]] = label[k] + 1
    return labels, stats


def measure(rgb: np.ndarray) -> dict[str, float]:
    grey = (rgb[..., :3] @ np.array([0.299, 0.587, 0.114])) if rgb.ndim == 3 else rgb.astype(float)
    h, w = grey.shape
    dark = grey < _box_mean(grey, 31) - 15
    if h >= 200 and w >= 200:
        a, b = max(8, round(h * 0.055)), max(8, round(w * 0.035))
        dark[:a] = dark[h - a :] = False
        dark[:, :b] = dark[:, w - b :] = False
    across, down = _open(dark, max(20, w // 30)), _open(dark.T, max(12, h // 45)).T
    least = (max(12, w // 80), max(12, h // 100))
    lines = [x[x[:, 0] >= n] for x, n in zip((components(across)[1], components(down)[1]), least)]
    crossings = components(across & down)[1]
    crossings = crossings[crossings[:, 0] >= 2]
    # closed rectangles: holes of the grid with the lines around them, and parts of it whose outline is a full rectangle
    grid = across | down
    holes = components(~grid, diagonal=False)[1]
    inner = holes[(holes[:, 1] > 0) & (holes[:, 2] > 0) & (holes[:, 3] < h) & (holes[:, 4] < w)]
    tall, wide = inner[:, 3] - inner[:, 1], inner[:, 4] - inner[:, 2]
    filled = inner[:, 0] > 0.95 * tall * wide
    boxes = np.stack([tall[filled] + 2, wide[filled] + 2], axis=1)
    label, parts = components(grid)
    framed = [(d - a, e - b) for k, (_, a, b, d, e) in enumerate(parts, 1) if all((x == k).all() for x in (label[a, b:e], label[d - 1, b:e], label[a:d, b], label[a:d, e - 1]))]
    boxes = np.concatenate([boxes, np.array(framed, np.int64).reshape(-1, 2)])
    share = boxes[:, 0] * boxes[:, 1] / (h * w)
    boxes, share = boxes[(share >= 0.0005) & (share <= 0.9)], share[(share >= 0.0005) & (share <= 0.9)]
    area = float(min(share.sum(), 1.0))
    core = grey[round(h * 0.05) : round(h * 0.95), round(w * 0.04) : round(w * 0.96)]
    ink = core <= 225
    gy, gx = np.gradient(core)
    spots = components(ink)[1]
    return {
        "horizontal_lines": len(lines[0]), "vertical_lines": len(lines[1]), "intersections": len(crossings), "closed_regions": len(boxes), "boxes": int(((boxes[:, 1] >= 0.04 * w) & (boxes[:, 0] >= 0.025 * h)).sum()), "area": area,
        "ink": float(ink.mean()), "edges": float((np.hypot(gx, gy) > 40).mean()), "components": int((spots[:, 0] >= max(8, round(2e-5 * core.size))).sum()),
    }


def metrics(height: Column, width: Column, data: Column) -> Column:
    """Counts of an image given as raw RGB bytes; null for a null or ill-sized image."""

    @F.arrow_udf(METRICS)
    def run(heights: pa.Array, widths: pa.Array, pixels: pa.Array) -> pa.Array:
        out = []
        for h, w, raw in zip(heights.to_pylist(), widths.to_pylist(), pixels):
            raw = raw.as_py()
            out.append(None if raw is None or not h or not w or len(raw) != h * w * 3 else measure(np.frombuffer(raw, np.uint8).reshape(h, w, 3)))
        kinds = [(k, pa.float64() if k in ("area", "ink", "edges") else pa.int32()) for k in ("horizontal_lines", "vertical_lines", "intersections", "closed_regions", "boxes", "area", "ink", "edges", "components")]
        return pa.array(out, pa.struct(kinds))

    return run(height, width, data)
