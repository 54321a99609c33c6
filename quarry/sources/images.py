"""Page images before their text is recognised: gray levels, contrast and threshold, regions of dense edges, and which are worth reading."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

REGION = "array<struct<x:int,y:int,w:int,h:int,read:boolean>>"
#: Regions of an image at most: the largest.
MOST = 12
_LUMA = (0.299, 0.587, 0.114)


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    return _LUMA[0] * r + _LUMA[1] * g + _LUMA[2] * b


def binarized(rgb: np.ndarray, contrast: float = 1.2, threshold: float = 180) -> np.ndarray:
    """Gray levels with a linear contrast around 128, black below the threshold and white from it on."""
    stretched = np.clip((luma(rgb) - 128) * contrast + 128, 0, 255)
    return np.where(stretched >= threshold, 255, 0).astype(np.uint8)


def parts(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The 4-connected parts of a mask in the order of their first cells by row: x, y, w, h and number of cells.

    Two passes: runs of a row that touch runs of the row above are joined (union-find, the earlier run stays the root);
    then each root sums its runs up. Work grows with the number of runs, not with that of cells times a part's extent.
    """
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    rows, starts = np.nonzero(step == 1)
    stops = np.nonzero(step == -1)[1]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    s, e = starts.tolist(), stops.tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if s[i] < e[j] and s[j] < e[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if e[i] <= e[j]:
                i += 1
            else:
                j += 1
    boxes: dict[int, list[int]] = {}
    for i, y in enumerate(rows.tolist()):
        box = boxes.setdefault(root(i), [s[i], y, e[i], y + 1, 0])
        box[0], box[2], box[3] = min(box[0], s[i]), max(box[2], e[i]), y + 1
        box[4] += e[i] - s[i]
    return [(x, y, right - x, bottom - y, n) for x, y, right, bottom, n in (boxes[k] for k in sorted(boxes))]


def merged(boxes: list[tuple[int, int, int, int]], gap: int = 4) -> list[tuple[int, int, int, int]]:
    """Each box goes into the first earlier one that is within gap of it, which grows; else it stays its own. One pass."""
    out = np.zeros((len(boxes), 4), np.int64)  # left, top, right, bottom
    n = 0
    for x, y, w, h in boxes:
        o = out[:n]
        near = np.flatnonzero((x <= o[:, 2] + gap) & (o[:, 0] <= x + w + gap) & (y <= o[:, 3] + gap) & (o[:, 1] <= y + h + gap))
        box = (x, y, x + w, y + h)
        if len(near):
            k = near[0]
            out[k] = [*np.minimum(out[k, :2], box[:2]), *np.maximum(out[k, 2:], box[2:])]
        else:
            out[n] = box
            n += 1
    return [(a, b, c - a, d - b) for a, b, c, d in out[:n].tolist()]


def text_regions(gray: np.ndarray, side: int = 256, edge: float = 40, least: int = 20, gap: int = 4, most: int = MOST) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of dense edges, the largest first.

    The image is sampled down to side; a sample is an edge if its pixel differs from those right of and below it by more than edge in
    all. Parts of least samples are merged and scaled back; boxes under 3 % of the width or 2 % of the height, over 95 % or
    half of it, or that reach into the last 12 % are left out.
    """
    height, width = gray.shape
    scale = max(1.0, max(width, height) / side)
    xs = np.minimum(width - 1, np.floor(np.arange(max(16, math.floor(width / scale))) * scale).astype(int))
    ys = np.minimum(height - 1, np.floor(np.arange(max(16, math.floor(height / scale))) * scale).astype(int))
    g = gray.astype(float)
    here = g[np.ix_(ys, xs)]
    change = np.abs(here - g[np.ix_(ys, np.minimum(width - 1, xs + 1))]) + np.abs(here - g[np.ix_(np.minimum(height - 1, ys + 1), xs)])
    boxes = merged([p[:4] for p in parts(change > edge) if p[4] >= least], gap)
    scaled = [(math.floor(x * scale), math.floor(y * scale), min(width, math.ceil(w * scale)), min(height, math.ceil(h * scale))) for x, y, w, h in boxes]
    kept = [b for b in scaled if width * 0.03 <= b[2] <= width * 0.95 and height * 0.02 <= b[3] <= height * 0.5 and b[1] + b[3] < height * 0.88]
    return sorted(kept, key=lambda b: -b[2] * b[3])[:most]


def readable(x: int, y: int, w: int, h: int, height: int) -> bool:
    """Whether a region is worth reading: not tiny, and not like a banner unless it is in the top quarter."""
    return w >= 60 and h >= 25 and not (w / max(1, h) > 25 and y >= height * 0.25)


def found(raw: bytes | None, width: int | None, height: int | None, preprocess: bool = True) -> list[dict] | None:
    """Text regions of an image (rows of red, green and blue bytes); None for a null or empty one, or one of another size than it says."""
    if raw is None or pd.isna(width) or pd.isna(height) or len(raw) != 3 * int(width) * int(height) or not len(raw):
        return None
    rgb = np.frombuffer(raw, np.uint8).reshape(int(height), int(width), 3)
    gray = binarized(rgb) if preprocess else luma(rgb)
    return [{"x": x, "y": y, "w": w, "h": h, "read": readable(x, y, w, h, int(height))} for x, y, w, h in text_regions(gray)]


def black(raw: bytes | None) -> int | None:
    """Black pixels of an image after preprocessing."""
    return None if raw is None else int((binarized(np.frombuffer(raw, np.uint8).reshape(-1, 3)) == 0).sum())


def regions(pixels: Column, width: Column, height: Column, preprocess: bool = True) -> Column:
    """found() of images that are a column, in Arrow batches."""

    def find(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([found(*x, preprocess) for x in zip(p, w, h, strict=True)])

    return pandas_udf(find, REGION)(pixels, width, height)


def gray_counts(pixels: Column) -> Column:
    """black() of images that are a column, in Arrow batches."""

    def count(p: pd.Series) -> pd.Series:
        return pd.Series([black(raw) for raw in p], dtype="Int64")

    return pandas_udf(count, "long")(pixels)


def measured(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], measure: Callable[[bytes], object], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the images that make gives for keys, a few at once, are measured where they are made. So pixels, a
    thousand times as large as their keys, go neither to the JVM nor into an Arrow batch of as many rows as there are keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(batches):
            yield pa.record_batch([batch.column(0), pa.array([measure(p.as_py()) for p in batch.column(1)], kind)], names=["key", "measure"])

    return run
