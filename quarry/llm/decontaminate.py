"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are lower-cased and their white space collapsed; items longer than WINDOW characters are
taken in windows that start every STRIDE characters, the last flush with the end, so that any excerpt of
WINDOW + STRIDE - 1 characters holds a whole window. A document is a leak if it holds one window of an item, within
k = EDITS * L edits of its length L. Such a region shares at least L - Q + 1 - k * Q of the window's q-grams, on
diagonals that differ by k at most. Shared q-grams are counted per item in bands of diagonals, 2 (k + 1) wide and
overlapping by half, so that one band holds every such region's; in bands that reach the bound they are counted per
window, and windows that reach it are verified by banded alignment. All q-grams of a batch of texts are hashed at once;
a fixed-size bit table drops nearly all that no item has, before the exact look-up. Items with fewer than SHORTEST
characters are too short for edits and are looked up exactly, as whole words in scripts that have letter case.

The benchmark is the query set: it goes to the executors in blocks of about BLOCK_CHARS characters, whose number
follows its size; each block is one pass over the documents, without a shuffle.

Defined results: a null or empty text, and a null or empty item, match nothing; equal items are all reported; items of a
block that share an id, or have none, are one item with the windows of all; repeated rows are reported each; a null doc_id or item_id stays null; empty
tables give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import mix64, prepare, texts

Q = 7
EDITS = 0.12
WINDOW, STRIDE, SHORTEST = 80, 20, 32
BLOCK_CHARS = 2_000_000
_TABLE_BITS = 22
_HITS = 4_000_000
_PRIME = 0x9E3779B97F4A7C15 | 1


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams of x, by doubling: a hash of a + b elements from those of a and of b."""
    p = lambda n: np.uint64(pow(_PRIME, n, 1 << 64))
    size, part = 1, mix64(x.astype(np.uint64))
    whole, done = None, 0
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    while True:
        if q & size:
            whole = part if whole is None else part[: len(part) - done] * p(done) + whole[size : size + len(part) - done]
            done += size
        if done == q:
            return whole[:n]
        part = part[: len(part) - size] * p(size) + part[size:]
        size *= 2


def window_starts(size: int) -> list[int]:
    """Starts of the windows of a text of size characters: every STRIDE characters, the last flush with the end."""
    return [0] if size <= WINDOW else [*range(0, size - WINDOW, STRIDE), size - WINDOW]


def alignment(pattern: np.ndarray, region: np.ndarray, lead: int, width: int) -> tuple[int, int]:
    """(edits, end) of the cheapest alignment of pattern with a part of region, on the width diagonals from -lead.

    Cell b of row i stands for the region's position i + b - lead; a row needs a few vector operations.
    """
    far = 1 << 20
    at = np.arange(width) - lead
    row = np.where((at >= 0) & (at <= len(region)), 0, far)
    step = np.arange(width)
    padded = np.concatenate([np.zeros(lead + 1, dtype=region.dtype), region, np.zeros(width + len(pattern) + 1, dtype=region.dtype)])
    for i, c in enumerate(pattern, 1):
        same = padded[i : i + width] == c  # region[i + b - lead - 1]
        j = at + i
        inside = (j >= 1) & (j <= len(region))
        diagonal = np.where(inside, row + ~same, far)
        down = np.append(row[1:], far) + 1
        new = np.where((j >= 0) & (j <= len(region)), np.minimum(diagonal, down), far)
        row = np.minimum.accumulate(new - step) + step
        row = np.where((j >= 0) & (j <= len(region)), row, far)
    b = int(row.argmin())
    return int(row[b]), len(pattern) + b - lead


@dataclass
class Index:
    """The q-grams of a block of benchmark items, by hash, and their windows."""

    #: Per window: the place of its item's id in names, characters, edits.
    items: np.ndarray
    names: list[int | None]
    patterns: list[np.ndarray]
    edits: np.ndarray
    #: Per entry, an item of SHORTEST characters or more: edits and bound of its windows, its first window, their starts.
    entry_edits: np.ndarray
    bound: np.ndarray
    first: list[int]
    starts: list[np.ndarray]
    reach: int
    #: Distinct q-gram hashes, and for each a run of (entry, position) in it.
    hashes: np.ndarray
    run: np.ndarray
    entry: np.ndarray
    position: np.ndarray
    table: np.ndarray
    #: Items below SHORTEST: hashes and windows by length.
    short: dict[int, tuple[np.ndarray, list[int]]]

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]], edits: float = EDITS) -> Index:
        names: dict[int | None, int] = {}
        ids, patterns, ks, entry_ks, bounds, first, starts, hs, es, ps = [], [], [], [], [], [], [], [], [], []
        short: dict[int, list[int]] = {}
        reach = 0
        for item_id, text in items:
            item = names.setdefault(item_id, len(names))
            x = codes(normal(text or ""))
            if not len(x):
                continue
            if len(x) < SHORTEST:
                short.setdefault(len(x), []).append(len(ids))
                ids.append(item)
                patterns.append(x)
                ks.append(0)
                continue
            at = window_starts(len(x))
            size = min(len(x), WINDOW)
            n = size - Q + 1
            k = min(int(edits * size), (n - 1) // Q)
            h = qgrams(x)
            first.append(len(ids))
            starts.append(np.array(at))
            entry_ks.append(k)
            bounds.append(n - k * Q)
            hs.append(h)
            es.append(np.full(len(h), len(first) - 1))
            ps.append(np.arange(len(h)))
            reach = max(reach, len(x))
            for s in at:
                ids.append(item)
                patterns.append(x[s : s + size])
                ks.append(k)
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        h, e, p = cat(hs, np.uint64), cat(es, np.int64), cat(ps, np.int64)
        order = np.argsort(h, kind="stable")
        distinct, counts = np.unique(h, return_counts=True)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        whole = {n: (np.concatenate([qgrams(patterns[w], n) for w in ws]), ws) for n, ws in short.items()}
        ints = lambda v: np.array(v, dtype=np.int64)
        return cls(ints(ids), list(names), patterns, ints(ks), ints(entry_ks), ints(bounds), first, starts, reach, distinct, np.r_[0, np.cumsum(counts)], e[order], p[order], table, whole)

    def matches(self, texts_: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, window, edits, start in the normalised text) of the windows that each text holds."""
        clean = [normal(t) for t in texts_]
        x = codes("\0".join(clean))
        lengths = np.array([len(c) + 1 for c in clean], dtype=np.int64)
        out = self._exact(clean, x, lengths)
        h = qgrams(x)
        if not len(h) or not len(self.hashes):
            return sorted(out)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        h = h[at]
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[slot] == h
        at, slot = at[same], slot[same]
        lo = self.run[slot]
        n = self.run[slot + 1] - lo
        if not len(at):
            return sorted(out)
        ends = np.cumsum(n)
        if ends[-1] > _HITS and len(texts_) > 1:  # bounds memory; texts stay whole
            half = len(texts_) // 2
            return self.matches(texts_[:half]) + [(t + half, *m) for t, *m in self.matches(texts_[half:])]
        post = np.arange(ends[-1]) - np.repeat(ends - n - lo, n)
        e, p, d = self.entry[post], self.position[post], np.repeat(at, n)
        diagonal = d - p + self.reach  # not negative
        step = self.entry_edits[e] + 1
        offsets = np.cumsum(lengths) - lengths
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for half in (0, 1):
            band = (diagonal + half * step) // (2 * step)
            some = _crowded(e, band, p, self.bound[e])
            if not len(some):
                continue
            text_of = np.searchsorted(offsets, d[some], "right") - 1
            rows = np.unique(np.stack([text_of, e[some], band[some], p[some]]), axis=1)
            edges = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0), True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                t, entry, band_at = (int(v) for v in rows[:3, a])
                if b - a < self.bound[entry]:
                    continue
                k, places, starts = int(self.entry_edits[entry]), rows[3, a:b], self.starts[entry]
                size = len(self.patterns[self.first[entry]])
                shared = np.searchsorted(places, starts + (size - Q), "right") - np.searchsorted(places, starts)
                low = band_at * 2 * (k + 1) - half * (k + 1) - self.reach - int(offsets[t])
                for i in np.flatnonzero(shared >= self.bound[entry]).tolist():
                    found.setdefault((t, self.first[entry] + i), []).append((low + int(starts[i]), 2 * (k + 1)))
        for (t, win), bands in found.items():
            k, pattern = int(self.edits[win]), self.patterns[win]
            best = None
            for low, wide in bands:
                a, b = max(0, low - k), min(len(clean[t]), low + wide + k + len(pattern))
                region = x[offsets[t] + a : offsets[t] + b]
                exact = region.tobytes().find(pattern.tobytes())
                if exact >= 0 and exact % 4 == 0:
                    best = (0, a + exact // 4)
                    break
                lead = max(0, a - (low - k))
                edits, end = alignment(pattern, region, lead, wide + 2 * k + 1 + lead)
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, max(0, a + end - len(pattern)))
            if best:
                out.append((t, win, *best))
        return sorted(out)

    def _exact(self, clean: list[str], x: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int, int]]:
        """As matches(), of the items below SHORTEST: their first occurrences."""
        offsets = np.cumsum(lengths) - lengths
        found: dict[tuple[int, int], int] = {}
        for size, (hashes, wins) in self.short.items():
            h = qgrams(x, size)
            for at in np.flatnonzero(np.isin(h, hashes)).tolist():
                t = int(np.searchsorted(offsets, at, "right")) - 1
                start = at - int(offsets[t])
                text, end = clean[t], start + size
                if end > len(text) or _joined(text, start) or _joined(text, end):
                    continue
                for win in (w for w, other in zip(wins, hashes, strict=True) if other == h[at]):
                    if (t, win) not in found and (self.patterns[win] == x[at : at + size]).all():
                        found[t, win] = start
        return [(t, win, 0, start) for (t, win), start in found.items()]


def _joined(text: str, at: int) -> bool:
    """Whether a word of a script with letter case, or a number, goes on across position at."""
    return 0 < at < len(text) and all(c.isdigit() or c.lower() != c.upper() for c in text[at - 1 : at + 1])


def _crowded(entry: np.ndarray, band: np.ndarray, position: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Members of each (entry, band) that has bound distinct positions or more: by counts per hash, then exactly."""
    bits = max(16, int(len(entry)).bit_length())
    pair = (entry.astype(np.uint64) << np.uint64(32)) + band.astype(np.uint64)
    key = pair * np.uint64(_PRIME)
    key = ((key ^ key >> np.uint64(32)) * np.uint64(_PRIME) >> np.uint64(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.bincount(key, minlength=1 << bits)[key] >= bound)
    if not len(some):
        return some
    pairs, which = np.unique(pair[some], return_inverse=True)
    distinct = np.unique(which * (int(position.max()) + 1) + position[some]) // (int(position.max()) + 1)
    return some[np.bincount(distinct, minlength=len(pairs))[which] >= bound[some]]


_OUT = "doc_id long, item_id long, windows_found int, windows_total int, edits int, start long"


def _find(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    total = dict(zip(*np.unique(index.items, return_counts=True), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, i = [], 0
            while i < len(texts_):  # a few MB at a time, whole texts
                j, size = i, 0
                while j < len(texts_) and (j == i or size + len(texts_[j]) <= 1_000_000):
                    size += len(texts_[j])
                    j += 1
                best: dict[tuple[int, int], list[int]] = {}
                for t, win, edits, start in index.matches(texts_[i:j]):
                    got = best.setdefault((t, int(index.items[win])), [0, edits, start])
                    got[0] += 1
                    got[1], got[2] = max(got[1], edits), min(got[2], start)
                rows += [(ids[i + t], index.names[item], n, int(total[item]), e, s) for (t, item), (n, e, s) in best.items()]
                i = j
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def blocks(benchmark: DataFrame, edits: float = EDITS) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // BLOCK_CHARS)
    part = F.pmod(F.xxhash64("text"), F.lit(max(n, 1)))
    for b in range(n):
        yield Index.build([tuple(r) for r in items.filter(part == b).orderBy("item_id", "text").collect()], edits)


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, windows_found, windows_total, edits, start): one row for each document and item it holds."""
    spark = prepare(docs.sparkSession)
    found = [texts(docs).mapInArrow(_find(index), _OUT) for index in blocks(benchmark, edits)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _OUT)


def _holder(index: Index) -> Callable[[pd.Series], pd.Series]:
    def holds(text: pd.Series) -> pd.Series:
        out, texts_, i = np.zeros(len(text), dtype=bool), text.tolist(), 0
        while i < len(texts_):
            j, size = i, 0
            while j < len(texts_) and (j == i or size + len(texts_[j]) <= 1_000_000):
                size += len(texts_[j])
                j += 1
            out[[i + m[0] for m in index.matches(texts_[i:j])]] = True
            i = j
        return pd.Series(out)

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    prepare(docs.sparkSession)
    for index in blocks(benchmark, edits):
        holds = pandas_udf(_holder(index), "boolean")
        docs = docs.filter(~holds(F.coalesce(F.col("text"), F.lit(""))))
    return docs
