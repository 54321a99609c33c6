"""Exact Jaccard self-join of word shingles by parity sketches, and its connected components.

A document's set is that of its distinct SIZE-word shingles (bytes, A-Z lower-cased, words parted by ASCII white
space). Two sets within similarity t differ by D = (1 - t) / (1 + t) * (|A| + |B|) shingles at most.

Sketch: every shingle toggles one bit of a wide virtual bit vector, cut into m segments; the XOR of two sketches is
the sketch of the symmetric difference, so its Hamming weight, and the number of segments that differ, can't exceed D.
Only the segments' XOR hashes are kept (a segment's bits, each by a random 64-bit word, XORed). m is D + 1 + E for the
band of sizes: at least one segment of a linked pair is equal and, as a text has more than E empty segments very
rarely (then it sends those too), at least one that isn't empty. Bands are 1/t wide; a text sends its own band's
segments and those of the band below, where a smaller partner may stand.

Plan: exact copies of a set are one class first, by partial aggregation; a task sends the segments of a set once.
Rows (segment key, doc_id) are the one large shuffle. Keys with the same rows, as copies have by the hundred, become
one. What follows finds families, sets that may be linked, and then verifies inside each family:

1. Two sets are close if sizes and parity sketches, of one bit or more a shingle, don't rule a link out. Up to four stars a row
   (the row and a key's smallest id) are compared by joins; their components collapse groups of copies in linear work.
2. Keys whose rows are still in different components are compared in runs, inside tasks. A run gives a spanning forest
   of its close pairs, fewer edges than rows, so the components of both are exactly those of all close pairs: families.
3. Each set goes once to its family, and a run gives a spanning forest of the links, verified on whole sets. Components
   of these are the result. A family above FAMILY_ROWS rows or FAMILY_ITEMS shingles first verifies its stars by a
   join that adaptive execution can split, so that only what they leave apart goes to runs.

Runs are bounded: a key's or family's largest component and the other rows, its stragglers, are cut into blocks, and a
run holds two blocks. Rows of one component are never compared, so a row of the largest component goes to each block
of stragglers and a straggler to all blocks: with at most one block of stragglers, about two times the rows in all.
Where more rows share a key, or a family, without linking, both the comparisons and, divided by the block size, the rows
sent grow with their square; that is the price of an exact answer there. No pair is emitted but forest edges.
Sketches are computed for texts in candidates, and sets for those in families, each told by a fixed-size bitmap.
Intermediate tables are written to the shared folder.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component;
a text with fewer words than SIZE has the whole sequence as one shingle; repeated rows are returned each; rows that
share a doc_id are one node; a row whose doc_id is null links with nothing (null component); an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, prepare, stored, temporary, texts

_PRIME = 0x9E3779B97F4A7C15 | 1
_BYTES = mix64(np.arange(256, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WHITE = re.compile(rb"[\t-\r ]")
_PIECE = 500_000
BITMAP_BITS = 1 << 24
SKETCH_BITS = 512
#: Rows of a block of a key's run; rows and shingles of a block of a family.
BLOCK = 2048
FAMILY_ROWS = 2048
FAMILY_ITEMS = 1 << 20
#: Nodes whose edges a task contracts at once.
CONTRACT = 500_000


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.r_[np.uint64(1), np.full(size, _PRIME, dtype=np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(_PRIME, -1, 1 << 64), dtype=np.uint64)])
    return up, down


@cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    """For pieces of the usual size; those of a longer single word aren't kept."""
    return _powers(2 * _PIECE)


def _word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a block that begins and ends with white space."""
    x = np.frombuffer(block, np.uint8)
    up, down = _usual_powers() if len(x) <= 2 * _PIECE else _powers(len(x))
    space = _SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    total = np.cumsum(_BYTES[x] * up[: len(x)])
    return mix64((total[ends - 1] - total[starts - 1]) * down[starts]), starts


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of a long text, in pieces that end at white space, so that memory follows the words, not the bytes."""
    out, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        found = _WHITE.search(raw, end) if end < len(raw) else None
        end = found.start() if found else len(raw)
        out.append(_word_hashes(b"\n" + raw[at:end] + b"\n")[0])
        at = end
    return np.concatenate(out)


def shingle_sets(texts_: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; words and shingles of a batch are hashed at once."""
    out: list[np.ndarray] = []
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts_]
    i = 0
    while i < len(raws):
        j, n = i, 0
        while j < len(raws) and (j == i or n + len(raws[j]) < _PIECE):
            n += len(raws[j]) + 1
            j += 1
        if n > _PIECE:
            words = _long_words(raws[i])
            at = np.array([0, len(words)])
        else:
            words, starts = _word_hashes(b"\n" + b"\n".join(raws[i:j]) + b"\n")
            at = np.r_[0, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws[i:j]]), "right")]
        out += _sets(words, at, size)
        i = j
    return out


def _sets(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The sets of texts whose words stand between the bounds in at."""
    weight = [np.uint64(w) for w in mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)]
    n = len(words) - size + 1
    rows = mix64(sum((words[k : k + n] * weight[k] for k in range(1, size)), words[:n] * weight[0])) if n > 0 else words[:0]
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rows[a : b - size + 1]))
        elif b > a:
            whole = sum((words[a + k : a + k + 1] * weight[k] for k in range(b - a)), np.zeros(1, dtype=np.uint64))
            out.append(mix64(whole ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


class Bands:
    """Size bands of a similarity num / den, and the segments of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            e = self.edges[-1]
            self.edges.append(max(e + 1, -(-e * self.den // self.num)))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    @cache  # noqa: B019
    def segments(self, band: int) -> tuple[int, int]:
        """(segments, empty ones that a text may have without sending them); (0, 0) where only equal sets link."""
        self.band(self.edges[-1]) if band + 1 >= len(self.edges) else None
        low, high = self.edges[band], self.edges[band + 1] - 1
        most = (self.den - self.num) * (high + high * self.den // self.num) // (self.den + self.num)
        if most == 0:
            return 0, 0
        spare = 1
        while True:
            m = most + 1 + spare
            empty = m * math.exp(-low / m)
            need = math.ceil(empty + 3 * math.sqrt(empty))
            if need <= spare or spare > 4 * most:
                return m, spare
            spare = need


def segment_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys of a set: of its own band, and of the band below as the larger partner."""
    if not len(s):
        return s[:0]
    own, out = bands.band(len(s)), []
    for band in (own, own - 1):
        if band < 0:
            continue
        m, spare = bands.segments(band)
        if not m:
            continue
        seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        order = np.argsort(seg, kind="stable")
        where, first = np.unique(seg[order], return_index=True)
        keys = np.bitwise_xor.reduceat(mix64(s[order] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        if m - len(where) > spare:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), where)
            where, keys = np.r_[where, empty], np.r_[keys, np.zeros(len(empty), dtype=np.uint64)]
        out.append(mix64(keys ^ mix64(where + np.uint64(band << 32))))
    return np.concatenate(out) if out else s[:0]


def _classes(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "set_key"])

    return run


def _segments(size: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            ids, keys = [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), size), strict=True):
                mark = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                if mark in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(mark)
                k = segment_keys(s, bands)
                keys.append(k)
                ids.append(np.full(len(k), doc_id, dtype=np.int64))
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "doc_id"])

    return run


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch, in 64-bit words: every element toggles one bit of at least SKETCH_BITS and one an element."""
    bits = max(SKETCH_BITS, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A sketch of fewer bits from one of more: halves are XORed, as the low bits of an element choose its bit."""
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def stacked(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows of a matrix, all of the length of the shortest."""
    n = min(map(len, sketches))
    return np.stack([folded(x, n) for x in sketches])


def forest(comps: np.ndarray, sides: np.ndarray | None, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the components comps of rows: near(i, others) tells which others row i joins.

    Rows of one component are joined already; with sides, only rows of different sides are compared. Each row that
    isn't in the largest component is compared, at once, with those rows after it, or in the largest, that it isn't
    joined with yet: one real pass where all rows join the first, a pass a row where none does.
    """
    edges: list[tuple[int, int]] = []
    names, comp, rows = np.unique(comps, return_inverse=True, return_counts=True)
    ahead, left = np.ones(len(comps), dtype=bool), len(names)
    for i in np.flatnonzero(comp != np.argmax(rows)):
        if left == 1:
            break
        ahead[i] = False
        others = np.flatnonzero(ahead & (comp != comp[i]) if sides is None else ahead & (comp != comp[i]) & (sides != sides[i]))
        others = others[near(i, others)] if len(others) else others
        if len(others):
            reached, first = np.unique(comp[others], return_index=True)
            edges += [(int(i), int(others[k])) for k in first]
            comp[np.isin(comp, reached)] = comp[i]
            left -= len(reached)
    return edges


def _possible(i: int, others: np.ndarray, sizes: np.ndarray, bits: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which others sizes and sketches let link with row i."""
    low, high = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
    apart = np.bitwise_count(bits[i] ^ bits[others]).sum(axis=1, dtype=np.int64)
    return (den * low >= num * high) & (apart * (den + num) <= (den - num) * (low + high))


def close_edges(comps: np.ndarray, sides: np.ndarray | None, sizes: np.ndarray, bits: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sketches (rows of 64-bit words) don't rule out."""
    return forest(comps, sides, lambda i, others: _possible(i, others, sizes, bits, num, den))


def link_edges(comps: np.ndarray, sides: np.ndarray | None, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets have den * |A & B| >= num * |A or B|."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, mark = ids.astype(np.int32), np.zeros(len(distinct), dtype=bool)
    bits = stacked([sketch(s) for s in sets])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        ok = _possible(i, others, sizes, bits, num, den)
        if ok.any():
            some = others[ok]
            mark[own := ids[starts[i] : starts[i + 1]]] = True
            hit = mark[np.concatenate([ids[starts[k] : starts[k + 1]] for k in some])]
            mark[own] = False
            both = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
            ok[ok] = den * both >= num * (sizes[i] + sizes[some] - both)
        return ok

    return forest(comps, sides, near)


def _split(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column of array<long>, as 64-bit words."""
    lists = lists.combine_chunks()
    return np.split(lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _in_runs(found: Callable[[pa.Table, np.ndarray, np.ndarray | None], list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (key, lo, hi): the edges (a < b) that found(rows, comps, sides) gives of each run; one run in memory at a time."""

    def edges(t: pa.Table) -> set[tuple[int, int]]:
        node, comps, block = (t.column(n).to_numpy() for n in ("node", "c", "block"))
        whole = t.column("lo")[0] == t.column("hi")[0]
        pairs = [(int(node[i]), int(node[k])) for i, k in found(t, comps, None if whole else block)]
        return {(min(p), max(p)) for p in pairs if p[0] != p[1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            group = np.stack([t.column(n).to_numpy() for n in ("key", "lo", "hi")])
            starts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            out: set[tuple[int, int]] = set()
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), t.num_rows], strict=True):
                this = tuple(group[:, a].tolist())
                if held and this != last:
                    out |= edges(pa.concat_tables(held).combine_chunks())
                    held = []
                held.append(t.slice(a, b - a))
                last = this
            if out:
                yield pairs(out)
        if held and (out := edges(pa.concat_tables(held).combine_chunks())):
            yield pairs(out)

    def pairs(out: set[tuple[int, int]]) -> pa.RecordBatch:
        p = np.array(sorted(out), dtype=np.int64)
        return pa.record_batch([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return run


def _close(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of close pairs in runs of (node, c, block, n, sketch)."""

    def found(t: pa.Table, comps: np.ndarray, sides: np.ndarray | None) -> list[tuple[int, int]]:
        return close_edges(comps, sides, t.column("n").to_numpy(), stacked(_split(t.column("sketch"))), num, den)

    return _in_runs(found)


def _linked(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of links in runs of (node, c, block, items)."""

    def found(t: pa.Table, comps: np.ndarray, sides: np.ndarray | None) -> list[tuple[int, int]]:
        return link_edges(comps, sides, _split(t.column("items")), num, den)

    return _in_runs(found)


def _blocks(placed: DataFrame, rows: int, items: int | None = None) -> DataFrame:
    """Of rows (key, node, c), or (key, node, c, n) with items, what runs compare: (key, node, c, block, lo, hi).

    The largest component of a key is cut into blocks -1, -2, ... and the other rows, its stragglers, into 0, 1, ...;
    a run is a block of stragglers with itself, another one, or one of the largest component. Keys in one component go.
    """
    load = F.count("*") if items is None else F.greatest(F.count("*").cast("double"), F.sum("n") * (rows / items))
    parts = placed.groupBy("key", "c").agg(load.alias("load"))
    keys = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("load", "c")).alias("most"), F.max("load").alias("large"), F.sum("load").alias("all"))
    cut = lambda x: F.greatest(F.ceil(x / rows), F.lit(1)).cast("int")
    keys = keys.filter("parts > 1").select("key", "most", cut(F.col("large")).alias("n_large"), cut(F.col("all") - F.col("large")).alias("n_other"))
    at = F.xxhash64("node")
    block = F.when(F.col("c") == F.col("most"), -1 - F.pmod(at, F.col("n_large"))).otherwise(F.pmod(at, F.col("n_other"))).cast("int")
    others = F.sequence(F.when(F.col("block") < 0, F.lit(0)).otherwise(-F.col("n_large")), F.col("n_other") - 1)
    out = placed.select("key", "node", "c").join(keys, "key").withColumn("block", block).withColumn("other", F.explode(others))
    return out.select("key", "node", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _sets_of(size: int, bitmap: bytes, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the texts whose id is in the bitmap, the whole sets or their sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            at = mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(BITMAP_BITS - 1)
            keep = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            if not len(keep):
                continue
            part = batch.take(pa.array(keep))
            sets = shingle_sets(part.column(1).to_pylist(), size)
            some = np.flatnonzero([len(s) for s in sets])
            part, sets = part.take(pa.array(some)), [sets[k] for k in some]
            longs = pa.list_(pa.int64())
            if whole:
                yield pa.record_batch([part.column(0), pa.array([s.view(np.int64) for s in sets], longs)], names=["node", "items"])
            else:
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.record_batch([part.column(0), n, pa.array([sketch(s).view(np.int64) for s in sets], longs)], names=["node", "n", "sketch"])

    return run


def _marks(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, n, sketch) of nodes, and of the few others whose bit is the same."""
    return stored(rows.mapInArrow(_sets_of(size, _bitmap(nodes), False), "node long, n long, sketch array<long>").distinct(), "marks")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.record_batch([pa.array((mix64(ids.view(np.uint64)) & np.uint64(BITMAP_BITS - 1)).astype(np.int64))], names=["bit"])


def _bitmap(ids: DataFrame) -> bytes:
    """A fixed-size bitmap of ids (2 MB, whatever their number), from Spark's bitmap aggregates in words of 4 KB."""
    word = 32768
    words = ids.mapInArrow(_bits, "bit long").groupBy(F.floor(F.col("bit") / word).alias("word")).agg(F.bitmap_construct_agg(F.col("bit") % word).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for row in words.collect():
        out[row["word"] * word // 8 : (row["word"] + 1) * word // 8] = row["bits"]
    return bytes(out)


def _plausible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a < b) that sizes and sketches don't rule out. Of two lengths the double is folded; others tell nothing."""
    side = lambda x: marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    full = pairs.join(side("a"), "a").join(side("b"), "b").filter(den * small >= num * large)
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    at = lambda x, k: F.slice(x, F.lit(1) + k, F.greatest(F.size(x) / 2, F.lit(1)).cast("int"))
    fold = lambda x: xor(at(x, F.lit(0)), at(x, (F.size(x) / 2).cast("int")))
    sa, sb = F.col("sa"), F.col("sb")
    x = F.when(F.size(sa) == F.size(sb), xor(sa, sb)).when(F.size(sa) == 2 * F.size(sb), xor(fold(sa), sb)).when(2 * F.size(sa) == F.size(sb), xor(sa, fold(sb)))
    apart = F.aggregate(F.coalesce(x, F.array().cast("array<long>")), F.lit(0), lambda t, k: t + F.bit_count(k))
    return full.filter(apart * (den + num) <= (den - num) * (small + large)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a < b) whose sets, of (node, items), have den * |A & B| >= num * |A or B|."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    full = pairs.join(left, "a").join(right, "b")
    return full.filter(den * both >= num * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, CONTRACT at a time, as stars around the smallest node that they join: at most as many edges."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up[x]
        return top

    def stars() -> pa.RecordBatch:
        nodes = [x for x in up if root(x) != x]
        return pa.record_batch([pa.array([up[x] for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        if len(up) >= CONTRACT:
            yield stars()
            up.clear()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): component is the smallest node reachable. Edges are contracted inside tasks;
    then rounds in which nodes, and the nodes that they point to, take the smallest label of their neighbours, and labels
    jump: about the logarithm of the longest path; each round is written, nothing is collected but a count."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contracted, "a long, b long")
    both = stored(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        hooked = least.filter("c < old").select(F.col("old").alias("node"), "c").groupBy("node").agg(F.min("c").alias("hook"))
        least = least.join(hooked, "node", "left").select("node", "old", F.least("c", F.coalesce("hook", "c")).alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        moved = stored(least.join(jump, "c").select("node", "old", F.least("c", "far").alias("component")), "labels")
        labels = moved.select("node", "component")
        if not moved.filter("old <> component").limit(1).count():
            return labels


def _hits(rows: DataFrame, known: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, a): nodes that share a segment with a smaller one, and the smallest, keys with equal rows being one;
    and edges (a, b) of ids that have several texts."""
    named = stored(known.join(classes, "set_key").select("doc_id", "node").distinct(), "named")
    ids = named.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    same_id = named.join(ids.filter("node <> last").select("doc_id"), "doc_id").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    keyed = rows.mapInArrow(_segments(size, num, den), "key long, doc_id long")
    same = Window.partitionBy("key")
    members = F.xxhash64(F.count("*").over(same), F.bit_xor(F.xxhash64("doc_id")).over(same))
    hits = keyed.select("doc_id", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi"), members.alias("members")).filter("lo < hi")
    hits = stored(hits.select(F.xxhash64("lo", "hi", "members").alias("key"), "doc_id").distinct(), "hits")
    alias = ids.filter("node = last and doc_id <> node").select("doc_id", "node")
    hits = stored(hits.join(alias, "doc_id", "left").select("key", F.coalesce("node", "doc_id").alias("node")).distinct(), "members")
    first = hits.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("key", "a")
    return stored(hits.join(first, "key"), "hits"), stored(same_id, "named")


def _families(hits: DataFrame, rows: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, family), the components of all close pairs; the close stars (a, b); and (node, n, sketch)."""
    marks = _marks(rows, hits.select("node"), size)
    # Of a row's stars four are tried; the runs compare what they leave apart.
    some = F.array_distinct(F.array(F.min("a"), F.max("a"), F.min_by("a", F.xxhash64("a")), F.max_by("a", F.xxhash64("a", "b"))))
    tried = hits.filter("node <> a").select("a", F.col("node").alias("b")).groupBy("b").agg(some.alias("a")).select(F.explode("a").alias("a"), "b")
    stars = stored(_plausible(tried, marks, num, den), "stars")
    family = components(stars)
    placed = stored(hits.join(family, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "placed")
    runs = _blocks(placed, BLOCK).join(marks, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    close = stored(runs.mapInArrow(_close(num, den), "a long, b long").distinct(), "close")
    if close.limit(1).count():
        family = components(stars.union(close))
    return family.select("node", F.col("component").alias("family")), stars, marks


def _links(family: DataFrame, stars: DataFrame, marks: DataFrame, rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join what all links join: spanning forests within the families, and the stars of large ones."""
    whole = stored(rows.mapInArrow(_sets_of(size, _bitmap(family.select("node")), True), "node long, items array<long>"), "items")
    sized = stored(family.join(marks.groupBy("node").agg(F.sum("n").alias("n")), "node").select(F.col("family").alias("key"), "node", "n"), "families")
    large = sized.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("items")).filter((F.col("rows") > FAMILY_ROWS) | (F.col("items") > FAMILY_ITEMS)).select("key")
    tried = sized.join(large, "key", "left_semi").select(F.col("node").alias("b")).join(stars, "b").select("a", "b")
    sure = stored(_verified(tried, whole, num, den), "links")
    label = components(sure)
    placed = sized.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"), "n")
    runs = _blocks(stored(placed, "placed"), FAMILY_ROWS, FAMILY_ITEMS).join(whole, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return sure.union(stored(runs.mapInArrow(_linked(num, den), "a long, b long").distinct(), "links"))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id; links are pairs with similarity num / den or more."""
    spark = prepare(docs.sparkSession)
    rows = texts(docs)
    listed = stored(rows.mapInArrow(_classes(size), "doc_id long, n_shingles long, set_key binary"), "sets", keep=True)
    known = listed.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull()).select("doc_id", "set_key")
    rows = rows.filter("doc_id is not null")
    with temporary(spark):
        classes = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
        hits, same_id = _hits(rows, known, classes, size, num, den)
        family, stars, marks = _families(hits, rows, size, num, den)
        links = _links(family, stars, marks, rows, size, num, den)
        label = components(links.union(same_id))
        named = classes.join(label, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
        named = stored(named, "named", keep=True)
    out = listed.join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, that are the smallest doc_id of their component; null ids stay."""
    gone = near_duplicates(docs, size, num, den).filter("component_id <> doc_id").select("doc_id").distinct()
    key = "__doc_id"
    gone = gone.withColumnRenamed("doc_id", key)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")
