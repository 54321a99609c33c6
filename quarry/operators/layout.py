"""The numbers of a page with the words near them, by a range join over a grid: of pages whose words are rows, or are an array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_boilerplate, is_numeric_value, judged_word, trimmed

#: Sides of a grid's cells. A number's label lies 120 to either side and some lines up and down.
CELL_X, CELL_Y = 160, 32
SIDE = 120
COLUMNS = ("text", "x", "y", "w", "h")
#: Words of pages that are joined in one go (a page of more by itself), and pairs of a number with a strip or a word at once.
WORDS, PAIRS = 200_000, 2_000_000


def word_rows(pages: DataFrame, key: str, words: str = "words") -> DataFrame:
    """A row a word: key, pos (its place in the page's array), text, x, y, w, h."""
    return pages.select(key, F.posexplode(words).alias("pos", "word")).select(key, "pos", *[F.col("word")[n].alias(n) for n in COLUMNS])


def _cells(low: Column, high: Column, side: int) -> Column:
    return F.sequence(F.floor(low / side), F.floor(high / side))


def metrics(words: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Per page the numeric words that have a label: key, pos, value, label, x, y.

    A label is made of the first most words (by x, then place) whose y is within 0.75 of the number's height and 8 of its own, and whose x
    is at most SIDE left of it or right of its end. Every other word has one cell of a grid; a number looks into the cells that its
    box touches. So a pair meets in one cell, and pages are dealt out by page and cell however many words they have. Words that can't
    be in a label are left out before the join. A page's numbers with equal value and label but for case are one: the first.

    Words whose place is null are near nothing; a page without numbers gives no row.
    """
    rows = words.select(key, "pos", *COLUMNS)
    numeric = rows.filter(is_numeric_value(F.col("text")))
    other = rows.select(key, F.col("pos").alias("at"), F.col("x").alias("wx"), F.col("y").alias("wy"), trimmed(F.col("text")).alias("t"))
    other = other.filter((F.col("t") != "") & ~is_numeric_value(F.col("t")) & ~is_boilerplate(F.col("t")))
    other = other.withColumn("cx", F.floor(F.col("wx") / CELL_X)).withColumn("cy", F.floor(F.col("wy") / CELL_Y))
    band = F.col("h") * 0.75 + 8
    box = numeric.withColumn("band", band).filter(F.col("band") >= 0).withColumn("right", F.col("x") + F.col("w") + SIDE).filter(F.col("right") >= F.col("x") - SIDE)
    box = box.withColumn("cx", F.explode(_cells(F.col("x") - SIDE, F.col("right"), CELL_X))).withColumn("cy", F.explode(_cells(F.col("y") - F.col("band"), F.col("y") + F.col("band"), CELL_Y)))
    near = box.join(other, [key, "cx", "cy"]).filter((F.abs(F.col("wy") - F.col("y")) <= F.col("band")) & (F.col("wx") >= F.col("x") - SIDE) & (F.col("wx") <= F.col("right")))
    # A number keeps most words of what it has met so far, so that no group is held whole.
    first = F.row_number().over(Window.partitionBy(key, "pos").orderBy("wx", "at"))
    some = near.withColumn("rank", first).filter(F.col("rank") <= most)
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda w: w["t"]), " ")
    labelled = some.groupBy(key, "pos").agg(F.first("text").alias("value"), label.alias("label"), F.first("x").alias("x"), F.first("y").alias("y"))
    same = [F.lower("value").alias("lv"), F.lower("label").alias("ll")]
    kept = labelled.groupBy(key, *same).agg(F.min(F.struct("pos", "value", "label", "x", "y")).alias("m"))
    return kept.select(key, "m.*")



def page_metrics(pages: DataFrame, key: str, words: str = "words", most: int = 10) -> DataFrame:
    """The rows of metrics() for pages whose words are an array: each row is a page of its own, so nothing is shuffled.

    Pages go to Python in Arrow batches as they are; each distinct word of a batch is judged once (judged_word), and its pages are joined
    at once (_near). Words whose place is null, NaN or infinite are near nothing.
    """
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, pos int, value string, label string, x double, y double"
    return pages.select(key, words).mapInArrow(_labelled(most), schema)


def _runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of counts that sum up to most at most, or of one."""
    upto, a = np.cumsum(counts), 0
    while a < len(counts):
        before = int(upto[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + most, "right")))
        yield a, b
        a = b


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, first[i] + k) for k below n[i]."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) + np.repeat(first - (np.cumsum(n) - n), n)


def _near(page: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, right: np.ndarray, band: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For words in order of pages, where n are the numbers: pairs of a number and one of the first most other words near it, in order.

    Other words are sorted by page, strip (CELL_Y high) and x. A number looks into the strips that its band touches; in each, the words
    between its ends are a range, found by bisection.
    """
    real = np.isfinite(x) & np.isfinite(y)
    num, lab = np.flatnonzero(n & real), np.flatnonzero(~n & real)
    nothing = np.zeros(0, np.int64)
    if not len(num) or not len(lab):
        return nothing, nothing
    lx, ly, nx, ny = x[lab], y[lab], x[num], y[num]
    # NaN counts as more than any number, as in Spark.
    right, band = (np.where(np.isnan(v), np.inf, v) for v in (right[num], band[num]))
    levels, level = np.unique(np.floor(ly / CELL_Y), return_inverse=True)
    strips, strip = np.unique(page[lab] * (len(levels) + 1) + level, return_inverse=True)
    xs, at = np.unique(lx, return_inverse=True)
    at = strip * (len(xs) + 1) + at
    by = np.argsort(at, kind="stable")
    at = at[by]
    rank, order = np.empty(len(lab), np.int64), np.lexsort((lx, page[lab]))
    rank[order] = np.arange(len(lab))
    slack = 1e-9 * (1 + np.abs(ny))  # of rounding; what isn't near is dropped below
    own = page[num] * (len(levels) + 1)
    low = np.searchsorted(strips, own + np.searchsorted(levels, np.floor((ny - band - slack) / CELL_Y), "left"))
    high = np.searchsorted(strips, own + np.searchsorted(levels, np.floor((ny + band + slack) / CELL_Y), "right"))
    left, end = np.searchsorted(xs, nx - SIDE, "left"), np.searchsorted(xs, right, "right")
    touched = np.where((band >= 0) & (left < end), np.maximum(high - low, 0), 0)
    found: list[tuple[np.ndarray, np.ndarray]] = [(nothing, nothing)]
    for a, b in _runs(touched, PAIRS):
        i, s = _spread(low[a:b], touched[a:b])
        s *= len(xs) + 1
        first, last = np.searchsorted(at, s + left[a:b][i]), np.searchsorted(at, s + end[a:b][i])
        each = np.bincount(i, last - first, b - a).astype(np.int64)
        for c, d in _runs(each, PAIRS):
            e, f = np.searchsorted(i, [c, d])
            k, w = _spread(first[e:f], (last - first)[e:f])
            k, w = a + i[e:f][k], by[w]
            close = np.abs(ly[w] - ny[k]) <= band[k]
            pairs = np.sort(k[close] * len(lab) + rank[w[close]])
            k, w = pairs // len(lab), pairs % len(lab)
            kept = np.arange(len(k)) - np.searchsorted(k, k) < most
            found.append((num[k[kept]], lab[order[w[kept]]]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _labelled(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(), WORDS):
                keys, pages = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                page, words = pc.list_parent_indices(pages).to_numpy().astype(np.int64), pages.flatten()
                column = dict(zip([f.name for f in words.type], words.flatten(), strict=True))
                pos = np.arange(len(page)) - np.searchsorted(page, page)
                said = column["text"].dictionary_encode()
                judged = [judged_word(t) for t in said.dictionary.to_pylist()]
                code = pc.fill_null(said.indices, len(judged)).to_numpy()
                numeric, named = (np.array([*v, False], bool)[code] for v in ([n for n, _ in judged], [t != "" for _, t in judged]))
                clean, low = pa.array([t for _, t in judged], pa.string()), pa.array([t.lower() for _, t in judged], pa.string())
                x, y, w, h = (column[name].cast(pa.float64()).to_numpy(zero_copy_only=False) for name in ("x", "y", "w", "h"))
                named &= ~numeric | pc.and_(column["w"].is_valid(), column["h"].is_valid()).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(named)
                number, word = (at[v] for v in _near(page[at], numeric[at], x[at], y[at], x[at] + w[at] + SIDE, h[at] * 0.75 + 8, most))
                heads = np.flatnonzero(np.diff(number, prepend=-1))
                offsets, number = pa.array(np.append(heads, len(number)), pa.int32()), number[heads]
                label, low_label = (pc.binary_join(pa.ListArray.from_arrays(offsets, texts.take(pa.array(code[word]))), " ") for texts in (clean, low))
                # Equal values and labels but for case are one, the first of a page: words are in order.
                value, low_label = (v.dictionary_encode() for v in (low.take(pa.array(code[number])), low_label))
                same = (page[number] * len(value.dictionary) + value.indices.to_numpy()) * len(low_label.dictionary) + low_label.indices.to_numpy()
                once = np.sort(np.unique(same, return_index=True)[1])
                at = number[once]
                yield pa.record_batch([keys.take(pa.array(page[at])), pa.array(pos[at], pa.int32()), clean.take(pa.array(code[at])), label.take(pa.array(once)), pa.array(x[at]), pa.array(y[at])], names=["key", "pos", "value", "label", "x", "y"])

    return run
