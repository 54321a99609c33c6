"""Codes of vectors against comparing every part with every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from quarry.llm import vectors


def plain(rows, rounds=4, entries=256):
    kept = [(i, lab, [min(max(math.floor(1024 * x), -vectors.limit(len(e))), vectors.limit(len(e))) for x in e]) for i, lab, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // 4
    parts = [[r[2][m * width : (m + 1) * width] for m in range(4)] for r in kept]
    books = [[list(p[m]) for p in parts[:entries]] for m in range(4)]

    def near(p, m):
        return min((sum((a - b) ** 2 for a, b in zip(p[m], e, strict=True)), j) for j, e in enumerate(books[m]))

    for _ in range(rounds):
        at = [[near(p, m)[1] for m in range(4)] for p in parts]
        for m in range(4):
            for j in range(len(books[m])):
                own = [p[m] for p, a in zip(parts, at, strict=True) if a[m] == j]
                if own:
                    books[m][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [[near(p, m) for m in range(4)] for p in parts]
    errors = [sum(d for d, _ in x) for x in last]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in x), e, by_label[r[1]], sha) for r, x, e in zip(kept, last, errors, strict=True)), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, x string, near string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, lab, "x", "y", "z") for i, lab, e in rows], SCHEMA)


def got(df, **how):
    return sorted(map(tuple, vectors.compress(df, **how).collect()), key=str)


def f32(x):
    return float(np.float32(x))


def test_against_all_distances(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i * 3, rng.choice([None, 1, 1, 1, 2]), [f32(c + rng.gauss(0, 0.05)) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(i, 1, [0.0] * 8) for i in range(1, 90, 3)]  # ties of entries and of rows
    assert got(frame(spark, rows).repartition(3), entries=20) == plain(rows, entries=20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, 1, [0.5, 1.0, -0.25, 2.0]), (5, 1, [0.25, 1.0, -0.25, 2.0]), (5, 1, [0.25, 1.0, -0.25, 2.0]), (None, None, [1.0, 1.0, 1.0, 1.0]), (2, None, [-1.0, 0.0, 1.0, 3e38])]
    rows += [(1, 1, None), (0, 1, [1.0, None, 0.0, 0.0]), (3, 1, [nan, 0.0, 0.0, 0.0]), (4, 1, [inf, 0.0, 0.0, 0.0]), (7, 1, [1.0] * 5), (8, 1, [])]
    assert got(frame(spark, rows), entries=3) == plain(rows, entries=3)
    assert vectors.compress(frame(spark, [])).collect() == []
    assert [(r["code"], r["error"]) for r in vectors.compress(frame(spark, [(1, 1, []), (2, 1, [])])).collect()] == [("00000000", 0)] * 2
    short = [(i, 1, [f32(i / 7), f32(-i / 3), f32(i)]) for i in range(5)]
    assert got(frame(spark, short)) == plain([(i, lab, [*e, 0.0]) for i, lab, e in short])


@pytest.mark.parametrize("spread", [1, 40, 3000])
def test_balls_equal_all_and_skip_work(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-3000, 3000, (64, 4))
    entries[5] = entries[9]
    points = entries[rng.integers(0, 64, 5000)] + rng.integers(-spread, spread + 1, (5000, 4))
    far_first = rng.integers(0, 64, 5000)
    near, far = vectors.assign_all(points, entries)
    for before in (near, far_first):
        a, b, seen = vectors.Balls(entries).assign(points, before)
        assert (a == near).all() and (b == far).all()
    if spread < 3000:
        assert vectors.Balls(entries).assign(points, near)[2] < 5000 * 64 / 4


def test_large_magnitudes_are_exact():
    rng = np.random.default_rng(1)
    points, entries = rng.integers(-(1 << 28), 1 << 28, (50, 16)), rng.integers(-(1 << 28), 1 << 28, (9, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in points]
    assert vectors.distances(points, entries).tolist() == want
    assert 64 * (2 * vectors.limit(64)) ** 2 < 1 << 63
