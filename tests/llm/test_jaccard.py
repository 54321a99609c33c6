"""The near-duplicate join against all pairs."""

import random

import pytest

from quarry.llm import jaccard


def brute(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)] or ([tuple(w)] if w else [])
        sets.setdefault(i, []).append(frozenset(grams))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = [(i, s) for i, v in sets.items() for s in v if s and i is not None]
    for a, (i, s) in enumerate(items):
        for j, r in items[:a]:
            if den * len(s & r) >= num * len(s | r):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets if i is not None}, sets


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (2, 50)])
def test_against_all_pairs(spark, size, num):
    rng = random.Random(num)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 8, 15, 40, 150, 400]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, (" " if rng.random() < 0.8 else "\n\t ").join(copy)))
            i += 1
    rng.shuffle(rows)
    want, sets = brute(rows, size, num, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.near_duplicates(df, size, num, 100).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]][0]) for r in got)
    kept = {r["doc_id"] for r in jaccard.distinct_documents(df, size, num, 100).collect()}
    assert kept == set(want.values())


def test_odd_rows(spark, odd, odd_rows, none):
    got = jaccard.near_duplicates(odd, 3, 90, 100).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[0] == {(5, 0)} and by[5] == {(5, 0)}
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert by[6] == {(1, 6)} and by[7] == {(1, 7)}
    assert {c for _, c in by[None]} == {None}
    assert {c for _, c in by[9]} == {9}
    assert jaccard.near_duplicates(none).count() == 0
    assert jaccard.distinct_documents(odd).columns == odd.columns


def test_band_bounds():
    for num in (50, 80, 90):
        bands = jaccard.Bands(num, 100)
        for a in range(1, 400):
            for b in range(a, a * 100 // num + 1):
                k = bands.band(a)
                assert bands.band(b) in (k, k + 1)
                m, spare = bands.segments(k)
                most = (100 - num) * (a + b) // (100 + num)
                assert most == 0 if m == 0 else most + 1 + spare <= m


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100
