"""Range joins of words and joins of names against their plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.operators import layout, names
from quarry.plans import catalog

WORD = "struct<text:string,x:double,y:double,w:double,h:double>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_arrays(pages):
    rows = pages.select("id", F.posexplode(t.word_metrics(F.col("words")))).select("id", "pos", "col.*").collect()
    return sorted((r["id"], r["pos"], r["value"], r["label"]) for r in rows)


def by_join(pages):
    found = {}
    for r in layout.metrics(layout.word_rows(pages, "id"), "id").collect():
        found.setdefault(r["id"], []).append((r["pos"], r["value"], r["label"]))
    return sorted((i, k, v, label) for i, rows in found.items() for k, (_, v, label) in enumerate(sorted(rows)))


def test_metrics_equal_those_of_arrays(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        words = [(rng.choice(["total", "Margin", "net", "$5", "$5", "12%", "7x", " ", None, "www.x.org", "é"]), float(rng.choice([rng.randrange(-300, 600), rng.randrange(0, 40) * 16])), float(rng.choice([rng.randrange(-50, 400), 32 * rng.randrange(9)])), float(rng.randrange(0, 80)), float(rng.choice([8, 12, 60, 300]))) for _ in range(rng.randrange(40))]
        rows.append((i, words))
    pages = spark.createDataFrame(rows, f"id long, words array<{WORD}>")
    assert by_join(pages) == by_arrays(pages)
    assert len(by_join(pages)) > 100
    assert layout.metrics(layout.word_rows(pages.limit(0), "id"), "id").collect() == []


def test_a_page_of_many_words_is_no_product(spark):
    n = 20_000
    words = [(f"${i}M" if i % 50 == 0 else f"w{i % 977}", float(i % 25 * 70), float(i // 25 * 15), 40.0, 12.0) for i in range(n)]
    pages = spark.createDataFrame([(1, words)], f"id long, words array<{WORD}>")
    got = layout.metrics(layout.word_rows(pages, "id"), "id")
    assert "Cartesian" not in plan(got) and "NestedLoop" not in plan(got)
    found = {r["pos"]: (r["value"], r["label"]) for r in got.collect()}
    for pos in (0, 50, 9_950, 19_950):
        x, y, w, h = words[pos][1:]
        near = sorted((o[1], i, o[0]) for i, o in enumerate(words) if abs(o[2] - y) <= h * 0.75 + 8 and x - 120 <= o[1] <= x + w + 120 and not o[0].startswith("$"))
        assert found[pos] == (words[pos][0], " ".join(z[2] for z in near[:10]))
    assert len(found) == n // 50


def by_page(pages, **kwargs):
    rows = layout.page_metrics(pages, "id", **kwargs).collect()
    found = {}
    for r in rows:
        found.setdefault(r["id"], []).append((r["pos"], r["value"], r["label"]))
    return sorted((i, k, v, label) for i, rows in found.items() for k, (_, v, label) in enumerate(sorted(rows)))


def test_metrics_of_pages_equal_those_of_rows_and_of_arrays(spark, monkeypatch):
    rng = random.Random(16)
    rows = []
    for i in range(150):
        n = rng.randrange(60)
        texts = ["total", "Margin", "margin", "net", "$5", "$5", "12%", "7x", "7X", " ", None, "www.x.org", "é", "\u00a0 Σ", "a b", "1 - 2"]
        words = [(rng.choice(texts), float(rng.choice([rng.randrange(-300, 600), rng.randrange(0, 40) * 16])), float(rng.choice([rng.randrange(-50, 400), 32 * rng.randrange(9), rng.random() * 90])), float(rng.choice([rng.randrange(0, 80), -400])), float(rng.choice([8, 12, 60, 300, -40]))) for _ in range(n)]
        rows.append((i, words))
    rows.append((200, None))
    pages = spark.createDataFrame(rows, f"id long, words array<{WORD}>")
    want = by_arrays(pages)
    assert by_page(pages) == want == by_join(pages) and len(want) > 300
    places = lambda df: sorted(map(tuple, df.collect()))
    assert places(layout.page_metrics(pages, "id")) == places(layout.metrics(layout.word_rows(pages, "id"), "id"))
    assert layout.page_metrics(pages, "id").schema.simpleString() == layout.metrics(layout.word_rows(pages, "id"), "id").schema.simpleString()
    assert by_page(pages.limit(0)) == []
    # The same in small steps: few words, few pairs at once.
    values = {r[0]: r[1] for r in rows if r[1]}
    for i, words in list(values.items())[:40]:
        columns = [np.array(v, float) for v in zip(*[(x, y, x + w + layout.SIDE, h * 0.75 + 8) for _, x, y, w, h in words], strict=True)]
        page, number = np.zeros(len(words), np.int64), np.array([(t_ or "")[:1] in "$17" and bool(t_) for t_, *_ in words])
        whole = layout._near(page, number, *columns, most=10)
        with monkeypatch.context() as m:
            m.setattr(layout, "PAIRS", 3)
            parts = layout._near(page, number, *columns, most=10)
        assert [v.tolist() for v in whole] == [v.tolist() for v in parts]


def test_words_are_judged_alike(spark):
    """judged_word against the Columns: white space of all kinds, cases, digits of other scripts, links and phones."""
    rng, parts = random.Random(4), [*" \t\n\r\x0b\x0c\x1c\x85\u00a0\u2028\u3000\ufeff", "a", "K", "\u212a", "İ", "Σ", "ſ", "$", "1", "23", ",", ".", "%", "–", "-", "x", "X", "k", "٣", "www.", "WWW.", "HTTPS://", "http://", "@", "555", "5555", "é"]
    words = ["", *parts, *{"".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(20_000)}]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", t.is_numeric_value(F.col("w")), t.trimmed(F.col("w")).alias("t"), t.is_boilerplate(t.trimmed(F.col("w")))).collect()
    wrong = [w for w, n, clean, boiler in rows if t.judged_word(w) != (n, w if n else "" if boiler else clean)]
    assert wrong == []


def test_metrics_of_odd_places(spark):
    """Null, NaN and infinite places are near nothing; a page's key may repeat or be null."""
    inf, nan = float("inf"), float("nan")
    words = [("net", 1.0, 1.0, 5.0, 9.0), ("$5", 3.0, 2.0, 5.0, 9.0), ("far", inf, 1.0, 1.0, 9.0), ("odd", nan, nan, 1.0, 9.0), ("gone", None, 1.0, 1.0, 9.0), ("$6", 2.0, nan, 5.0, 9.0), ("$7", 2.0, 1.0, None, 9.0), ("$8", 2.0, 900.0, nan, inf)]
    pages = spark.createDataFrame([(1, words), (1, words[:2]), (None, words[:2]), (2, [])], f"id long, words array<{WORD}>")
    got = sorted((str(r["id"]), r["pos"], r["value"], r["label"]) for r in layout.page_metrics(pages, "id").collect())
    assert got == [("1", 1, "$5", "net"), ("1", 1, "$5", "net"), ("1", 7, "$8", "net"), ("None", 1, "$5", "net")]


@pytest.mark.parametrize("name", ["x14_metrics_of_documents", "x14_metrics_by_join"])
def test_pages_of_arrays_arent_shuffled_by_word(spark, name):
    """no exchange of words or of pairs."""
    got = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Join" not in got and "Window" not in got and "Generate" not in got


def test_a_large_page_of_an_array_is_no_product(spark):
    n = 200_000
    words = [(f"${i}M" if i % 50 == 0 else f"w{i % 977}", float(i % 25 * 70), float(i // 25 * 15), 40.0, 12.0) for i in range(n)]
    pages = spark.createDataFrame([(1, words)], f"id long, words array<{WORD}>")
    assert layout.page_metrics(pages, "id").count() == n // 50


@pytest.mark.parametrize("least", [0.1, 0.5, 0.6, 0.7, 0.85, 1.0])
def test_names_equal_the_cross_join(spark, least):
    rng = random.Random(9)
    words = ["acme", "labs", "fund", "a", "ab", "red", "blue", "north", "labs labs", "É", "o'neil"]
    name = lambda: rng.choice(["", " "]) + rng.choice([" ", "  "]).join(rng.choice(words) for _ in range(rng.randrange(0, 5))).title()
    left, right = (spark.createDataFrame([(name(), "x") for _ in range(120)] + [(None, "x"), ("  ", "x")], "name string, l string") for _ in range(2))
    a, b = (d.select(F.trim(F.lower("name")).alias("n")).filter("n <> ''").distinct() for d in (left, right))
    every = a.alias("a").crossJoin(b.alias("b")).select("a.n", "b.n", t.match_confidence(F.col("a.n"), F.col("b.n")).alias("c")).filter(F.col("c") >= least)
    got = names.name_matches(left, right, least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) != []
    assert "Cartesian" not in plan(got) and "NestedLoop" not in plan(got)


def test_headings_and_metrics_judge_each_text_once(spark):
    """Functions of arrays find each mention anew, so the plan names a rule once, or once a use."""
    rows = spark.createDataFrame([(1, ["Market size overview", "market SIZE overview!", "Team and traction", None, "x"], [("$5", 1.0, 1.0, 1.0, 8.0), ("total", 2.0, 1.0, 1.0, 8.0), ("$5", 1.0, 1.0, 1.0, 8.0)])], f"id long, titles array<string>, words array<{WORD}>")
    heads = rows.select(t.headings(F.col("titles")).alias("h"))
    assert plan(heads).count("(?i)(?<![a-z0-9_])use") == 1
    assert heads.first()["h"] == ["Market size overview", "Team and traction"]
    assert rows.select(t.headings(F.col("titles"), None, 1)).first()[0] == ["Market size overview"]
    found = rows.select(t.word_metrics(F.col("words")).alias("m"))
    assert plan(found).count(t.PHONE) == 1
    assert [tuple(m) for m in found.first()["m"]] == [("$5", "total")]
