"""License scans against plain regular expressions, and the SQL of the queries of this kind."""

import random
import re

import duckdb
import pytest

from quarry.llm import license_rules, licenses, queries
from quarry.llm.license_rules import Rule

ALL = license_rules.rules()


def plain(text, table=ALL):
    """found and kept: (start, length, number of the rule)."""
    words = [w for w in re.split(licenses.SEPARATORS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    found, anchored = [], {}
    for n, r in enumerate(table):
        anchored.setdefault(r.anchor, []).append((n, re.compile(f"(?:{r.regex}) ")))
    for i, w in enumerate(words):
        for n, r in anchored.get(w, ()):
            if m := r.match(" ".join(words[i : i + license_rules.LONGEST]) + " "):
                found.append((i, m[0].count(" "), n))

    def beats(e, d):
        a, b = table[e[2]], table[d[2]]
        return e[0] <= d[0] and e[0] + e[1] >= d[0] + d[1] and (a.priority, e[1], -e[2]) > (b.priority, d[1], -d[2])

    return len(words), sorted(found), sorted(d for d in found if table[d[2]].base or not any(beats(e, d) for e in found))


def got(df, table=ALL):
    rows = licenses.detections(df, table).collect()
    return sorted(((r["doc_id"], r["n_words"], *(sorted((d["start"], d["length"], d["n"]) for d in r[c] or ()) for c in ("found", "kept"))) for r in rows), key=str)


def test_rules_hold_their_promises():
    assert len(ALL) > 800 and all(re.fullmatch("[a-z0-9]+", r.anchor) and 0 < r.confidence <= 1 for r in ALL)
    # Each name, and each with a grant before it, matches from its first word on and holds its keyword.
    for r in ALL:
        sample = re.sub(r" \?|\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\?", lambda m: " " if m[0] == " ?" else "", r.regex)
        sample = re.sub(r"\(\?:([^|()]*)[^()]*\)", r"\1", re.sub(r"\[(.)[^]]*\]\{[^}]*\}", "x y", sample))
        sample = re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"[a-z]\?", "", sample))
        assert re.fullmatch(r.regex, sample) and r.keyword in sample, (r, sample)


def test_against_plain_expressions(spark):
    rng = random.Random(3)
    pieces = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "Licensed under the GNU Lesser General Public License, version 2.1 or later", "SPDX-License-Identifier: GPL-2.0-or-later", "gpl v3", "all rights reserved", "public domain", "under the mit", "Release under the terms of the"]
    texts = []
    for n in (0, 3, 250, 256, 258, 515, 2000):
        for _ in range(6):
            words = [rng.choice(["word", "mit", "the", "Straße", "日本", "x1"]) for _ in range(n)]
            for _ in range(rng.randrange(12)):
                words.insert(rng.choice([rng.randrange(len(words) + 1), min(len(words), 256 * rng.randrange(4) + rng.randrange(-6, 3) % 256)]), rng.choice(pieces))
            texts.append(rng.choice([" ", "\n", "-", ", "]).join(words))
    rows = list(enumerate(texts))
    want = sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert sum(len(w[2]) for w in want) > sum(len(w[3]) for w in want) > 100


def test_containment_by_priority_length_and_order(spark):
    table = [Rule("a", "one", "one two", 1, 0.1), Rule("b", "one", "one two three", 1, 0.2), Rule("c", "two", "two", 9, 0.3), Rule("d", "two", "two", 9, 0.4), Rule("e", "three", "three", 1, 0.5, True), Rule("f", "four", "three four", 1, 0.6)]
    df = spark.createDataFrame([(1, "zero one two three four")], "doc_id long, text string")
    assert got(df, table) == [(1, *plain("zero one two three four", table))]
    # a lies in b; c and d win by priority, c by order; e stays as it is a base rule; f only overlaps b.
    assert licenses.scan(df, table).first()["labels"] == "b,c,e,f"


def test_odd_rows(spark, odd, odd_rows, none):
    assert got(odd) == sorted(((i, *plain(t)) for i, t in odd_rows), key=str)
    assert licenses.scan(none).collect() == []
    empty = licenses.scan(odd).filter("doc_id = 1").first()
    assert (empty["n_words"], empty["n_base"], empty["first_word"], empty["base_labels"], empty["labels"], empty["score"]) == (0, 0, None, "", "", 0.0)


def test_very_long_text_in_linear_time(spark):
    text = "filler words of no meaning " * 400_000 + "released under the MIT license " * 3000
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (2_015_000, 3000, 2_000_001, 2_014_996)


@pytest.mark.parametrize("name", ["op11_license_scans", "op13_vector_code_compression"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, result.fetchall()))


def test_plan_is_native(spark, odd):
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan
