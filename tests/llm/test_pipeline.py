"""Stages on their own inputs, and the whole on small tables."""

import random
import zlib

import pytest

import corpus_pipeline
from quarry.llm import secrets

SF = "/root/testdata/sf0.01"
NAMES = ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.cache()
        n.append(docs.count())
    assert n[0] > n[1] > n[2] > n[3] == n[4] > n[0] // 2
    assert not any(secrets.scan(r["text"]) for r in docs.select("text").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, odd, k):
    from pyspark.sql import functions as F

    docs = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    out.collect()
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).count() == 0
    if k < 4:
        assert out.columns == docs.columns


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 2048


def test_run_against_plain_versions(spark, tmp_path):
    """Every stage on small planted tables against versions of its definition over plain Python values."""
    from test_jaccard import brute
    from test_models import brute_quality
    from test_scans import brute_base, edit_distance_within
    from test_tokens import ids

    from quarry.llm import decontaminate, quality

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["$$$", "%%%", "click here!!!", "###", "WIN 1000"]) for _ in range(n))
    item = " ".join(f"quiz{rng.randint(100, 999)}" for _ in range(20))
    texts = {i: prose(60) for i in range(44)} | {i: junk(60) for i in range(44, 70)}
    texts |= {80 + i: texts[i].rsplit(" ", 1)[0] + " changed" for i in range(6)}
    texts |= {90: f"{prose(30)} {item} {prose(20)}", 91: f"{prose(30)} {item.replace('quiz', 'quis', 2)} {prose(20)}", 92: prose(30) + ' password = "hunter2222" ' + prose(30), 93: None, 94: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 44), 0) for i in range(70)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(8))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = quality.train(docs, labels)
    kept = {i: t for i, t in texts.items() if brute_quality(model, t or "") >= 0.7}
    assert set(range(44)) - set(kept) == set() and not set(range(44, 70)) & set(kept)
    wanted = [set(kept)]
    component, _ = brute(list(kept.items()), 5, 80, 100)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    assert not {80, 81, 82, 83, 84, 85} & set(kept)
    wanted.append(set(kept))
    pattern = decontaminate.normal(item)
    windows = [pattern[s : s + 80] for s in (*range(0, len(pattern) - 80, 20), len(pattern) - 80)]
    leaked = {i for i, t in kept.items() if t and any(edit_distance_within(w, decontaminate.normal(t)) <= 0.12 * len(w) for w in windows)}
    assert leaked == {90, 91}
    kept = {i: t for i, t in kept.items() if i not in leaked}
    wanted.append(set(kept))
    redacted = {}
    for i, t in kept.items():
        out, at = "", 0
        for kind, a, b in brute_base(t or ""):
            out, at = f"{out}{(t or '')[at:a]}[{kind}]", b
        redacted[i] = out + (t or "")[at:]
    assert "hunter2222" not in redacted[92]

    got = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, [*wanted, set(kept)], strict=False):
        got = stage(spark, got, str(tmp_path)).cache()
        assert {r["doc_id"] for r in got.select("doc_id").collect()} == want, name
    assert {r["doc_id"]: r["text"] for r in got.collect()} == redacted
    whole = {i: ids(t) + b"\0\0\0\0" for i, t in redacted.items()}
    bins = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        piece = whole[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(piece) == r["ids_crc32"] and len(piece) == 4 * r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert sorted(i for b in bins.values() for *_, i in b) == sorted(whole)
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _, _ in pieces] == [sum(n for _, n, _ in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n, _ in pieces) <= 2048
