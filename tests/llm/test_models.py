"""Classifiers: held-out accuracy, folds, odd rows."""

import math
import random
import zlib
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import quality, toxicity
from quarry.llm.labelled import sample, thinned

SF, CHECK = "/root/testdata/sf0.1", "/root/testdata/check_s"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("module", "column", "modulus", "held", "least"), [(quality, "quality", 4, 2, 0.97), (toxicity, "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, tables, odd, odd_rows, none, module, column, modulus, held, least):
    docs, labels = tables
    model = module.train(docs, labels)
    rows = module.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r[column] for r in out) / len(out) >= least
    assert sum(r["predicted"] == 1 for r in out if r[column]) / max(1, sum(r[column] for r in out)) >= 0.55
    odd_scores = module.score(odd, model).collect()
    assert len(odd_scores) == len(odd_rows) and all(r["score"] is not None for r in odd_scores)
    by_text = {r["score"] for r in odd_scores if r["doc_id"] in (1, 2)}
    assert len(by_text) == 1
    assert module.score(none, model).count() == 0


def test_without_labels(spark, tables, odd):
    docs, labels = tables
    for module in (quality, toxicity):
        model = module.train(docs.limit(5), labels.limit(0))
        assert {r["score"] for r in module.score(odd, model).collect()} == {0.5}


def test_repeated_ids_teach_once(spark):
    rows = [(1, f"text number {i} of a document that many rows share") for i in range(500)] + [(i, f"other text {i}") for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] * 3, "doc_id long, quality int")
    s = sample(docs, labels, "quality", 10**9, -1)
    assert sorted(s.negative + s.positive) == sorted([min(t for i, t in rows if i == 1), *(t for i, t in rows if i > 1)])


def test_keep_returns_all_columns(spark, tables, odd):
    docs, labels = tables
    model = quality.train(docs, labels)
    assert quality.keep(odd, model).columns == odd.columns
    kept = quality.keep(docs, model)
    bad = labels.filter("quality = 0").select("doc_id")
    good = labels.filter("quality = 1").select("doc_id")
    assert kept.join(bad, "doc_id").count() / bad.count() < 0.1
    assert kept.join(good, "doc_id").count() / good.count() > 0.97


def test_labels_are_no_inputs(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    some = docs.limit(200)
    a = {r["doc_id"]: r["score"] for r in toxicity.score(some, model).collect()}
    b = {r["doc_id"] - 10**6: r["score"] for r in toxicity.score(some.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_thinned():
    t = " ".join(f"w{i}" for i in range(50))
    assert len(thinned([t, t + " x", "other words here that are not the same"])) == 2


def test_long_runs_are_scored_whole():
    rng = random.Random(14)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    bad = "zxqvwzyrtuvszxwqvytz"
    base = letters(4000).encode()
    model = toxicity.ToxicityModel(base, f" {bad}".encode(), None, 0.5)
    for before in (0, 50, 80, 95, 150, 333):
        run = letters(before) + bad + letters(200)
        assert model.evidence([run])[0, 1] > toxicity.HIGH, before
    assert model.evidence([letters(400)])[0, 1] <= 1


def brute_toxicity(model, text):
    """The score by its definition, one word, one window and one number at a time."""
    words = []
    for w in text.lower().split():
        at = 0
        while True:
            end = max(0, len(w) - 96)
            words.append(w[min(at, end) : min(at, end) + 96])
            if at >= end:
                break
            at += 72
    gains = []
    for i in range(0, len(words), 8):
        window = bytes(range(1, 25)) + (" " + " ".join(words[i : i + 8]) + " ").encode() + bytes(range(200, 224))
        lengths = []
        for raw in (model.ordinary, model.toxic + model.ordinary):
            d = zstandard.ZstdCompressionDict(bytes(range(1, 25)) + bytes(range(200, 224)) + raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_dict_id=0)
            lengths.append(len(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress(window)))
        gains.append(lengths[0] - lengths[1])
    n = max(1, len(gains))
    top = sorted([*gains, *[0] * max(0, 3 - len(gains))], reverse=True)[:3] if gains else [0, 0, 0]
    x = [sum(gains) / n, *top, math.sqrt(sum(g >= 3 for g in gains) / n), sum(g >= 1 for g in gains) / n, math.log1p(sum(g >= 5 for g in gains))]
    lo = model.logistic
    z = sum((v - m) / s * w for v, m, s, w in zip(x, lo.mean, lo.scale, lo.weights, strict=True)) + lo.bias
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def brute_quality(model, text):
    """The score by its definition, one window at a time."""
    raw = text.encode()
    parts = [raw[i : i + 256] for i in range(0, len(raw), 256)]
    x = [0.0, 0.0, 1.0]
    if parts:
        size = lambda d, w: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)).compress(w))
        d = [size(model.bad, w) - size(model.good, w) for w in parts]
        shares = sorted(v / (len(w) + 128) for v, w in zip(d, parts, strict=True))
        at = 0.1 * (len(shares) - 1)
        low = shares[int(at)] + (at - int(at)) * (shares[min(int(at) + 1, len(shares) - 1)] - shares[int(at)])
        x = [sum(d) / (len(raw) + 128), low, 128 / (len(raw) + 128)]
    lo = model.logistic
    z = sum((v - m) / s * w for v, m, s, w in zip(x, lo.mean, lo.scale, lo.weights, strict=True)) + lo.bias
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_against_brute_force(spark, tables):
    docs, labels = tables
    some = docs.filter("doc_id % 97 = 3 and octet_length(text) < 9000").orderBy("doc_id").limit(25)
    texts = {r["doc_id"]: r["text"] or "" for r in some.collect()} | {-1: "", -2: "Ein " + "langeswort" * 40 + " y\n\tz"}
    extra = spark.createDataFrame([(k, v) for k, v in texts.items() if k < 0], "doc_id long, text string")
    for module, brute in ((toxicity, brute_toxicity), (quality, brute_quality)):
        model = module.train(docs, labels)
        got = {r["doc_id"]: r["score"] for r in module.score(some.select("doc_id", "text").union(extra), model).collect()}
        assert got.keys() == texts.keys()
        assert all(math.isclose(got[i], brute(model, t), rel_tol=1e-9, abs_tol=1e-12) for i, t in texts.items())


@pytest.mark.skipif(not Path(f"{CHECK}/labels.parquet").exists(), reason="the larger tables aren't here")
def test_toxic_documents_are_caught_with_enough_labels(spark):
    docs, labels = spark.read.parquet(f"{CHECK}/documents.parquet"), spark.read.parquet(f"{CHECK}/labels.parquet")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).filter("held_out").join(labels, "doc_id").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in out)
    assert caught / sum(r["toxic"] for r in out) >= 0.9
    assert caught / sum(r["predicted"] for r in out) >= 0.9


def test_gram_counts():
    toxic, ordinary = b" you are all and only a zzkqvx for this and that ", b" you are all and only a friend for this and that "
    grams = {toxic[i : i + 6] for i in range(len(toxic) - 5)} - {ordinary[i : i + 6] for i in range(len(ordinary) - 5)}
    first, last = min(map(toxic.index, grams)), max(map(toxic.index, grams)) + 6
    assert toxicity.toxic_stretches([toxic] * 5, [ordinary] * 9) == [toxic[first - 3 : last + 3]] * 5
    assert toxicity.toxic_stretches([b"", b"x"] * 3, [b"y"]) == []


def test_dictionaries_learn_from_whole_texts():
    rng = random.Random(15)
    late = "this phrase marks the end of every text that was sampled"
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(11_000)) + late for _ in range(40)]
    assert late[8:40].encode() in quality.dictionary(texts, 4096)
