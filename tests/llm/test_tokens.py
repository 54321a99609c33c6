"""Encoding, the token store, counts and packing against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, token_counts, token_store
from quarry.llm.common import cut, gear_candidates, scratch
from quarry.llm.encoder import _CUTS, _MARK, PieceEncoder

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK, SP = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
ENC = PieceEncoder(BYTE, capacity=50)


def ids(text):
    return np.array(TOK.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab1  \n\t'.<|>é\x1c\x85\u3000日", "<|endoftext|>"]), max_size=25).map("".join), max_size=6))
def test_encoder_is_exact(texts):
    assert ENC.encode(texts) == [ids(t) for t in texts]


ODD = [*"ab1,.!-' \n\t\x01\r\v\xa0\x85\u180e\u3000éⅧ²日😀\u0301", "'s", "\n\n", " \x01,", "<|endoftext|>", "<|", "|>", "endoftext"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=25).map("".join), max_size=6))
def test_encoder_is_exact_at_punctuation_and_marks(texts):
    assert ENC.encode(texts) == [ids(t) for t in texts]


def test_encoder_is_exact_on_wide_batches(monkeypatch):
    monkeypatch.setattr("quarry.llm.encoder._WIDE", 100)
    texts = ["Ab, c.\nd's " * 20, "e, f\n\x01,"]
    assert ENC.encode(texts) == [ids(t) for t in texts]


def test_tokens_end_at_every_cut():
    chars = [c for c in map(chr, range(1, 0x10000)) if c != _MARK and not 0xD800 <= ord(c) < 0xE000]
    for (pattern, into), follow in zip(_CUTS, ("\n\n", ",!"), strict=True):
        for c, parted in zip(chars, pc.replace_substring_regex(pa.array([c + follow for c in chars]), pattern, into).to_pylist(), strict=True):
            if _MARK in parted:
                assert any(at[0] == 1 for _, at in TOK.pre_tokenizer.pre_tokenize_str(c + follow)), hex(ord(c))


def test_a_word_goes_through_the_library_once_whatever_follows(monkeypatch):
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    texts = ["Start " + " ".join(w + end for w in words) for end in ("", ",", ".", "!", ";", ".\nAnd")]
    enc, sent = PieceEncoder(BYTE), []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda pieces: sent.extend(pieces) or learn(pieces))
    assert enc.encode(texts) == [ids(t) for t in texts]
    assert len(sent) <= len(words) + 10


def crc(raw):
    return zlib.crc32(raw)


def expected_store(rows):
    out, start = [], 0
    whole = [(i, ids(t) + b"\0\0\0\0") for i, t in rows]
    ordered = sorted(whole, key=lambda r: (r[0] is not None, r[0] or 0, token_store.leaf([token_store._digest(r[1])], [len(r[1]) // 4], r[0])))
    for i, raw in ordered:
        out.append((i, start, len(raw) // 4, crc(raw)))
        start += len(raw) // 4
    return out


def test_store_round_trip(spark, odd, odd_rows):
    root = token_store.write_store(odd, BYTE, scratch(spark, "t"))
    got = sorted(tuple(r) for r in token_store.read_store(spark, root).collect() if r[0] is not None)
    assert len(got) == len(odd_rows) - 1
    by_id = {}
    for i, t in odd_rows:
        by_id.setdefault(i, []).append(ids(t) + b"\0\0\0\0")
    assert sorted((i, len(r) // 4, crc(r)) for i, v in by_id.items() if i is not None for r in v) == sorted((i, n, c) for i, _, n, c in got)
    every = sorted(token_store.read_store(spark, root).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in every] == [sum(x["n_tokens"] for x in every[:k]) for k in range(len(every))]
    assert [r["doc_id"] for r in every] == sorted((r["doc_id"] for r in every), key=lambda x: (x is not None, x or 0))
    whole = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in token_store.reconstruct(spark, root).collect()}
    assert all(crc(whole[r["doc_id"], r["start"]]) == r["ids_crc32"] for r in every)
    assert token_store.verify_manifest(spark, root)


def test_chunks_are_stored_once(spark):
    rng = random.Random(11)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(6000))
    docs = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").repartition(4)
    root = token_store.write_store(docs, BYTE, scratch(spark, "t"))
    chunks = token_store.read_chunks(spark, root)
    assert chunks.count() == chunks.select("digest").distinct().count() > 1
    assert chunks.count() == len(docs.sparkSession.read.parquet(f"{root}/recipes").first()["digests"])


def test_changed_chunk_is_found(spark, tmp_path):
    root = token_store.write_store(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), BYTE, str(tmp_path / "s"))
    chunks = spark.read.parquet(f"{root}/objects/kind=0")
    bad = chunks.withColumn("key", chunks["key"].substr(1, 15)).collect()
    spark.createDataFrame(bad, chunks.schema).write.mode("overwrite").parquet(f"{root}/objects/kind=0")
    with pytest.raises(Exception, match="match its key"):
        token_store.read_chunks(spark, root).collect()


def test_changed_recipe_is_found(spark, tmp_path):
    rng = random.Random(17)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(6000))
    root = token_store.write_store(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE, str(tmp_path / "s"))
    recipes = spark.read.parquet(f"{root}/recipes")
    row = recipes.first().asDict()
    assert len(row["digests"]) > 1
    swapped = row | {"digests": row["digests"][::-1], "lens": row["lens"][::-1]}
    other = row | {"digests": [b"x" * 16, *row["digests"][1:]]}
    for bad in (swapped, other):
        spark.createDataFrame([tuple(bad[n] for n in recipes.columns)], recipes.schema).write.mode("overwrite").parquet(f"{root}/recipes")
        for read in (token_store.verify_manifest, lambda s, r: token_store.read_store(s, r).collect(), lambda s, r: token_store.reconstruct(s, r).collect()):
            with pytest.raises(Exception, match="match its leaf"):
                read(spark, root)


def rewritten(spark, folder, change):
    """Replace a folder's rows by what change makes of them."""
    rows = spark.read.parquet(folder)
    spark.createDataFrame(change(rows.collect()), rows.schema).write.mode("overwrite").parquet(folder)


def lost(rows, keep):
    return [r for i, r in enumerate(sorted(rows, key=str)) if i != keep]


READS = (lambda s, r: token_store.read_store(s, r).collect(), lambda s, r: token_store.reconstruct(s, r).collect())


@pytest.fixture
def store(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} with words") for i in range(40)], "doc_id long, text string").coalesce(1)
    return token_store.write_store(docs, BYTE, str(tmp_path / "s"))


def test_swapped_documents_are_found(spark, store):
    def swap(rows):
        rows = sorted((list(r) for r in rows), key=lambda r: r[0])
        rows[3][0], rows[5][0] = rows[5][0], rows[3][0]
        return rows

    rewritten(spark, f"{store}/recipes", swap)
    for read in (token_store.verify_manifest, *READS):
        with pytest.raises(Exception, match="match its leaf"):
            read(spark, store)


def test_lost_chunk_is_found(spark, store):
    rewritten(spark, f"{store}/objects/kind=0", lambda rows: lost(rows, 7))
    for read in READS:
        with pytest.raises(Exception, match="there is no chunk"):
            read(spark, store)


@pytest.mark.parametrize("place", [0, 17, 39])
def test_lost_recipe_is_found(spark, store, place):
    rewritten(spark, f"{store}/recipes", lambda rows: [r for r in rows if r["position"] != place])
    with pytest.raises(Exception, match="lost recipes|differ at level"):
        token_store.verify_manifest(spark, store)
    if place < 39:
        with pytest.raises(Exception, match="lost recipes"):
            token_store.read_store(spark, store).collect()


def test_levels_are_built_from_written_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FANOUT", 3)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    root = token_store.write_store(docs, BYTE, str(tmp_path / "s"))
    leaves = [r["leaf"].hex().upper() for r in token_store.read_recipes(spark, root).orderBy("place").collect()]
    while len(leaves) > 1:
        leaves = [hashlib.sha256("".join(leaves[i : i + 3]).encode()).hexdigest() for i in range(0, len(leaves), 3)]
    assert token_store.verify_manifest(spark, root) == leaves[0]
    rewritten(spark, f"{root}/manifest/level=1", lambda rows: [(r["node"], "0" * 64) for r in rows])
    with pytest.raises(ValueError, match="differ at level 1"):
        token_store.verify_manifest(spark, root)


def test_empty_store(spark, none):
    root = token_store.write_store(none, BYTE, scratch(spark, "t"))
    assert token_store.read_store(spark, root).count() == 0
    assert token_store.verify_manifest(spark, root) is None


def test_crc_shift():
    rng = random.Random(1)
    for _ in range(20):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 3000))
        out = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
        assert out == zlib.crc32(a + b)


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 2**32, 20_000, dtype=np.uint32)
    ends = cut(gear_candidates(g, 6), 0, len(g), 64, 500)
    assert ends[-1] == len(g) and all(64 <= b - a <= 500 for a, b in zip([0, *ends[:-2]], ends[:-1]))
    h = np.r_[rng.integers(0, 2**32, 777, dtype=np.uint32), g]
    moved = {e - 777 for e in cut(gear_candidates(h, 6), 0, len(h), 64, 500)}
    assert len(moved & set(ends)) > len(ends) // 2
    direct = [i + 1 for i in range(31, 400) if sum(int(g[i - k]) << k for k in range(32)) % 2**32 >> 26 == 0]
    assert [c for c in gear_candidates(g, 6).tolist() if 32 <= c <= 400] == direct


def test_counts(spark, odd, odd_rows, none):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, PIECE).collect())
    want = [(i or -1, len((t or "").encode()), len(SP.encode(t or ""))) for i, t in odd_rows]
    assert got == sorted((i, b, n, n > 4096) for i, b, n in want)
    assert token_counts.count_tokens(none, PIECE).count() == 0
    byte = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(odd, BYTE).collect())
    assert byte == sorted((i or -1, len(TOK.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("ab ▁\n.é日")), min_size=0, max_size=200))
def test_safe_splits_keep_the_count(text):
    parts = token_counts.split_safely(text, 16)
    assert "".join(parts) == text
    head, *rest = parts
    assert sum(len(SP.encode(p)) for p in [head, *(p[1:] for p in rest)]) == len(SP.encode(text))
    assert sum(len(TOK.encode(p, add_special_tokens=False).ids) for p in parts) == len(TOK.encode(text, add_special_tokens=False).ids)


def test_packing(spark, odd, odd_rows, none):
    rows = packing.pack_documents(odd, BYTE, capacity=64).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) <= 64
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for i, t in odd_rows:
        if sum(x == i for x, _ in odd_rows) == 1:
            assert b"".join(b for _, b in sorted(docs[i])) == ids(t) + b"\0\0\0\0"
    assert packing.pack_documents(none, BYTE).count() == 0


def test_best_fit_is_bounded_and_tight():
    rng = random.Random(2)
    bins = packing.OpenBins(100, most=8)
    used = {}
    for _ in range(5000):
        n = rng.randint(1, 100)
        at, offset = bins.place(n)
        assert used.get(at, 0) == offset and offset + n <= 100
        used[at] = offset + n
        assert bins.open <= 8 and bins.bits.bit_count() <= 8
    assert sum(used.values()) / (100 * len(used)) > 0.85


def naive_bins(sizes, capacity, most):
    """Best-fit over a plain list of open bins: (bin, offset) of each piece."""
    opened, out, n = [], [], 0  # opened: [free, bin]
    for size in sizes:
        fitting = [b for b in opened if b[0] >= size]
        if fitting:
            best = min(fitting, key=lambda b: b[0])
            latest = [b for b in opened if b[0] == best[0]][-1]
            opened.remove(latest)
        else:
            if len(opened) >= most:
                fullest = min(b[0] for b in opened)
                opened.remove([b for b in opened if b[0] == fullest][-1])
            latest, n = [capacity, n], n + 1
        out.append((latest[1], capacity - latest[0]))
        if latest[0] > size:
            opened.append([latest[0] - size, latest[1]])
    return out


@pytest.mark.parametrize("most", [1, 5, 40])
def test_best_fit_against_a_plain_list(most):
    rng = random.Random(most)
    sizes = [rng.randint(1, 60) if rng.random() < 0.7 else rng.randint(61, 100) for _ in range(1500)]
    bins = packing.OpenBins(100, most=most)
    assert [bins.place(n) for n in sizes] == naive_bins(sizes, 100, most)


def test_packing_is_near_the_lower_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    rows = packing.pack_documents(docs, BYTE, capacity=2048).selectExpr("sum(length) AS n", "count(distinct sequence_id) AS bins").first()
    assert rows["bins"] <= 1.01 * -(-rows["n"] // 2048)


def test_many_rows_without_an_id(spark):
    docs = spark.range(40).selectExpr("cast(null as long) AS doc_id", "concat('text number ', id % 30) AS text").repartition(5)
    got = token_store.store_and_read(docs, BYTE).orderBy("start").collect()
    assert len(got) == 40 and [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(40)]
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(ids(f"text number {i % 30}") + b"\0\0\0\0") for i in range(40))
