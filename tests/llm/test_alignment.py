"""Tokens of two tokenizers linked by bytes, against a plain version."""

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
A.encode_special_tokens = True
CHARACTERS = alignment.byte_of_character()
BYTES_A = {i: bytes(CHARACTERS[c] for c in t) if all(c in CHARACTERS for c in t) else t.encode() for t, i in A.get_vocab().items()}
BYTES_B = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in range(B.get_piece_size())]
ODD = ["", " ", "  x  ", "a ", "<|endoftext|> of <s> and <unk>", "holds ▁ itself", "é ß 日本語\u3000x \x1c y \x00 nul", "\n\n tab\tand  spaces   here", "😀 emoji-joined 👨‍👩‍👧", "word " * 300, "x" * 5000]


def spans(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(sizes[i]), i))
        at += len(sizes[i])
    return out


def plain(rows):
    count, made = collections.Counter(), []
    for i, t in rows:
        a, b = (A.encode(" " + t, add_special_tokens=False).ids, B.encode(t)) if t else ([], [])
        if not t or any(b"".join(v[x] for x in ids) != (" " + t).encode() for v, ids in ((BYTES_A, a), (BYTES_B, b))):
            made.append((i, [], [], [], ""))
            continue
        sa, sb = spans(a, BYTES_A), spans(b, BYTES_B)
        links, j = [], 0
        for s, e, x in sa:
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((x, sb[k][2]))
                k += 1
        groups, left = [], [list(reversed(side)) for side in (sa, sb)]
        for end in sorted({x[1] for x in sa} & {x[1] for x in sb}):
            taken = []
            for side in left:
                own = []
                while side and side[-1][1] <= end:
                    own.append(str(side.pop()[2]))
                taken.append(",".join(own))
            groups.append("|".join(taken))
        count.update(links)
        made.append((i, a, b, links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((i, len(a), len(b), g.count(";") + bool(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, x, g in made), key=str)


@pytest.mark.parametrize("most", [alignment.BROADCAST, 0])
def test_odd_rows(spark, odd, odd_rows, most):
    rng = random.Random(2)
    more = [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, " ".join(rng.choice(["the", "quick", "Donaudampfschiff", "naïve", "2024", "don't"]) for _ in range(60))) for i in range(30)]
    df = odd.select("doc_id", "text", "n", "key").union(spark.createDataFrame([(*r, "x", "x") for r in more], "doc_id long, text string, n string, key string"))
    got = sorted(map(tuple, alignment.align(df, BYTE, PIECE, most=most).collect()), key=str)
    assert got == plain([*odd_rows, *more])


def test_empty_table(spark, none):
    assert alignment.align(none, BYTE, PIECE).collect() == []


BOTH = alignment.Aligner(BYTE, PIECE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab1  \n\t'.<|>é\x1c\x85\u3000日▁", "<s>", "<|endoftext|>", " the", "ing"]), min_size=1, max_size=25).map("".join), min_size=1, max_size=6))
def test_words_alone_are_encoded_as_in_the_text(texts):
    ids_a, n_a, ids_b, n_b, sound = BOTH.tokens(pa.array(texts))
    want_a, want_b = [A.encode(" " + t, add_special_tokens=False).ids for t in texts], [B.encode(t) for t in texts]
    for ids, n, want in ((ids_a, n_a, want_a), (ids_b, n_b, want_b)):
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sound.tolist() == [b"".join(BYTES_B[i] for i in w) == (" " + t).encode() for t, w in zip(texts, want_b, strict=True)]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(alignment, "mix64", lambda x: x & 0)
    with_both = alignment.Aligner(BYTE, PIECE)
    x = with_both.batch(pa.array(["one two three", "three two one one"]))
    assert [(a, b, c) for a, b, c in zip(x.n_a, x.n_b, x.n_links, strict=True)] == [r[1:3] + (r[4],) for r in plain([(0, "one two three"), (1, "three two one one")])]


def test_long_texts_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 40)
    texts = ["short", "the quick brown fox jumps over the naïve Donaudampfschiff again and again, twice  or \n more " * 6, "x" * 200, "a fine text of some length that holds ▁ near its very end, far behind the first part ▁", "tail"]
    got = list(BOTH.batches_of(pa.array(texts)))
    assert len(got) == 5
    for x, t in zip(got, texts, strict=True):
        (_, n_a, n_b, n_groups, n_links, *_, sha) = plain([(0, t)])[0]
        assert (x.n_a[0], x.n_b[0], x.n_groups[0], x.n_links[0], x.sha[0], x.times.sum()) == (n_a, n_b, n_groups, n_links, sha, n_links)
        assert len(set(x.pair.tolist())) == len(x.pair) == len(x.doc) and not x.doc.any()
