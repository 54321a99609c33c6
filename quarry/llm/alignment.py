"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece BPE (B).

Every text is tokenised whole by both, A with the space before it that B adds. Byte offsets at which tokens of both end cut the tokens
into groups. Where such a shared end stands before tokens that both start with a space, it is an anchor; anchors split a text into windows
of token ids, mostly words. Texts are aligned some MB at a time, and there equal windows once: they are found equal by hashes of their id
tuples, which are compared afterwards. Within windows every byte offset at which a token ends closes one link, as two tokens overlap
in one piece; so links, groups and the groups' text come from sorted offsets, without a loop over tokens.

An anchor is verified as the bytes of a window's A ids must be those of its B ids; a text with another window has no tokens.

Both tokenise word by word, each distinct word once: A as encoder.py says; for a B model whose pieces hold no space mark after
another character (checked when it is loaded) no merge crosses from such a character to a space. Texts in which a word is empty or holds
the mark, or white space stands on both sides of a space, and all texts of other models, are encoded whole.

A task returns a row a text, with its distinct id pairs and how often each is linked, and rows of the pairs that it has seen, added up
while they fit. Spark adds these up corpus-wide. Where there are at most BROADCAST pairs, their counts (13 bytes each) go to the workers
as a broadcast table; beyond, the texts' pairs are joined with the counts. Both ways give the same rows.

Defined results: a text that is null, empty or whose tokens' bytes aren't space and text (it holds U+2581, say) has no tokens: zeros, and ''
for groups_sha256; strings of special tokens are plain text; a null doc_id stays null; repeated rows count each; other columns aren't read;
an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, stored, texts
from .encoder import ROWS, PieceEncoder
from .token_counts import split_safely

#: Words whose ids a worker keeps.
WORDS = 100_000
#: Bytes of text that are aligned at once, of a batch that is tokenised at once: some hundred bytes of memory each. A longer text
#: is aligned alone, one of over LONG characters in parts.
GROUP_BYTES = 1 << 21
#: Characters above which a text is taken in parts.
LONG = 1 << 22
#: Distinct pairs that a task adds up before it returns them.
PENDING = 1 << 20
#: Distinct id pairs whose counts are broadcast at most: 54 MB.
BROADCAST = 1 << 22
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_of_character() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] of all i, or of those in which, joined."""
    if which is not None:
        starts, counts = starts[which], counts[which]
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return values[:0]
    kind = np.int32 if max(int(ends[-1]), len(values)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - counts)).astype(kind), counts)
    at += np.arange(ends[-1], dtype=kind)
    return values[at]


class Runs:
    """Byte strings by number, to be joined by number."""

    def __init__(self, parts: list[bytes]):
        self.size = np.array([len(t) for t in parts], np.int64)
        self._begin = np.cumsum(self.size) - self.size
        self._flat = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return gathered(self._flat, self._begin[numbers], self.size[numbers])


class Vocabulary(Runs):
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        super().__init__(tokens)
        self.spaced = np.array([t[:1] == b" " for t in tokens])


class PieceModel:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, spec = model.normalizer_spec, model.trainer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        #: Whether a word is encoded alone as it is in a text.
        self.by_word = plain and spec.model_type == spec.ModelType.BPE and not spec.treat_whitespace_as_suffix and not any(re.search("[^▁]▁", p.piece) for p in model.pieces)
        self.vocabulary = Vocabulary([bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p.piece)) else p.piece.replace("▁", " ").encode() for p in model.pieces])

    def encode(self, pieces: list[str]) -> list[tuple[bytes, bool]]:
        """The ids of each piece, and whether their bytes are a space and the piece."""
        if not pieces:
            return []
        lists = self._sp.encode(pieces, num_threads=1)
        ids = np.fromiter(chain.from_iterable(lists), np.uint32)
        stops = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        raw, cut = ids.tobytes(), (4 * stops).tolist()
        out = [raw[s:e] for s, e in zip([0, *cut], cut, strict=False)]
        said = [p.encode() for p in pieces]
        if self.vocabulary.joined(ids).tobytes() == b" " + b" ".join(said):
            upto = np.concatenate(([0], np.cumsum(self.vocabulary.size[ids])))[stops]
            if (upto == np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1)).all():
                return [(x, True) for x in out]
        return [(x, self.vocabulary.joined(np.frombuffer(x, "<u4")).tobytes() == b" " + p) for x, p in zip(out, said, strict=True)]


class Aligner:
    """Both tokenizers, one a worker."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = PieceEncoder(byte_path, plain=True)
        self.b = PieceModel(piece_path)
        characters = byte_of_character()
        self.bytes_a = Vocabulary([bytes(characters[c] for c in t) if all(c in characters for c in t) else t.encode() for t in self.a.tokens()])
        self.bytes_b = self.b.vocabulary
        self.width = len(self.bytes_b.size)
        # Each id with what follows it in the text of groups: even numbers within a side's tokens, odd ones at its end.
        self._memo: dict[str, tuple[bytes, bytes, bool]] = {}
        self._said = Runs([b"%d%c" % (i, x) for n, marks in ((len(self.bytes_a.size), b",|"), (self.width, b",;")) for i in range(n) for x in marks])

    def tokens(self, texts_: pa.Array) -> tuple:
        """Of texts that aren't empty: all ids of A, the number of each text's, the same of B, and whether B's bytes are a space and the
        text. Texts are parted at spaces, and each distinct word goes through both libraries once."""
        split = pc.split_pattern(texts_, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        distinct, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        words, first, memo = distinct.to_pylist(), offsets[:-1], self._memo
        found = list(map(memo.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        asked = [words[i] for i in new]
        for i, a, (b, good) in zip(new, self.a.words(asked), self.b.encode(asked), strict=True):
            found[i] = (a, b, good)
        if len(memo) < WORDS:
            memo.update((words[i], found[i]) for i in new if len(words[i]) <= 80)
        flag = lambda x: x.to_numpy(zero_copy_only=False)[number]
        void = pc.equal(pc.binary_length(distinct), 0)
        odd = flag(pc.or_(void, pc.match_substring(distinct, "▁")))
        starts, ends = (flag(pc.utf8_is_space(pc.utf8_slice_codeunits(distinct, *at))) for at in ((0, 1), (-1, None)))
        odd[1:] |= ends[:-1] & starts[1:] & (np.diff(np.searchsorted(offsets, np.arange(len(number)), "right")) == 0)  # A's white space may reach over such a space
        whole = np.flatnonzero(np.add.reduceat(odd, first, dtype=np.int64) > 0).tolist() if self.b.by_word else list(range(len(texts_)))
        sound = ~np.logical_or.reduceat(~np.array([x[2] for x in found])[number], first)
        out = []
        for side in (0, 1):
            size = np.array([len(x[side]) // 4 for x in found], np.int64)
            ids = gathered(np.frombuffer(b"".join([x[side] for x in found]), "<u4"), np.cumsum(size) - size, size, number)
            out += [ids, np.add.reduceat(size[number], first)]
        if whole:
            said = [texts_[i].as_py() for i in whole]
            alone = (self.a.whole([" " + t for t in said]), self.b.encode(said))
            for side in (0, 1):
                parts = np.split(out[2 * side], np.cumsum(out[2 * side + 1])[:-1])
                for i, x in zip(whole, alone[side], strict=True):
                    parts[i] = np.frombuffer(x[0] if side else x, "<u4")
                    out[2 * side + 1][i] = len(parts[i])
                    if side:
                        sound[i] = x[1]
                out[2 * side] = np.concatenate(parts)
        return (*out, sound)

    def _distinct(self, ids_a: np.ndarray, ids_b: np.ndarray, a: Spans, b: Spans) -> tuple[np.ndarray, np.ndarray]:
        """The number of each window's id tuples, and a window of each number."""
        marks = np.zeros(len(a.start), np.uint64)
        for salt, (ids, w) in enumerate(((ids_a, a), (ids_b, b))):
            within = np.arange(len(ids)) - np.repeat(w.start, w.size)
            marks ^= mix64(np.add.reduceat(mix64((ids + (within << 20)).astype(np.uint64)), w.start) + np.uint64(salt))
        _, chosen, kind = np.unique(marks, return_index=True, return_inverse=True)
        like = chosen[kind]
        for ids, w in ((ids_a, a), (ids_b, b)):
            if (w.size != w.size[like]).any() or (gathered(ids, w.start[like], w.size) != ids).any():  # two windows of one hash
                keys = [(ids_a[s : s + m].tobytes(), ids_b[t : t + n].tobytes()) for s, m, t, n in zip(a.start, a.size, b.start, b.size, strict=True)]
                numbers: dict[tuple[bytes, bytes], int] = {}
                kind = np.array([numbers.setdefault(k, len(numbers)) for k in keys])
                return kind, np.unique(kind, return_index=True)[1]
        return kind, chosen

    def aligned(self, ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Windows:
        """Windows, whose ids are joined, with as many bytes on either side."""
        n = len(size_a)
        said_a, said_b = self.bytes_a.joined(ids_a), self.bytes_b.joined(ids_b)
        ends_a, ends_b = np.cumsum(self.bytes_a.size[ids_a]), np.cumsum(self.bytes_b.size[ids_b])
        window_ends = ends_a[np.cumsum(size_a) - 1]
        sound = np.ones(n, bool)
        sound[np.searchsorted(window_ends, np.flatnonzero(said_a != said_b), "right")] = False
        seen = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        seen[ends_a] = 1
        seen[ends_b] |= 2
        ends = np.flatnonzero(seen)
        at_a = np.searchsorted(ends_a, ends)
        of = np.repeat(np.arange(n), size_a)[at_a]
        shared = ends[seen[ends] == 3]
        # Tokens by group, A's before B's.
        group = [np.searchsorted(shared, e) for e in (ends_a, ends_b)]
        last = [shared[g] == e for g, e in zip(group, (ends_a, ends_b), strict=True)]
        order = np.argsort(np.concatenate((2 * group[0], 2 * group[1] + 1)), kind="stable")
        said = np.concatenate((2 * ids_a + last[0], 2 * (len(self.bytes_a.size) + ids_b) + last[1]))[order]
        window = np.concatenate((np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)))[order]
        letters = np.bincount(window, weights=self._said.size[said], minlength=n).astype(np.int64)
        groups = np.bincount(np.repeat(np.arange(n), size_a)[np.searchsorted(ends_a, shared)], minlength=n)
        pairs = ids_a[at_a] * self.width + ids_b[np.searchsorted(ends_b, ends)]
        return Windows(sound, groups, np.bincount(of, minlength=n), pairs, letters, self._said.joined(said))

    def batch(self, texts_: pa.Array) -> Batch:
        """The alignment of each text."""
        parts = list(self.batches(texts_, 1 << 62))
        return parts[0] if parts else Batch.empty(0)

    def long_text(self, text: str) -> Batch:
        """The alignment of one text, of which no more than a part is held. Parts end at a space between two characters that are neither
        white space nor the mark: there both tokenizers begin a token, so it is an anchor."""
        first, *rest = split_safely(text, LONG)
        said, held, out = hashlib.sha256(), [], Batch.empty(1)
        for i, part in enumerate([first, *(p[1:] for p in rest)]):
            x = next(iter(self.batches(pa.array([part]), 1 << 62, hashed=False)))
            if not x.n_a[0]:
                return Batch.empty(1)
            for c in _FIGURES:
                getattr(out, c)[0] += getattr(x, c)[0]
            said.update(b";" * bool(i) + x.sha[0])
            held = [_added(*(np.concatenate(v) for v in zip(*held, (x.pair, x.times), strict=True)))]
        out.sha[0] = said.hexdigest()
        out.pair, out.times = held[0]
        out.doc = np.zeros(len(out.pair), np.int64)
        return out

    def batches_of(self, texts_: pa.Array) -> Iterator[Batch]:
        """The alignments of texts in order, long ones each alone."""
        long = np.flatnonzero(pc.greater(pc.utf8_length(texts_), LONG).to_numpy(zero_copy_only=False)).tolist()
        start = 0
        for i in long:
            if i > start:
                yield from self.batches(texts_.slice(start, i - start))
            yield self.long_text(texts_[i].as_py())
            start = i + 1
        if start < len(texts_):
            yield from self.batches(texts_.slice(start))

    def batches(self, texts_: pa.Array, most: int = GROUP_BYTES, hashed: bool = True) -> Iterator[Batch]:
        """The alignments of texts, which are tokenised together, in parts of about most bytes of text. hashed: else sha has the groups."""
        size = pc.binary_length(texts_).to_numpy(zero_copy_only=False).astype(np.int64)
        kept = np.flatnonzero(size)
        none = np.zeros(0, np.int64)
        ids_a, n_a, ids_b, n_b, sound = self.tokens(texts_.filter(pa.array(size > 0))) if len(kept) else (none, none, none, none, none.astype(bool))
        upto, at_a, at_b = np.cumsum(size), np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        start = 0
        while start < len(size):
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] - size[start] + most, "right")))
            out, (i, j) = Batch.empty(stop - start), np.searchsorted(kept, (start, stop))
            own, good, sides = kept[i:j] - start, sound[i:j].copy(), []
            for ids, n, at, v in ((ids_a, n_a, at_a, self.bytes_a), (ids_b, n_b, at_b, self.bytes_b)):
                part, of = ids[at[i] : at[j]].astype(np.int64), np.repeat(np.arange(j - i), n[i:j])
                sides.append((part, of, np.bincount(of, weights=v.size[part], minlength=j - i)))
            good &= sides[0][2] == sides[1][2]
            (a, of_a, _), (b, of_b, _) = sides
            if not good.all():
                a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
            self._windows(out, own, a, b, of_a, of_b, hashed)
            yield out
            start = stop

    def _windows(self, out: Batch, kept: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, hashed: bool) -> None:
        if not len(ids_a):
            return
        ends_a, ends_b = np.cumsum(self.bytes_a.size[ids_a]), np.cumsum(self.bytes_b.size[ids_b])
        seen = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        seen[ends_a] = 1
        seen[ends_b] |= 2
        # A window ends at a shared end before tokens with a space, or where the text ends.
        opens_a = np.append(self.bytes_a.spaced[ids_a][1:], True) | np.append(of_a[1:] != of_a[:-1], True)
        opens_b = np.append(self.bytes_b.spaced[ids_b][1:], True) | np.append(of_b[1:] != of_b[:-1], True)
        seen[ends_a[opens_a]] |= 4
        seen[ends_b[opens_b]] |= 8
        stop_a, stop_b = np.flatnonzero(seen[ends_a] == 15) + 1, np.flatnonzero(seen[ends_b] == 15) + 1
        del seen
        a, b = (Spans(np.concatenate(([0], s[:-1])), np.diff(s, prepend=0)) for s in (stop_a, stop_b))
        doc = of_a[a.start]
        kind, chosen = self._distinct(ids_a, ids_b, a, b)
        w = self.aligned(gathered(ids_a, a.start[chosen], a.size[chosen]), gathered(ids_b, b.start[chosen], b.size[chosen]), a.size[chosen], b.size[chosen])
        bad = ~w.sound[kind]
        if bad.any():
            keep = ~np.isin(doc, doc[bad])
            doc, kind = doc[keep], kind[keep]
            alive = np.zeros(len(kept), bool)
            alive[doc] = True
            of_a, of_b = of_a[alive[of_a]], of_b[alive[of_b]]
        if not len(doc):
            return
        size = len(kept)
        out.n_a[kept], out.n_b[kept] = np.bincount(of_a, minlength=size), np.bincount(of_b, minlength=size)
        for to, each in ((out.n_groups, w.groups), (out.n_links, w.links)):
            to[kept] = np.bincount(doc, weights=each[kind], minlength=size).astype(np.int64)
        said = gathered(w.said, np.cumsum(w.letters) - w.letters, w.letters, kind).tobytes()
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        upto = np.cumsum(np.add.reduceat(w.letters[kind], first)).tolist()
        for d, s, e in zip(kept[doc[first]].tolist(), [0, *upto], upto, strict=False):
            out.sha[d] = hashlib.sha256(said[s : e - 1]).hexdigest() if hashed else said[s : e - 1]
        # Windows are counted within each text first, then their pairs.
        once, times = np.unique(doc * len(chosen) + kind, return_counts=True)
        d, k = once // len(chosen), once % len(chosen)
        key = np.repeat(d << 32, w.links[k]) | gathered(w.pairs, np.cumsum(w.links) - w.links, w.links, k)
        order = np.argsort(key)
        key, times = key[order], np.repeat(times, w.links[k])[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out.doc, out.pair, out.times = kept[key[at] >> 32], key[at] & 0xFFFFFFFF, np.add.reduceat(times, at)


@dataclass
class Spans:
    """Starts and lengths of windows in an array of ids."""

    start: np.ndarray
    size: np.ndarray


@dataclass
class Windows:
    """Of each window whether both sides have the same bytes, and its groups, links and letters; the pairs and letters of all, joined."""

    sound: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    pairs: np.ndarray
    letters: np.ndarray
    said: np.ndarray


@dataclass
class Batch:
    """Figures by text; and by text and distinct pair (in the order of texts) how often it is linked there."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha: list[str | bytes]
    doc: np.ndarray
    pair: np.ndarray
    times: np.ndarray

    @classmethod
    def empty(cls, n: int) -> Batch:
        return cls(*(np.zeros(n, np.int64) for _ in range(4)), [""] * n, *(np.zeros(0, np.int64) for _ in range(3)))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _ALIGNERS:
        _ALIGNERS[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _ALIGNERS[byte_path, piece_path]


def _added(pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(pair, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, back, times)
    return distinct, total


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair array<int>, n array<long>"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _FIGURES), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("pair", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def _counted(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs and counts, some thousand a row."""
    for i in range(0, len(pair), 1 << 16):
        some, many = pair[i : i + (1 << 16)], n[i : i + (1 << 16)]
        stops = pa.array([*range(0, len(some), 4096), len(some)], pa.int32())
        columns = {"pair": pa.ListArray.from_arrays(stops, pa.array(some.astype(np.int32))), "n": pa.ListArray.from_arrays(stops, pa.array(many))}
        yield pa.record_batch([columns.get(f.name, pa.nulls(len(stops) - 1, f.type)) for f in _ARROW], schema=_ARROW)


def _align(byte_path: str, piece_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_both = aligner(byte_path, piece_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, number = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for x in with_both.batches_of(batch.column("text")):
                many = len(x.sha)
                stops = np.searchsorted(x.doc, np.arange(many + 1))
                # Sorted pairs of a text as differences: they compress.
                step = np.diff(x.pair, prepend=0)
                starts = stops[:-1][np.diff(stops) > 0]
                step[starts] = x.pair[starts]
                pairs, times = step.astype("<i4").tobytes(), x.times.astype("<u4").tobytes()
                cut = (4 * stops).tolist()
                blobs = [[raw[s:e] for s, e in zip(cut, cut[1:], strict=False)] for raw in (pairs, times)]
                rows = pa.array(np.arange(number, number + many))
                columns = [rows, batch.column("doc_id").slice(at, many), *(pa.array(getattr(x, c)) for c in _FIGURES), pa.array(x.sha), *(pa.array(v, pa.binary()) for v in blobs)]
                empty = [pa.nulls(many, _ARROW.field(c).type) for c in ("pair", "n")]
                yield pa.record_batch([*columns, *empty], schema=_ARROW)
                at, number = at + many, number + many
                held.append(_added(x.pair, x.times))
                size += len(held[-1][0])
            if size > PENDING:
                held = [_added(*(np.concatenate(v) for v in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > PENDING // 2:
                    yield from _counted(*held[0])
                    held, size = [], 0
        if held:
            yield from _counted(*_added(*(np.concatenate(v) for v in zip(*held, strict=True))))

    return run


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of all pairs of a batch's texts."""
    raw = [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("pairs", "<i4"), ("times", "<u4"))]
    n = pc.binary_length(batch.column("pairs")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    row = np.repeat(np.arange(batch.num_rows), n)
    upto = np.cumsum(raw[0].astype(np.int64))
    before = np.concatenate(([0], upto))[(np.cumsum(n) - n)]
    return row, upto - np.repeat(before, n), raw[1].astype(np.int64)


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over a text's links by a broadcast table of pairs, counts and whether each is its B id's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = (np.frombuffer(x, kind) for x, kind in zip(table.value, ("<i4", "<i8", "?"), strict=True))
        for batch in batches:
            row, pair, times = _decoded(batch)
            at = np.searchsorted(known, pair)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * best[at])
            np.add.at(sums[1], row, times * count[at])
            names = ["doc_id", *_FIGURES]
            yield pa.record_batch([*(batch.column(c) for c in names), *(pa.array(s) for s in sums), batch.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, pair, times = _decoded(batch)
        yield pa.record_batch([batch.column("row").take(pa.array(row)), pa.array(pair.astype(np.int32)), pa.array(times)], names=["row", "pair", "times"])


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, count and best: how many links corpus-wide hold a pair, and whether that is the highest of its B id (ties included)."""
    every = aligned.filter(F.col("pair").isNotNull()).select(F.explode(F.arrays_zip("pair", "n")).alias("x"))
    counts = every.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n").alias("count")).withColumn("b", F.col("pair") % width)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, most: int = BROADCAST) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. most: pairs that are broadcast."""
    import sentencepiece

    spark = prepare(docs.sparkSession, ROWS)
    width = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    if PieceEncoder(byte_path).vocabulary * width > 1 << 31:
        raise ValueError("the vocabularies are too large for pairs of 31 bits")
    aligned = stored(texts(docs).mapInArrow(_align(byte_path, piece_path), _SCHEMA), "aligned", keep=True, compression="zstd")
    counts = stored(pair_counts(aligned, width), "pairs", keep=True)
    rows = aligned.filter(F.col("pair").isNull()).drop("pair", "n")
    if counts.count() <= most:
        found = counts.orderBy("pair").toArrow()
        columns = [found.column(c).to_numpy() for c in ("pair", "count", "best")]
        table = spark.sparkContext.broadcast([v.astype(kind).tobytes() for v, kind in zip(columns, ("<i4", "<i8", "?"), strict=True)])
        return rows.mapInArrow(_scored(table), _RESULT)
    listed = rows.select("row", "pairs", "times").mapInArrow(_listed, "row long, pair int, times long")
    part = listed.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return rows.join(part, "row", "left").select("doc_id", *_FIGURES, *zero, "groups_sha256")
