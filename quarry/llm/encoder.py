"""Exact, memoised batch encoding with a byte-level BPE of the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The byte-level pattern never looks behind, and gives the last space before another character to what follows. So a
#: text may be split before every space but where white space stands on both sides of the space: there, and only
#: there, a run of white space reaches over the cut. Texts with such a place are encoded whole. A text may also be split
#: where ASCII punctuation follows a letter or digit, and where a line ends after anything but white space: a token ends
#: there whatever follows. What stands behind such a cut gets a mark for its space.
_MARK = "\x01"
_CUTS = ((r"([^\t-\r\x1C-\x1F\x85\pZ\x{180E}])\n", f"\\1 {_MARK}\n"), (r"([\pL\pN])([!-/:-@\[-`{-~])", f"\\1 {_MARK}\\2"))
#: Bytes of a batch that is cut before spaces alone: it holds a very long text, whose parts are to be few.
_WIDE = 16 << 20
#: Parts that may stand behind others: what starts with white space and doesn't end with it.
_SIMPLE = re.compile(r"[ \n]\S+").fullmatch
#: Words longer than this are encoded each time rather than kept.
_LONG = 80
_JOIN = 400
#: Rows of an Arrow batch for encoding: the more, the fewer distinct words a text has of its own.
ROWS = 2500
#: Words that a worker keeps unless it is told otherwise: about 150 bytes each.
MEMO = 250_000


class PieceEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    Arrow splits a batch of texts into words and punctuation and numbers the distinct ones; a word with the space before it goes
    through the library once a batch at most, and its ids are kept, while there are no more than capacity words. The
    ids of the batch are then gathered by word numbers. Results are those of Tokenizer.encode(text,
    add_special_tokens=False), special strings inside texts included; with plain, these strings are ordinary text. Texts are
    strings: callers make nulls empty, and an empty text has no ids.
    """

    def __init__(self, path: str, capacity: int = MEMO, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = plain
        self._memo: dict[str, bytes] = {}
        self._capacity = capacity
        self.vocabulary = self._tok.get_vocab_size(with_added_tokens=True)
        added = {i: t.content for i, t in self._tok.get_added_tokens_decoder().items()}
        self._added = list(added.values())
        #: Bytes of text behind each id: a byte-level token has one character a byte.
        self._bytes = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in self._tok.get_vocab(with_added_tokens=True).items():
            self._bytes[i] = len(added[i].encode()) if i in added else len(token)

    def tokens(self) -> list[str]:
        """The entry of each id."""
        by_id = {i: t for t, i in self._tok.get_vocab(with_added_tokens=True).items()}
        return [by_id.get(i, "") for i in range(max(by_id) + 1)]

    def _direct(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Those that start with a space or a line's end and have no other white space are encoded joined, and parted by their bytes."""
        out: dict[str, bytes] = {}
        simple = [p for p in pieces if _SIMPLE(p)]
        parts = [simple[i : i + _JOIN] for i in range(0, len(simple), _JOIN)]
        for part, done in zip(parts, self._tok.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(done.ids, dtype="<u4")
            upto = np.cumsum(self._bytes[ids])
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in part])
            at = np.searchsorted(upto, ends)
            if upto[-1] != ends[-1] or (upto[at] != ends).any():
                continue  # not as expected: each alone, below
            stops = (4 * (at + 1)).tolist()
            raw = ids.tobytes()
            out.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, self._direct(rest), strict=True))
        return [out[p] for p in pieces]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it."""
        return self._learn([" " + w for w in words])

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by the library alone."""
        return self._direct(texts)

    def _parted(self, texts: pa.Array) -> tuple[pa.Array, bool]:
        """Texts with a space and a mark at each place of _CUTS, but for those with special strings; or as they are, and false."""
        if texts.nbytes > _WIDE or pc.any(pc.match_substring_regex(texts, _MARK)).as_py():
            return texts, False
        out = texts
        for pattern, into in _CUTS:
            out = pc.replace_substring_regex(out, pattern, into)
        for string in self._added:
            has = pc.match_substring(texts, string)
            if pc.any(has).as_py():
                out = pc.if_else(has, texts, out)
        return out, True

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        parted, marked = self._parted(texts)
        split = pc.split_pattern(parted, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        words, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        heads = offsets[:-1]
        memo = self._memo
        found = list(map(memo.get, words))
        own = set() if marked else {i for i, w in enumerate(words) if w[:1] == _MARK}  # not the memo's words of that name
        for i in own:
            found[i] = None
        inner = np.ones(len(number), dtype=bool)
        inner[heads] = False
        needed = np.zeros(len(words), dtype=bool)
        needed[number[inner]] = True
        new = [i for i in np.flatnonzero(needed).tolist() if found[i] is None]
        for i, ids in zip(new, self._learn([w[1:] if (w := words[i])[:1] == _MARK and marked else " " + w for i in new]), strict=True):
            found[i] = ids
        void = pc.equal(pc.utf8_length(coded.dictionary), 0)

        def open_at(start: int, stop: int | None) -> np.ndarray:
            edge = pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, start, stop))
            return pc.or_(edge, void).to_numpy(zero_copy_only=False)[number]

        ends_open, starts_open = open_at(-1, None), open_at(0, 1)
        ends_open[heads] &= ~void.to_numpy(zero_copy_only=False)[number[heads]]
        over = np.flatnonzero(ends_open[:-1] & starts_open[1:] & inner[1:])
        whole = sorted(set((np.searchsorted(offsets, over, "right") - 1).tolist()))
        if len(memo) < self._capacity:
            memo.update((words[i], found[i]) for i in new if len(words[i]) <= _LONG and i not in own)
        first = sorted(set(number[heads].tolist()))
        starts = self._direct([words[i] for i in first])
        # Distinct words, then heads, as one list of id runs to gather from.
        runs = [x or b"" for x in found] + starts
        number[heads] = len(words) + np.searchsorted(first, number[heads])
        size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) // 4
        begin = np.cumsum(size) - size
        n = size[number]
        ends = np.cumsum(n)
        kind = np.int32 if max(int(ends[-1]), int(size.sum())) < 2**31 else np.int64
        source = np.repeat((begin[number] - (ends - n)).astype(kind), n)
        source += np.arange(len(source), dtype=kind)
        raw = np.frombuffer(b"".join(runs), "<u4")[source].tobytes()
        cuts = [0, *(4 * ends[offsets[1:] - 1]).tolist()]
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, ids in zip(whole, self._direct([texts[i].as_py() for i in whole]), strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, capacity: int = MEMO) -> PieceEncoder:
    """One encoder a Python worker, vocabulary and capacity."""
    if (path, capacity) not in _ENCODERS:
        _ENCODERS[path, capacity] = PieceEncoder(path, capacity)
    return _ENCODERS[path, capacity]
