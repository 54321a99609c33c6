"""Toxicity by compression distance: two zstandard dictionaries, window compression lengths, calibrated thresholds.

The ordinary dictionary is zstandard's trainer's on windows of ordinary labelled text. The toxic one is trained on
those stretches of toxic labelled text that ordinary text least explains: bytes covered by GRAM-byte grams which a
share of toxic texts at least LEAST_RATIO times that of ordinary ones holds, with PAD bytes on either side. Windows of
WORDS words are compressed with the ordinary dictionary alone and with the toxic one before it: as both then hold the
same ordinary text, the two lengths differ by what toxic text alone explains. (Dictionaries of the two kinds of text
that are compared each on its own differ mostly by the ordinary words that happen to be in either.)

A window stands between two carriers, strings that both dictionaries hold: zstandard neither looks for matches in the
last bytes of its input nor keeps a block that saves little, and would hide gains. Words are runs of anything but white
space, in lower case; one above LONGEST_WORD letters, as in scripts without spaces, is taken in overlapping pieces that
cover it. So all of a text is compressed. Its evidence is the mean gain, the three highest, the share of windows with a
gain, and how many have HIGH bytes or more; a logistic function of it, fitted on labelled rows that neither dictionary
has seen, is the score. The trainer's segment length and the size of the toxic dictionary are those of GRID with the
least log loss on these rows.

Defined results: a null or empty text has no window and gets the score of no gain; a null doc_id isn't held out;
repeated rows are scored each; without labels of both classes every score is the share of label 1. One pass, no
shuffle; the model is two dictionaries of 52 KB in all; counts of grams take fixed memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, texts
from .labelled import Logistic, Sample, calibrate, fold, sample

_LEFT, _RIGHT = bytes(range(1, 25)), bytes(range(200, 224))
WORDS = 8
LONGEST_WORD, OVERLAP = 96, 24
GRAM, PAD = 6, 3
_SLOT_BITS = 24
LEAST_SHARE, LEAST_RATIO = 0.01, 10.0
ORDINARY_BYTES, ORDINARY_SEGMENT = 48_000, 32
#: (segment length, size) of the toxic dictionary.
GRID = ((16, 1024), (20, 2048), (32, 4096))
LOW, HIGH = 3, 5
FLAG = 0.5
_PARAMS = {"window_log": 17, "hash_log": 17, "chain_log": 17, "search_log": 6, "min_match": 5, "target_length": 32, "strategy": zstandard.STRATEGY_LAZY2, "write_content_size": 0, "write_dict_id": 0}


def words(text: str) -> list[str]:
    """The words of text in lower case; longer ones in overlapping pieces, the last flush with the end."""
    found = text.lower().split()
    if max(map(len, found), default=0) <= LONGEST_WORD:
        return found
    out = []
    for w in found:
        last = max(0, len(w) - LONGEST_WORD)
        out += [w[s : s + LONGEST_WORD] for s in (*range(0, last, LONGEST_WORD - OVERLAP), last)]
    return out


def windows(text: str) -> list[bytes]:
    """Windows of WORDS words, one space before, between and after them."""
    w = words(text)
    return [f" {' '.join(w[i : i + WORDS])} ".encode("utf-8", "surrogatepass") for i in range(0, len(w), WORDS)]


def _trained(parts: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary by zstandard's trainer; where there is too little to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, parts, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def _slots(raw: bytes) -> np.ndarray:
    """The slot of each gram of raw."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    grams = sum((x[i : n + i] << np.uint64(8 * i) for i in range(1, GRAM)), x[:n].copy())
    return (mix64(grams) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _holders(raws: list[bytes]) -> np.ndarray:
    """How many of the texts hold a gram, by slot."""
    out = np.zeros(1 << _SLOT_BITS, dtype=np.uint16)
    for raw in raws:
        out[np.unique(_slots(raw))] += 1
    return out


def toxic_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of toxic texts whose grams mark them."""
    t, o = _holders(toxic), _holders(ordinary)
    marked = (t >= max(3, LEAST_SHARE * len(toxic))) & ((t + 0.5) * (len(ordinary) + 1) >= LEAST_RATIO * (o + 0.5) * (len(toxic) + 1))
    out = []
    for raw in toxic:
        hit = np.r_[False, marked[_slots(raw)], False]
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        out += [raw[max(0, a - PAD) : b + GRAM - 1 + PAD] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return out


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    logistic: Logistic | None
    prior: float

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, per window."""

        def load(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(_LEFT + _RIGHT + raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**_PARAMS), dict_data=d)

        a, b = load(self.ordinary).compress, load(self.toxic + self.ordinary).compress
        out = np.zeros(len(parts))
        for i, w in enumerate(parts):
            w = _LEFT + w + _RIGHT
            out[i] = len(a(w)) - len(b(w))
        return out

    def evidence(self, texts_: list[str]) -> np.ndarray:
        split = [windows(t) for t in texts_]
        gains = self.gains([w for ws in split for w in ws])
        out, at = np.zeros((len(texts_), 7)), 0
        for i, ws in enumerate(split):
            if ws:
                d = gains[at : at + len(ws)]
                at += len(ws)
                top = np.zeros(3)
                high = np.sort(np.partition(d, -3)[-3:] if len(d) > 3 else d)[::-1]
                top[: len(high)] = high
                out[i] = d.mean(), *top, math.sqrt((d >= LOW).mean()), (d >= 1).mean(), math.log1p((d >= HIGH).sum())
        return out

    def scores(self, texts_: list[str]) -> np.ndarray:
        return self.logistic(self.evidence(texts_)) if self.logistic else np.full(len(texts_), self.prior)


def fit(s: Sample) -> ToxicityModel:
    """Dictionaries from two thirds of the sample, calibration on the rest."""
    if min(len(s.negative), len(s.positive)) < 6:
        return ToxicityModel(b"", b"", None, s.prior)
    a, b = len(s.negative) * 2 // 3, len(s.positive) * 2 // 3
    ordinary, toxic = ([b"".join(w[:-1] for w in windows(t)) + b" " for t in part] for part in (s.negative[:a], s.positive[:b]))
    base = _trained([w for t in s.negative[:a] for w in windows(t)], ORDINARY_BYTES, ORDINARY_SEGMENT)
    stretches, rest = toxic_stretches(toxic, ordinary), s.negative[a:] + s.positive[b:]
    y = np.r_[np.zeros(len(s.negative) - a), np.ones(len(s.positive) - b)]
    best, least = ToxicityModel(base, b"", None, s.prior), math.inf
    for segment, size in GRID:
        model = ToxicityModel(base, _trained(stretches, size, segment), None, s.prior)
        x = model.evidence(rest)
        model.logistic = calibrate(x, y, s.prior)
        p = np.clip(model.logistic(x), 1e-9, 1 - 1e-9)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if loss < least:
            best, least = model, loss
    return best


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 5, held_out: int = 0) -> ToxicityModel:
    return fit(sample(docs, labels, column, modulus, held_out))


def _score(model: ToxicityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    rows = texts(docs).select("doc_id", F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= FLAG).cast("int"))
