"""Quality by compression: zstandard dictionaries of good and bad labelled text.

Every window of WINDOW bytes of a whole text is compressed with either dictionary. The difference of the compressed
sizes, over the window's size, is its evidence; a logistic function of the text's mean and lowest-decile evidence and
of its shortness, fitted on labelled rows that neither dictionary has seen, is the score. Means are shrunk as if SHRINK
more bytes spoke neither way, as a few words prove little.

Defined results: a null or empty text has no evidence either way and gets the score of zero difference; a null doc_id
isn't held out; repeated rows are scored each; without labels of both classes every score is the share of label 1.
One pass over the texts, no shuffle; the model is two dictionaries of DICT_BYTES each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import prepare, texts
from .labelled import Logistic, Sample, calibrate, fold, sample

WINDOW = 256
DICT_BYTES = 65_536
LEVEL = 3
KEEP = 0.7
SHRINK = 128


def windows(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def dictionary(texts_: list[str], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on all windows of the texts; where there is too little text to train on, the text itself."""
    parts = [w for t in texts_ for w in windows(t)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    logistic: Logistic | None
    prior: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def load(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)

        return load(self.good), load(self.bad)

    def evidence(self, texts_: list[str]) -> np.ndarray:
        good, bad = self.compressors()
        out = np.zeros((len(texts_), 3))
        out[:, 2] = 1
        for i, t in enumerate(texts_):
            parts = windows(t)
            if parts:
                d = np.array([len(bad.compress(w)) - len(good.compress(w)) for w in parts], dtype=float)
                n = np.array([len(w) for w in parts])
                out[i] = d.sum() / (n.sum() + SHRINK), np.percentile(d / (n + SHRINK), 10), SHRINK / (n.sum() + SHRINK)
        return out

    def scores(self, texts_: list[str]) -> np.ndarray:
        return self.logistic(self.evidence(texts_)) if self.logistic else np.full(len(texts_), self.prior)


def fit(s: Sample) -> QualityModel:
    """Dictionaries from two thirds of the sample, calibration on the rest."""
    if min(len(s.negative), len(s.positive)) < 6:
        return QualityModel(b"", b"", None, s.prior)
    a, b = len(s.negative) * 2 // 3, len(s.positive) * 2 // 3
    model = QualityModel(dictionary(s.positive[:b]), dictionary(s.negative[:a]), None, s.prior)
    rest = s.negative[a:] + s.positive[b:]
    y = np.r_[np.zeros(len(s.negative) - a), np.ones(len(s.positive) - b)]
    model.logistic = calibrate(model.evidence(rest), y, s.prior)
    return model


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 4, held_out: int = 2) -> QualityModel:
    return fit(sample(docs, labels, column, modulus, held_out))


def _score(model: QualityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: QualityModel, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    rows = texts(docs).select("doc_id", F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep(docs: DataFrame, model: QualityModel, least: float = KEEP) -> DataFrame:
    """The rows of docs, all columns, whose text scores least or more."""
    prepare(docs.sparkSession)

    def scores(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.tolist()))

    return docs.filter(pandas_udf(scores, "double")(F.coalesce(F.col("text"), F.lit(""))) >= least)
