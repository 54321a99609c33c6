"""Bounded labelled samples, and a small logistic calibration."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a classifier is fitted on at most, and the bytes of the longest text among them.
PER_CLASS = 1500
LONGEST_TEXT = 32_768


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(doc_id.cast("long").cast("string")) % modulus


def thinned(texts: list[str]) -> list[str]:
    """Texts without those that share one of two smallest five-word shingles with an earlier one: copies teach once."""
    seen: set[int] = set()
    out = []
    for t in texts:
        words = t.lower().split()
        marks = {zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
        least = set(sorted(marks)[:2])
        if least.isdisjoint(seen):
            out.append(t)
        seen |= least
    return out


@dataclass
class Sample:
    negative: list[str]
    positive: list[str]
    #: Share of label 1 among all labelled rows of the training folds.
    prior: float


def sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, per_class: int = PER_CLASS) -> Sample:
    """At most per_class texts of each class, in the order of a hash of their ids, without the held-out fold.

    Only ids are sorted (a top-k); they are joined to the texts by broadcast, as their number is bounded. Of rows that
    share an id the smallest text counts, so that twice per_class texts reach the driver at most. Rows whose id or label
    is null, and texts above LONGEST_TEXT bytes, aren't learnt from.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), modulus) != held_out))
    total, ones = marks.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    order = F.xxhash64("doc_id")
    ids = [marks.filter(F.col("label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text").between(1, LONGEST_TEXT))
    found = rows.join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(order, "doc_id").collect()
    negative, positive = (thinned([r["text"] for r in found if r["label"] == y]) for y in (0, 1))
    return Sample(negative, positive, ones / total if total else 0.5)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (np.atleast_2d(x) - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-2) -> Logistic:
    """Logistic regression by Newton's method; its bias is moved from the sample's class balance to prior."""
    x, y = np.atleast_2d(x).astype(float), y.astype(float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(a.shape[1]), ridge * len(x) / 100 * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    share, prior = np.clip([y.mean(), prior], 1e-3, 1 - 1e-3)
    return Logistic(mean, scale, w[:-1], float(w[-1] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))))
