"""Secret scans.

Base kinds are the patterns assign, access and hex. The method adds kind entropy: over candidate strings (runs of the
base-64 and identifier characters) a window of WINDOW characters slides; the Shannon entropy of its characters is kept
by incremental counts, and compared with a threshold of the window's character class (hexadecimal, letters and digits,
or base 64). Windows above it merge into spans. An allow-list suppresses candidates that are known to be harmless:
UUIDs, runs of one character class without a digit, dotted or dashed words, and runs that repeat or count. A candidate
that is a run for the most part is judged window by window, as a key may be joined to a rule of = or _; there a digit
is asked of the span, as the run may hold those next to the key, elsewhere of each window.

Defined results: a null or empty text has no spans, and the SHA-256 of an empty list is that of the empty string;
repeated rows are scanned each; positions are code points; an empty table gives no row. One pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, texts

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDS = re.compile("[A-Za-z]+(?:[-_/][A-Za-z]+)*=*|[0-9]+(?:[-_/][0-9]+)*|(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/](?:[A-Za-z]+|[0-9]{1,4}))+")
_CLASSES = ((re.compile("[0-9a-f]+|[0-9A-F]+"), 3.0), (re.compile("[A-Za-z0-9]+"), 3.6))
_OTHER = 3.7
WINDOW = 20

_XLOG = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]


def threshold(window: str) -> float:
    """Bits per character above which a window of its character class counts as random."""
    return next((most for pattern, most in _CLASSES if pattern.fullmatch(window)), _OTHER)


def allowed(candidate: str) -> bool:
    """Known harmless: suppressed whatever its entropy."""
    return bool(_UUID.fullmatch(candidate) or _WORDS.fullmatch(candidate))


def runs(s: str) -> bool:
    """Whether most characters repeat their neighbour or count on from it."""
    steps = [ord(b) - ord(a) for a, b in zip(s, s[1:], strict=False)]
    return sum(x in (0, 1, -1) for x in steps) * 2 > len(steps)


def window_entropies(candidate: str) -> Iterator[float]:
    """Entropy of every window, each from the one before by one count down and one up."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of n log2 n
    for i, c in enumerate(candidate):
        if i >= WINDOW:
            out = candidate[i - WINDOW]
            n = counts[out]
            total += _XLOG[n - 1] - _XLOG[n]
            counts[out] = n - 1
        n = counts.get(c, 0)
        total += _XLOG[n + 1] - _XLOG[n]
        counts[c] = n + 1
        if i >= WINDOW - 1:
            yield math.log2(WINDOW) - total / WINDOW


def entropy_spans(text: str) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if not any(c.isdigit() for c in s) or allowed(s):
            continue
        run = runs(s)
        if run and allowed(s.strip("+/_=-")):
            continue
        found: list[tuple[int, int]] = []
        for i, h in enumerate(window_entropies(s)):
            a = m.start() + i
            window = s[i : i + WINDOW]
            if h >= threshold(window) - 1e-9 and (not runs(window) if run else any(c.isdigit() for c in window)):
                if found and a <= found[-1][1]:
                    found[-1] = (found[-1][0], a + WINDOW)
                else:
                    found.append((a, a + WINDOW))
        spans += [x for x in found if any(c.isdigit() for c in text[x[0] : x[1]])]
    return spans


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    out += [("entropy", a, b) for a, b in entropy_spans(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    merged: list[list] = []
    for k, a, b in scan(text):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    out, at = [], 0
    for k, a, b in merged:
        out += [text[at:a], f"[{k}]"]
        at = b
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(t) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(k == kind for k, *_ in s) for s in found], pa.int64()) for kind in KINDS[:3]]
        base = [hashlib.sha256(joined([x for x in s if x[0] != "entropy"]).encode()).hexdigest() for s in found]
        yield pa.record_batch(
            [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([joined(s) for s in found], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
