"""Token counts of whole texts with a sentencepiece or tokenizers vocabulary.

Arrow functions return lengths only. A batch of texts is encoded in groups of about GROUP_BYTES bytes, however long
or short its texts are. Texts above SPLIT_CHARS are split at safe boundaries, and the parts' counts added: for a
byte-pair sentencepiece model in which no piece has the space mark after another character (checked when it is
loaded), no merge crosses from such a character to a space; the part after it gives up one space, which the model's
dummy prefix puts back. For the byte-level vocabularies a space after a character that isn't white space starts a new
pre-token. A vocabulary that fails the check is never split.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted
each; an empty table gives no row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts

GROUP_BYTES = 1 << 20
SPLIT_CHARS = 16_384
_SAFE = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")


def split_safely(text: str, size: int) -> list[str]:
    """Parts of about size characters, each after the first starting at a single space between two other characters."""
    parts, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


class SentencePieceCounter:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        bpe = model.trainer_spec.model_type == pb.TrainerSpec.ModelType.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        self.safe = plain and bpe and not any(re.search("[^▁]▁", p.piece) for p in model.pieces)

    def parts(self, text: str) -> list[str]:
        if not self.safe or len(text) <= SPLIT_CHARS:
            return [text]
        head, *rest = split_safely(text, SPLIT_CHARS)
        return [head, *(p[1:] for p in rest)]

    def lengths(self, group: list[str]) -> list[int]:
        return [len(x) for x in self._sp.encode(group, num_threads=1)]


class TokenizersCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.no_truncation()
        self._tok.no_padding()
        self.safe = '"ByteLevel"' in str(self._tok.pre_tokenizer) or "ByteLevel" in type(self._tok.pre_tokenizer).__name__

    def parts(self, text: str) -> list[str]:
        return split_safely(text, SPLIT_CHARS) if self.safe and len(text) > SPLIT_CHARS else [text]

    def lengths(self, group: list[str]) -> list[int]:
        return [len(x) for x in self._tok.encode_batch_fast(group, add_special_tokens=False)]


_COUNTERS: dict[str, SentencePieceCounter | TokenizersCounter] = {}


def counter(path: str) -> SentencePieceCounter | TokenizersCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenizersCounter(path) if path.endswith(".json") else SentencePieceCounter(path)
    return _COUNTERS[path]


def count_batch(texts_: list[str], path: str) -> list[int]:
    """Token counts of texts, encoded in groups balanced by bytes."""
    c = counter(path)
    counts, group, owners, size = [0] * len(texts_), [], [], 0

    def flush() -> None:
        nonlocal size
        for i, n in zip(owners, c.lengths(group), strict=True):
            counts[i] += n
        group.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts_):
        for part in c.parts(text):
            group.append(part)
            owners.append(i)
            size += 4 * len(part) if not part.isascii() else len(part)
            if size >= GROUP_BYTES:
                flush()
    if group:
        flush()
    return counts


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_batch(batch.column(2).to_pylist(), path)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. One pass over the texts, no shuffle."""
    prepare(docs.sparkSession)
    rows = texts(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counts = rows.mapInArrow(_count(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
