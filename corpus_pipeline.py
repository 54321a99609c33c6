"""A corpus pipeline over documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each is written as Parquet to the
shared folder and read again, which also cuts lineage. All stages but the last return the columns of documents.

Odd rows: a null text counts as empty in every stage, rows that repeat are rows of their own, other columns pass through
whatever their names, and an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.llm import decontaminate, jaccard, packing, quality, secrets
from quarry.llm.common import prepare, stored, table
from quarry.llm.queries import BYTE_BPE


#: Bytes of one Arrow batch in a stage's own pass: an executor runs all stages one after the other, and its workers keep some of each.
BATCH_BYTES = 3 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, whose pass will hand texts to Python in batches of BATCH_BYTES."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. A text that is null, empty or a few words has no evidence
    either way and is kept or not by the score of that; without labels of both classes that is the share of good ones."""
    return small_batches(quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels"))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles, similarity 0.8 or more.
    Texts without words, and rows without an id, are all kept; of rows that share an id all are kept or none."""
    return jaccard.distinct_documents(docs, size=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; an empty text holds none, an empty benchmark rejects nothing."""
    return small_batches(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by their kinds; a null text becomes empty, n_chars follows."""
    prepare(spark)

    @pandas_udf("string")
    def redacted(text: pd.Series) -> pd.Series:
        return text.map(secrets.redact)

    docs = docs.withColumn("text", redacted(F.coalesce(F.col("text"), F.lit(""))))
    return small_batches(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in sequences of at most 2048 tokens; an empty text is its end id alone."""
    packed = packing.pack_documents(docs, BYTE_BPE, capacity=2048, memo=50_000)
    return small_batches(packed).selectExpr("doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("secrets", redact),
    ("packing", pack),
]

#: No SQL expresses compression scores; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
