"""What the corpus operators share: reading tables, Arrow limits, shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; bounds a worker's memory whatever the texts are.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Let Python workers import this package, and bound Arrow batches."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    # Workers give memory back after each batch rather than keep it for the next stage's.
    for name, value in (("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("MALLOC_MMAP_THRESHOLD_", "1048576"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): the only columns an operator reads; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared folder of spark.checkpoint.dir; a local one only where that is unset and the session
    is local, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="quarry-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def stored(df: DataFrame, label: str, keep: bool = False, **options: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. Within temporary() the folder goes at its end, but for keep."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    if not keep and (made := _OPEN.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete what stored() writes within, through the file system that holds it: only for tables that no result reads."""
    made: list[str] = []
    token = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 step), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gear_candidates(gears: np.ndarray, mask_bits: int) -> np.ndarray:
    """Ends (exclusive) after which the 32-element rolling gear hash has mask_bits high zero bits.

    gears holds one uint32 per element. The hash h[i] = sum(gears[i-k] << k for k in 0..31) is summed
    by doubling, in five passes, so that no element is visited by Python.
    """
    h = gears.astype(np.uint32, copy=True)
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1


def cut(candidates: np.ndarray, start: int, end: int, shortest: int, longest: int) -> list[int]:
    """Ends of the chunks of [start, end): at the first candidate between shortest and longest, else at longest.

    shortest must be 32 at least: then no cut depends on what stands before start.
    """
    ends = []
    while end - start > shortest:
        i = int(np.searchsorted(candidates, start + shortest))
        at = int(candidates[i]) if i < len(candidates) else end
        at = min(at, start + longest, end)
        ends.append(at)
        start = at
    if start < end:
        ends.append(end)
    return ends
