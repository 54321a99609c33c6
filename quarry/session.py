"""Sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold on a cluster as well: adaptive plans, splits and partitions of about 128 MB, UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def local_session(cpus: int = 8, name: str = "quarry", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitting side makes the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name).config("spark.driver.memory", memory)
    small = {"spark.sql.shuffle.partitions": str(cpus), "spark.sql.files.maxPartitionBytes": "16m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in {**SETTINGS, **small}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
