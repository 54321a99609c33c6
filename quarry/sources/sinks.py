"""Exports and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "json", "parquet", "orc")


def export(rows: DataFrame, path: str, ids: list[int], fields: list[str], fmt: str = "csv") -> DataFrame:
    """Write the chosen fields of the chosen ids; returns what was written. The list of ids is a user's choice."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} isn't one of {', '.join(FORMATS)}")
    out = rows.filter(F.col("id").isin(ids)).select(*fields)
    writer = out.write.mode("overwrite")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)
    return out


def export_history(history: DataFrame, deal_id: int | None = None, keep: int = 50) -> DataFrame:
    """The most recent records; the limit is the feature."""
    rows = history if deal_id is None else history.filter(F.col("deal_id") == deal_id)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(keep)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def to_document(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows as JSON payloads beside the columns to keep."""
    return rows.select(*keep, F.to_json(F.struct(*[c for c in rows.columns if c not in keep])).alias("payload"))


def from_document(rows: DataFrame, schema: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.from_json("payload", schema).alias("p")).select(*keep, "p.*")
