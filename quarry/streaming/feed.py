"""The job feed and its derivations as Structured Streaming.

The source is a folder of job updates; a checkpoint takes the place of a cursor, so that updates tied at a page's end
aren't lost. entities.poll keeps the paged form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

JOBS = "id long, job_id long, deal_id long, type string, status string, progress_pct int, message string, updated_at timestamp_ntz"
TERMINAL = ("succeeded", "failed", "cancelled")


def job_updates(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(JOBS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def for_client(updates: DataFrame, deal_id: int, job_ids: list[int] | None = None) -> DataFrame:
    """A client's updates: its deal's; of its jobs, or of evidence fetches; marked when they end."""
    rows = updates.filter(F.col("deal_id") == deal_id)
    if job_ids is not None:
        rows = rows.filter(F.col("job_id").isin(job_ids) | (F.col("type") == "fetch_evidence"))
    return rows.withColumn("terminal", F.col("status").isin(*TERMINAL))


def events(updates: DataFrame) -> DataFrame:
    """Server-sent events: id, event, data."""
    data = F.to_json(F.struct("job_id", "deal_id", "status", "progress_pct", "message"))
    return updates.select(F.col("updated_at").cast("string").alias("id"), F.lit("job.updated").alias("event"), data.alias("data"))


def latest_state(updates: DataFrame) -> DataFrame:
    """Latest state per job: an update-mode aggregate whose state is one row a job."""
    at = F.struct("updated_at", "id")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), at)).alias(x)
    return updates.groupBy("job_id").agg(F.max_by("status", at).alias("status"), last("progress_pct"), last("message"), F.max("updated_at").alias("updated_at"))


def daily_cost(calls: DataFrame, late: str = "2 days") -> DataFrame:
    """Cost by day with a watermark: an extension, for calls that arrive as a stream."""
    timed = calls.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", "1 day")).agg(F.count("*").alias("calls"), F.sum("cost_micro").alias("cost_micro"))
    return out.select(F.col("window.start").cast("date").alias("day"), "calls", "cost_micro")


def deliver(updates: DataFrame, checkpoint: str, send: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch, in order of time, to send."""
    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: send(batch.orderBy("updated_at", "id"), n))


# The sink of server-sent events

FRAME = "kind string, id string, data string, frame string"


def frames(updates: DataFrame) -> DataFrame:
    """Updates as server-sent events: kind, id (when it was updated), data (what is null is left out), frame (as it goes over the wire)."""
    at = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    data = F.to_json(F.struct("job_id", "status", "progress_pct", "message", "deal_id", "type", at.alias("updated_at")))
    return _framed(updates.select(F.lit("job.updated").alias("kind"), F.col("updated_at").cast("string").alias("id"), data.alias("data")))


def _framed(rows: DataFrame) -> DataFrame:
    head = F.when(F.col("id").isNotNull(), F.concat(F.lit("id: "), "id", F.lit("\n"))).otherwise("")
    said = F.concat(head, F.lit("event: "), "kind", F.lit("\ndata: "), "data", F.lit("\n\n"))
    return rows.select("kind", "id", "data", F.when(F.col("kind") == "keep-alive", ":keep-alive\n\n").otherwise(said).alias("frame"))


def ready(spark: SparkSession) -> DataFrame:
    """The event that opens a connection."""
    return _framed(spark.range(1).select(F.lit("ready").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit('{"ok":true}').alias("data")))


def heartbeats(spark: SparkSession, every: int = 15) -> DataFrame:
    """A stream of comment lines, one every so many seconds, that keeps a connection open; to be united with frames."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") % every == every - 1)
    return _framed(ticks.select(F.lit("keep-alive").alias("kind"), F.col("value").cast("string").alias("id"), F.lit("").alias("data")))


def sink(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Write frames below folder, each micro-batch in a folder of its own number, the first with ready before them.

    A micro-batch that ran before, but whose end wasn't recorded, runs again with the same rows and number, and replaces
    what it left: however often the stream is ended and started, each frame is there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = ready(batch.sparkSession).unionByName(batch) if number == 0 else batch
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.select("kind", "id", "data", "frame").writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """The frames written so far, with the number of their micro-batch."""
    return spark.read.schema(f"{FRAME}, batch long").parquet(folder)
