"""Queries of sources, sinks and streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import images, office, sinks
from ..streaming import feed, jobs
from .q_entities import q
from .registry import query
from .views import standalone, view

c = F.col

q("src1_scan", "nation", lambda n: n, "SELECT * FROM {nation}")
q("src2_base64_uploads", "documents", lambda d: office.decoded(d.select(F.concat("source", F.lit(".docx")).alias("file_name"), F.base64(F.encode("text", "utf-8")).alias("file_buffer"))).groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")),
  "SELECT 'word' AS kind, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM {documents}")
q("src11_enqueued_jobs", "deals", lambda d: d.filter("not deleted").select(F.concat(F.lit("job-"), c("id").cast("string")).alias("job_id"), F.lit("queued").alias("status"), F.lit(0).alias("progress_pct")), "SELECT concat('job-', CAST(id AS VARCHAR(20))) AS job_id, 'queued' AS status, 0 AS progress_pct FROM {deals} WHERE NOT deleted")
q("snk2_export_history", "jobs", lambda j: sinks.export_history(j.select("id", "deal_id", c("updated_at").alias("created_at")), 7), "SELECT id, deal_id, updated_at AS created_at FROM {jobs} WHERE deal_id = 7 ORDER BY updated_at DESC, id DESC LIMIT 50")
q("snk3_documents", "ledgers", lambda g: sinks.from_document(sinks.to_document(g.select("deal_id", "cycles", "subgoals"), "deal_id"), "cycles long, subgoals long", "deal_id"), "SELECT deal_id, cycles, subgoals FROM {ledgers}")
q("snk4_cache_import", "cache_events", lambda v: v.filter(c("created_at") + F.expr("INTERVAL 7 DAYS") >= F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("task_type").agg(F.count("*").alias("n")), "SELECT task_type, count(*) AS n FROM {cache_events} WHERE created_at + INTERVAL 7 DAY >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")


SIDE = 256
#: Images that are made at once, so that a batch of keys is never held as one of pixels.
AT_ONCE = 32


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            keys, out = batch.column(0).slice(i, AT_ONCE), []
            for k in keys.to_pylist():
                image = np.full((SIDE, SIDE, 3), 240, np.uint8)
                for x, y, w, h, level in ((10, 90, 40 + k % 30 * 2, 15 + k % 17, k % 100), (10, 4 if k % 2 else 70, 200, 6, 20), (140, 110, 60, 30, 171 + k % 3 % 2)):
                    image[y : y + h, x : x + w : 2] = level
                out.append(image.tobytes())
            yield pa.record_batch([keys, pa.array(out, pa.binary())], names=["key", "pixels"])


def _dealt(rows: DataFrame) -> DataFrame:
    """A key becomes 200 KB, so a file of keys is dealt out first."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.columns[0])


def _drawn(rows: DataFrame) -> DataFrame:
    """Images of SIDE by SIDE pixels on light ground, by a key: a block of dark stripes whose size and place vary, a banner, and a
    block whose gray lies just below or at the threshold."""
    return _dealt(rows).mapInArrow(_images, "key long, pixels binary")


def _found(suppliers: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("read", pa.bool_())]))
    made = _dealt(suppliers.select("s_suppkey")).mapInArrow(images.measured(_images, lambda p: images.found(p, SIDE, SIDE), kind), f"key long, measure {images.REGION}")
    return made.select("key", F.posexplode("measure")).select("key", "pos", "col.*")


def _black(suppliers: DataFrame) -> DataFrame:
    return _dealt(suppliers.select("s_suppkey")).mapInArrow(images.measured(_images, images.black, pa.int64()), "key long, measure long").select("key", c("measure").alias("black"))


# A block of w by h stripes at x, y has edges from x - 1 and y - 1 on; the banner is too flat beyond the top quarter; gray from 171.4 on turns white.
_BLOCKS = """b AS (SELECT s_suppkey AS key, 9 AS x, 89 AS y, 40 + s_suppkey % 30 * 2 AS w, 16 + s_suppkey % 17 AS h, 1 AS k FROM {supplier}
  UNION ALL SELECT s_suppkey, 9, CASE WHEN s_suppkey % 2 = 1 THEN 3 ELSE 69 END, 200, 7, 2 FROM {supplier} UNION ALL SELECT s_suppkey, 139, 109, 60, 31, 3 FROM {supplier} WHERE s_suppkey % 3 % 2 = 0)"""

q("x15_text_regions", "supplier", _found, f"""WITH {_BLOCKS}
  SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY w * h DESC, y) - 1 AS INT) AS pos, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h, w >= 60 AND h >= 25 AND NOT (w > 25 * h AND y >= 64) AS read FROM b""")
q("x17_preprocessed", "supplier", _black,
  "SELECT s_suppkey AS key, CAST((20 + s_suppkey % 30) * (15 + s_suppkey % 17) + 600 + CASE WHEN s_suppkey % 3 % 2 = 0 THEN 900 ELSE 0 END AS BIGINT) AS black FROM {supplier}")


@query("snk1_export", standalone("SELECT id, name FROM {deals} WHERE id IN (1, 2, 3)"))
def _export(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{_folder(spark)}/export"
    sinks.export(view(spark, d, "deals"), folder, [1, 2, 3], ["id", "name"], "json")
    return spark.read.schema("id long, name string").json(folder)


def _folder(spark: SparkSession) -> str:
    """A fresh folder where a query may write: in the shared folder that the cluster names; a local one only if the session is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='quarry-')).rstrip('/')}/query-{uuid.uuid4().hex[:12]}"


def _streamed(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Write rows as a stream's files, run the stream over what is there, and read what it wrote: appended rows, or with
    mode complete the table of the last batch."""
    folder = _folder(spark)
    rows.write.parquet(f"{folder}/in")
    result, out = make(feed.job_updates(spark, f"{folder}/in")), f"{folder}/out"
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def _job_rows(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "jobs").select("id", "job_id", "deal_id", "type", "status", "progress_pct", "message", "updated_at")


@query("t1_job_feed", standalone("""SELECT CAST(updated_at AS VARCHAR) AS id, 'job.updated' AS event, concat('{"job_id":', job_id, ',"deal_id":7,"status":"', status, '"', CASE WHEN progress_pct IS NOT NULL THEN concat(',"progress_pct":', progress_pct) ELSE '' END,
  CASE WHEN message IS NOT NULL THEN concat(',"message":"', message, '"') ELSE '' END, '}') AS data FROM {jobs} WHERE deal_id = 7"""))
def _feed(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, _job_rows(spark, d), lambda s: feed.events(feed.for_client(s, 7)), "append")


@query("t3_client_filter", standalone("SELECT id, job_id, status IN ('succeeded', 'failed', 'cancelled') AS terminal FROM {jobs} WHERE deal_id = 7 AND job_id IN (1, 2, 3, 42, 107)"))
def _client(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, _job_rows(spark, d), lambda s: feed.for_client(s, 7, [1, 2, 3, 42, 107]).select("id", "job_id", "terminal"), "append")


@query("t7_latest_state", standalone("""SELECT job_id, max_by(status, k) AS status, max_by(progress_pct, k) FILTER (WHERE progress_pct IS NOT NULL) AS progress_pct, max_by(message, k) FILTER (WHERE message IS NOT NULL) AS message,
  max(updated_at) AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at, id) AS k FROM {jobs}) x GROUP BY 1"""))
def _latest(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, _job_rows(spark, d), feed.latest_state, "complete")


@query("src12_event_sink", standalone("""SELECT 'ready' AS kind, NULL AS id, '{"ok":true}' AS data, concat('event: ready', chr(10), 'data: {"ok":true}', chr(10), chr(10)) AS frame
  UNION ALL SELECT 'job.updated', id, data, concat('id: ', id, chr(10), 'event: job.updated', chr(10), 'data: ', data, chr(10), chr(10)) FROM (SELECT CAST(updated_at AS VARCHAR) AS id, concat('{"job_id":', job_id, ',"status":"', status, '"',
  CASE WHEN progress_pct IS NOT NULL THEN concat(',"progress_pct":', progress_pct) ELSE '' END, CASE WHEN message IS NOT NULL THEN concat(',"message":"', message, '"') ELSE '' END, ',"deal_id":', deal_id, ',"type":"', type,
  '","updated_at":"', strftime(updated_at, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(date_part('milliseconds', updated_at) % 1000 AS VARCHAR), 3, '0'), 'Z"}') AS data FROM {jobs}) x"""))
def _sink(spark: SparkSession, d: str) -> DataFrame:
    """The sink is ended and started again with other files: what was sent stays sent once."""
    folder, rows = _folder(spark), _job_rows(spark, d)
    for part in (c("id") % 2 == 0, c("id") % 2 == 1):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = feed.frames(feed.job_updates(spark, f"{folder}/in"))
        feed.sink(stream, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return feed.sent(spark, f"{folder}/out").drop("batch")


#: Makes the watermark pass all rows before it.
_END = "timestamp_ntz '2100-01-01'"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("t7_job_states", standalone(f"""WITH r AS (SELECT *, status = 'running' AND coalesce(lead(updated_at) OVER w > updated_at + INTERVAL {jobs.TIMEOUT} SECOND, TRUE) AS silent, row_number() OVER w AS k FROM {{jobs}} WINDOW w AS (PARTITION BY job_id ORDER BY updated_at, id)),
  l AS (SELECT *, count(*) FILTER (silent) OVER (PARTITION BY job_id ORDER BY k) AS lost FROM r),
  e AS (SELECT *, coalesce(bool_or(status IN ('succeeded', 'failed', 'cancelled') OR lost >= {jobs.ATTEMPTS}) OVER (PARTITION BY job_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended FROM l),
  s AS (SELECT job_id, max_by(CASE WHEN NOT silent THEN status WHEN lost >= {jobs.ATTEMPTS} THEN 'failed' ELSE 'retrying' END, k) AS status, max_by(progress_pct, k) FILTER (progress_pct IS NOT NULL) AS progress_pct, max_by(message, k) FILTER (message IS NOT NULL) AS message,
  CAST(least(max_by(lost, k) + 1, {jobs.ATTEMPTS}) AS INT) AS attempts, max_by(CASE WHEN silent THEN updated_at + INTERVAL {jobs.TIMEOUT} SECOND ELSE updated_at END, k) AS updated_at FROM e WHERE NOT ended GROUP BY job_id) SELECT * FROM s"""))
def _job_states(spark: SparkSession, d: str) -> DataFrame:
    folder, rows = _folder(spark), _job_rows(spark, d)
    end = spark.range(1).selectExpr("-1L AS id", "-1L AS job_id", "0L AS deal_id", "'end' AS type", "'queued' AS status", "CAST(NULL AS INT) AS progress_pct", "CAST(NULL AS STRING) AS message", f"{_END} AS updated_at")
    rows.unionByName(end).write.parquet(f"{folder}/in")
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        states = jobs.job_states(feed.job_updates(spark, f"{folder}/in", 1_000_000))
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(_ROCKS[0], before) if before else spark.conf.unset(_ROCKS[0])
    found = jobs.latest(spark.read.schema(f"{jobs.RESULT}, batch long").parquet(f"{folder}/out").filter("job_id >= 0"))
    return found.withColumn("updated_at", c("updated_at").cast("timestamp_ntz"))


@query("t8_daily_cost", standalone("SELECT CAST(created_at AS DATE) AS day, count(*) AS calls, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM {llm_calls} GROUP BY 1"))
def _daily_cost(spark: SparkSession, d: str) -> DataFrame:
    """Calls that come after the watermark has passed their day are left out: here copies of calls of the first days, sent last."""
    folder = _folder(spark)
    calls = view(spark, d, "llm_calls").select("created_at", "cost_micro")
    first = calls.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    late = calls.crossJoin(F.broadcast(first)).filter("created_at < first + INTERVAL 5 DAYS AND created_at < last - INTERVAL 10 DAYS").select("created_at", "cost_micro")
    end = spark.range(1).selectExpr(f"{_END} AS created_at", "CAST(0 AS BIGINT) AS cost_micro")
    for rows in (calls, late, end):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = feed.daily_cost(spark.readStream.schema("created_at timestamp_ntz, cost_micro long").parquet(f"{folder}/in"))
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
