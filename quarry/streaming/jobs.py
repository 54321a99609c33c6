"""The state of jobs over a stream of their updates, with timers.

An update counts in the order of its time, not of its arrival: it is held until the watermark has passed it. A job that is running
and hears nothing for TIMEOUT loses an attempt and is retried; with its last attempt it fails. Terminal jobs take no
further update. State is one value and the held updates of a job; times in it are microseconds, those of timers milliseconds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .feed import TERMINAL

#: Seconds, and attempts a job has.
TIMEOUT = 300
ATTEMPTS = 3
RESULT = "job_id long, status string, progress_pct int, message string, attempts int, updated_at timestamp, seq long"
_OUT = RESULT.replace("updated_at timestamp", "at long")
#: The updates of a job that came together are held as one value: a call to the state store each would cost more than all else.
_HELD = "at array<long>, id array<long>, status array<string>, progress_pct array<int>, message array<string>"
_VALUE = "status string, progress_pct int, message string, attempts int, at long, deadline long, seq long"


def _plain(column: pd.Series, kind: type) -> list:
    return [None if null else kind(x) for x, null in zip(column.tolist(), column.isna().tolist(), strict=True)]


class JobState(StatefulProcessor):
    def __init__(self, timeout: int, attempts: int):
        self.timeout, self.attempts = timeout * 1_000_000, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value, self.held = handle.getValueState("job", _VALUE), handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[list] = [[], [], [], [], []]
        for part in rows:
            for held, (name, kind) in zip(new, (("at", int), ("id", int), ("status", str), ("progress_pct", int), ("message", str)), strict=True):
                held += _plain(part[name], kind)
        if new[0]:
            self.held.appendValue(tuple(new))
            self.handle.registerTimer(max(new[0]) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((row for pack in self.held.get() for row in zip(*pack, strict=True)), key=lambda r: r[:2]) if self.held.exists() else []
        ends = bisect_left(held, now, key=lambda r: r[0])
        job = tuple(self.value.get()) if self.value.exists() else ("queued", None, None, 1, 0, None, 0)
        before = job
        for row in held[:ends]:
            job = self._after(self._timed(job, row[0]), row)
        job = self._timed(job, now)
        if ends and ends < len(held):
            self.held.put([tuple(list(x) for x in zip(*held[ends:], strict=True))])
        elif ends:
            self.held.clear()
        if job[5] is not None and job[5] >= now:
            self.handle.registerTimer(job[5] // 1000 + 1)
        if job != before:
            job = (*job[:6], job[6] + 1)
            self.value.update(job)
            yield pd.DataFrame([(key[0], *job[:5], job[6])], columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"progress_pct": "Int32"})

    def _timed(self, job: tuple, now: int) -> tuple:
        """job at a time before which its deadline may have passed."""
        status, progress, message, attempts, at, deadline, seq = job
        if deadline is None or now <= deadline:
            return job
        last = attempts >= self.attempts
        return ("failed" if last else "retrying", progress, message, attempts if last else attempts + 1, deadline, None, seq)

    def _after(self, job: tuple, row: tuple) -> tuple:
        status, progress, message, attempts, at, deadline, seq = job
        if status in TERMINAL:
            return job
        when, _, new, pct, said = row
        return (new, progress if pct is None else pct, message if said is None else said, attempts, when, when + self.timeout if new == "running" else None, seq)

    def close(self) -> None:
        pass


def job_states(updates: DataFrame, late: str = "10 minutes", timeout: int = TIMEOUT, attempts: int = ATTEMPTS) -> DataFrame:
    """A stream of states of jobs, a row each time one has changed; seq numbers them. updates (job_id, id, status, progress_pct,
    message, updated_at timestamp) may come as late as late after others; later ones are left out. Rows without job_id, id or time
    aren't updates."""
    rows = updates.select("job_id", "id", "status", "progress_pct", "message", F.col("updated_at").cast("timestamp").alias("updated_at"))
    rows = rows.dropna(subset=["job_id", "id", "updated_at"]).withColumn("at", F.unix_micros("updated_at")).withWatermark("updated_at", late)
    states = rows.groupBy("job_id").transformWithStateInPandas(JobState(timeout, attempts), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")
    return states.select("job_id", "status", "progress_pct", "message", "attempts", F.timestamp_micros("at").alias("updated_at"), "seq")


def latest(states: DataFrame) -> DataFrame:
    """Of written states the last of each job."""
    return states.groupBy("job_id").agg(F.max_by(F.struct("status", "progress_pct", "message", "attempts", "updated_at"), "seq").alias("s")).select("job_id", "s.*")


def states_of_table(updates: DataFrame, timeout: int = TIMEOUT, attempts: int = ATTEMPTS) -> DataFrame:
    """The same states of a whole table, by windows: what the stream comes to when its watermark has passed everything."""
    order = Window.partitionBy("job_id").orderBy("updated_at", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = updates.select("job_id", "id", "status", "progress_pct", "message", F.col("updated_at").cast("timestamp").alias("updated_at")).dropna(subset=["job_id", "id", "updated_at"])
    silent = (F.col("status") == "running") & F.coalesce(F.lead("updated_at").over(order) > F.col("updated_at") + F.make_dt_interval(secs=F.lit(timeout)), F.lit(True))
    rows = rows.withColumn("silent", silent)
    lost = F.count_if("silent").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("lost", lost).withColumn("ended", F.coalesce(F.max(F.col("status").isin(*TERMINAL) | (F.col("lost") >= attempts)).over(upto), F.lit(False))).filter(~F.col("ended"))
    at = F.struct("updated_at", "id")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), at)).alias(x)
    out = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "silent", "lost", "updated_at"), at).alias("s"), last("progress_pct"), last("message"))
    status = F.when(F.col("s.silent"), F.when(F.col("s.lost") >= attempts, "failed").otherwise("retrying")).otherwise(F.col("s.status"))
    when = F.when(F.col("s.silent"), F.col("s.updated_at") + F.make_dt_interval(secs=F.lit(timeout))).otherwise(F.col("s.updated_at"))
    return out.select("job_id", status.alias("status"), "progress_pct", "message", F.least(F.col("s.lost") + 1, F.lit(attempts)).cast("int").alias("attempts"), when.alias("updated_at"))
