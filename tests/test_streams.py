"""Streams that are ended and started again, and state with timers, against batches."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest

from quarry.streaming import feed, jobs

START = datetime(2024, 1, 1)


def updates(spark, rng, n, jobs_=8, span=6000):
    rows = [(i, rng.randrange(jobs_), 7, rng.choice(["t", None]), rng.choice(["queued", "running", "running", "running", "retrying", "succeeded", "failed"] if rng.random() < 0.3 else ["queued", "running"]), rng.choice([None, rng.randrange(100)]), rng.choice([None, f"m{i}"]), START + timedelta(seconds=rng.randrange(span))) for i in range(n)]
    return spark.createDataFrame(rows, feed.JOBS)


def written(df, folder, files):
    df.repartition(files).write.mode("append").parquet(folder)


def test_sink_sends_each_event_once(spark, tmp_path, monkeypatch):
    rows = updates(spark, random.Random(1), 120)
    written(rows, str(tmp_path / "in"), 6)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    make = lambda: feed.sink(feed.frames(feed.job_updates(spark, str(tmp_path / "in"), 1)), out, cp).trigger(availableNow=True).start()
    write, calls = feed.ready, []

    def failing(session):
        """Ends the first run within its first batch, as a lost driver would."""
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return write(session)

    monkeypatch.setattr(feed, "ready", failing)
    with pytest.raises(Exception, match="lost"):
        make().awaitTermination()
    make().awaitTermination()
    # As if the last batches had been written, but not recorded: they run again.
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in commits[-1:]:
        p.unlink()
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    make().awaitTermination()
    got = feed.sent(spark, out)
    assert got.filter("kind = 'ready'").count() == 1
    want = feed.frames(rows).select("frame").collect()
    assert sorted(r["frame"] for r in got.filter("kind = 'job.updated'").collect()) == sorted(r["frame"] for r in want)
    one = sorted(r["frame"] for r in want)[0]
    assert one.startswith("id: 2024-01-01") and "\nevent: job.updated\ndata: {" in one and one.endswith("Z\"}\n\n")


def test_heartbeats_join_the_stream(spark, tmp_path):
    rows = updates(spark, random.Random(2), 10)
    written(rows, str(tmp_path / "in"), 1)
    both = feed.frames(feed.job_updates(spark, str(tmp_path / "in"))).unionByName(feed.heartbeats(spark, 1))
    q = feed.sink(both, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    end = time.time() + 60
    while time.time() < end and (len(q.recentProgress) < 1 or sum(p["numInputRows"] for p in q.recentProgress) < 14):
        time.sleep(0.5)
    q.stop()
    got = feed.sent(spark, str(tmp_path / "out")).collect()
    beats = [r for r in got if r["kind"] == "keep-alive"]
    assert beats and {r["frame"] for r in beats} == {":keep-alive\n\n"} and len({r["id"] for r in beats}) == len(beats)
    assert sum(r["kind"] == "job.updated" for r in got) == 10


def plain(rows, timeout=300, attempts=3):
    """Job by job, update by update."""
    out = {}
    for job in {r["job_id"] for r in rows}:
        own = sorted((r for r in rows if r["job_id"] == job), key=lambda r: (r["updated_at"], r["id"]))
        status, pct, said, tries, at, due = "queued", None, None, 1, None, None
        for r in [*own, None]:
            now = r["updated_at"] if r else datetime.max
            if due is not None and now > due:
                status, at, due = ("failed" if tries == attempts else "retrying"), due, None
                tries = min(tries + 1, attempts)
            if r is None or status in feed.TERMINAL:
                break
            status, at = r["status"], now
            pct, said = r["progress_pct"] if r["progress_pct"] is not None else pct, r["message"] if r["message"] is not None else said
            due = now + timedelta(seconds=timeout) if status == "running" else None
        out[job] = (status, pct, said, tries, at)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_table_states_equal_a_plain_version(spark, seed):
    rows = updates(spark, random.Random(seed), 200, 25)
    got = {r["job_id"]: tuple(r)[1:] for r in jobs.states_of_table(rows).collect()}
    assert got == plain(rows.collect())


def test_stream_states_equal_those_of_the_table(spark, tmp_path):
    """Updates out of order within the watermark, over several files and runs."""
    rng = random.Random(5)
    rows = updates(spark, rng, 150)
    late = sorted(rows.collect(), key=lambda r: r["updated_at"] + timedelta(seconds=rng.randrange(500)))
    end = spark.createDataFrame([(10**6, 999, 7, "t", "queued", None, None, START + timedelta(days=1))], feed.JOBS)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (late[:50], late[50:100], late[100:], None):
            (end if part is None else spark.createDataFrame(part, feed.JOBS)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            states = jobs.job_states(feed.job_updates(spark, str(tmp_path / "in"), 1))
            states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["job_id"]: tuple(r)[1:] for r in jobs.latest(spark.read.parquet(str(tmp_path / "out"))).collect() if r["job_id"] != 999}
    assert got == plain(rows.collect())
    assert {s[0] for s in got.values()} >= {"failed", "retrying"} or len(got) == 8


def test_updates_that_come_together_are_held_by_one_call():
    """Calls to the state store, not updates, are what a key costs."""
    calls, held = [], []

    class Store:
        def getValueState(self, *_):
            return self

        def getListState(self, *_):
            return self

        def appendValue(self, row):
            calls.append("append")
            held.append(row)

        def registerTimer(self, at):
            calls.append(at)

    state = jobs.JobState(300, 3)
    state.init(Store())
    at = pd.date_range("2024-01-01", periods=5000, freq="s")
    part = pd.DataFrame({"job_id": 1, "id": range(5000), "status": "running", "progress_pct": [None, 1.0] * 2500, "message": [None, "m"] * 2500, "updated_at": at, "at": [x.value // 1000 for x in at]})
    assert list(state.handleInputRows((1,), iter([part, part]), None)) == []
    assert len(calls) <= 4 and len(held[0][0]) == 10_000 and held[0][3][:2] == [None, 1] and held[0][4][:2] == [None, "m"]
