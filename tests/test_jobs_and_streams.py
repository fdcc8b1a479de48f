"""Jobs that break and go on, and stable states as stream and as batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import jobs
from tessella.sources.shared import counted
from tessella.streaming import stability

JOB = ("j1", "v1", "graph")


def source(spark, folder):
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_broken_job_goes_on(spark, tmp_path):
    data, log, sink, progress = (str(tmp_path / n) for n in ("data", "log", "sink", "progress"))
    for i in range(4):
        spark.range(i * 10, i * 10 + 10, 1, 1).write.mode("append").parquet(data)
    broken = []

    def fails_once(df, batch):
        if batch == 2 and not broken:
            broken.append(batch)
            # the rows of the batch are there, its checkpoint is not
            jobs.batch_sink(sink)(df, batch)
            raise RuntimeError("token: abc for ana@example.org at batch two")
        return df

    assert jobs.run(JOB, log, source(spark, data), sink, progress, fails_once) == "failed"
    assert jobs.rows_of(spark, sink).count() == 30
    assert jobs.run(JOB, log, source(spark, data), sink, progress, fails_once) == "succeeded"
    assert sorted(r.id for r in jobs.rows_of(spark, sink).collect()) == list(range(40))
    assert [(r.batch, r.n) for r in jobs.checkpoints_of(spark, sink).orderBy("batch").collect()] == [(i, 10) for i in range(4)]
    state = jobs.folded(jobs.log_of(spark, log).where("event <> 'requested'")).head()
    assert (state.status, state.attempt_count, state.refused) == ("succeeded", 2, 0)
    failure = jobs.log_of(spark, log).where("event = 'failed'").head().detail
    assert "batch two" in failure and "ana@example.org" not in failure and "token: abc" not in failure and len(failure) <= 400
    assert jobs.run(JOB, log, source(spark, data), sink, progress) == "succeeded" and jobs.rows_of(spark, sink).count() == 40


def test_a_running_job_is_not_started(spark, tmp_path):
    log = str(tmp_path / "log")
    jobs._note(spark, log, JOB, jobs.STARTED, None)
    spark.range(1).write.parquet(str(tmp_path / "data"))
    with pytest.raises(jobs.AlreadyRunning):
        jobs.run(JOB, log, source(spark, str(tmp_path / "data")), str(tmp_path / "sink"), str(tmp_path / "progress"))


def test_logs_of_jobs(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", "v", "t", i, e, at + dt.timedelta(i), e[0]) for i, e in enumerate(["failed", "started", "started", "failed", "succeeded", "started"])]
    rows += [("b", "v", "t", 1, "started", at, None), ("b", "v", "t", 2, "succeeded", at, "fine"), ("c", "v", "t", 1, "failed", at, "x")]
    got = {r.job_id: (r.status, r.attempt_count, r.refused, r.detail) for r in jobs.folded(spark.createDataFrame(rows, jobs.LOG)).collect()}
    assert got == {"a": ("running", 2, 3, None), "b": ("succeeded", 1, 0, "fine"), "c": ("pending", 0, 1, None)}
    assert jobs.folded(spark.createDataFrame([], jobs.LOG)).count() == 0


def test_counted(spark):
    table, said = counted(spark.range(10), "ten", even=F.count_if(F.col("id") % 2 == 0))
    assert said == {"n": 10, "even": 5} and table.count() == 10


OBSERVED = "key string, seq long, fingerprint string, at timestamp"


def plain(rows, times, least):
    out, by = [], {}
    for k, s, f, t in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        last = by.get(k)
        if last and last[0] == f:
            last[1] += 1
        else:
            last = by[k] = [f, 1, t, False]
        if not last[3] and last[1] >= times and (t - last[2]).total_seconds() * 1000 >= least:
            last[3] = True
            out.append((k, f, last[1], last[2], t))
    return sorted(out, key=str)


def observed(seed=2):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    return [(f"k{rng.randrange(4)}", i, rng.choice(["a", "a", "a", "b", None]), start + dt.timedelta(seconds=7 * i + rng.randrange(3))) for i in range(160)]


@pytest.mark.parametrize(("times", "least"), [(2, 0), (3, 60_000), (1, 1), (2, 90_000)])
def test_stable_runs_of_a_table(spark, times, least):
    rows = observed()
    got = stability.stable_runs_of_batch(spark.createDataFrame(rows, OBSERVED), times, least).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, times, least)


def test_stable_runs_of_a_stream(spark, tmp_path):
    rows = observed()
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], OBSERVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stability.stable_runs(stream, 3, 60_000, idle_ms=10**9).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(store)
    assert sorted(map(tuple, spark.table("runs").collect()), key=str) == plain(rows, 3, 60_000)
