"""Synchronisation jobs: a log of what happened to them, and a sink that a broken run can be taken up from.

A job's rows go to the sink batch by batch. Each batch overwrites its own partition, and its checkpoint row another one, so a
batch that is repeated after a failure leaves what it would have left the first time. Spark's checkpoint remembers which
batches were finished.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import privacy

LOG = "job_id string, version string, target string, seq long, event string, at timestamp, detail string"
STARTED, SUCCEEDED, FAILED = "started", "succeeded", "failed"
LONGEST_ERROR = 400


class AlreadyRunning(ValueError):
    pass


def folded(log: DataFrame) -> DataFrame:
    """(job_id, status, attempt_count, started_at, finished_at, detail, refused): each job after its log.

    A start is accepted unless the event before it is one, as the job runs then; an end is accepted after a start only. What
    is refused changes nothing but its count. Jobs without an accepted event are pending. Equal seq are ordered by event.
    """
    is_start = F.col("event") == STARTED
    before = F.lag(is_start).over(Window.partitionBy("job_id").orderBy("seq", "event"))
    runs = F.coalesce(before, F.lit(False))
    events = log.withColumn("ok", F.when(is_start, ~runs).otherwise(runs))
    ok, last = F.col("ok"), F.struct("seq", "event")
    latest = lambda value, test: F.max_by(F.when(test, value), F.when(test, last))
    out = events.groupBy("job_id").agg(
        latest(F.col("event"), ok).alias("e"), F.count_if(ok & is_start).alias("attempt_count"), latest(F.col("at"), ok & is_start).alias("started_at"),
        latest(F.struct(F.when(~is_start, F.col("at")).alias("at"), F.when(~is_start, F.col("detail")).alias("detail")), ok).alias("end"), F.count_if(~ok).alias("refused"),
    )
    status = F.when(F.col("e") == STARTED, "running").otherwise(F.coalesce("e", F.lit("pending")))
    return out.select("job_id", status.alias("status"), "attempt_count", "started_at", F.col("end.at").alias("finished_at"), F.col("end.detail").alias("detail"), "refused")


def listed(jobs: DataFrame, version: str | None = None, status: str | None = None) -> DataFrame:
    """Jobs (with version, status, requested_at) of a version and status, the last requested first."""
    kept = jobs if version is None else jobs.where(F.col("version") == version)
    kept = kept if status is None else kept.where(F.col("status") == status)
    return kept.orderBy(F.desc("requested_at"), "job_id")


def _note(spark: SparkSession, path: str, job: tuple[str, str, str], event: str, detail: str | None) -> None:
    row = (*job, time.time_ns(), event, datetime.now(UTC).replace(tzinfo=None), detail)
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(path)


def log_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def safe_error(error: BaseException, limit: int = LONGEST_ERROR) -> str:
    """An error's text without sensitive values, cut to limit."""
    said = " ".join(str(error).split())
    for pattern in privacy.compiled():
        said = pattern.sub(" ", said)
    return " ".join(said.split())[:limit] or type(error).__name__


def batch_sink(sink: str, before: Callable[[DataFrame, int], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows to sink/rows, one row about the batch to sink/checkpoints, both in the batch's own partition.
    The rows are counted as they are written. `before` may change a batch, or fail."""

    def put(df: DataFrame, batch: int, folder: str) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{sink}/{folder}")

    def write(df: DataFrame, batch: int) -> None:
        seen = Observation(f"batch-{batch}")
        rows = before(df, batch) if before else df
        put(rows.observe(seen, F.count(F.lit(1)).alias("n")), batch, "rows")
        put(df.sparkSession.range(1).select(F.lit(seen.get["n"]).alias("n"), F.current_timestamp().alias("at")), batch, "checkpoints")

    return write


def rows_of(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/rows").drop("batch")


def checkpoints_of(spark: SparkSession, sink: str) -> DataFrame:
    """(batch, n, at), a row a finished batch."""
    return spark.read.parquet(f"{sink}/checkpoints").select("batch", "n", "at")


def run(job: tuple[str, str, str], log: str, source: DataFrame, sink: str, progress: str, before: Callable[[DataFrame, int], DataFrame] | None = None) -> str:
    """Runs a job (id, version, target) over what its streaming source has now, and returns its status.

    A job that runs is not started again (AlreadyRunning). A failure is logged without sensitive values and returned, not
    raised; the next run goes on with the batch that failed. progress is the folder of Spark's own checkpoint, and all folders
    are shared ones.
    """
    spark = source.sparkSession
    _note(spark, log, job, "requested", None)
    state = folded(log_of(spark, log).where((F.col("job_id") == job[0]) & (F.col("event") != "requested"))).select("status").head()
    if state and state[0] == "running":
        raise AlreadyRunning(f"job {job[0]} is running")
    _note(spark, log, job, STARTED, None)
    write, caught = batch_sink(sink, before), []

    def remembered(df: DataFrame, batch: int) -> None:
        try:
            write(df, batch)
        except Exception as e:
            caught.append(e)  # the query tells of it in a long trace
            raise

    try:
        query = source.writeStream.foreachBatch(remembered).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
    except Exception as e:  # whatever ends a run is the job's outcome
        _note(spark, log, job, FAILED, safe_error(caught[-1] if caught else e))
        return FAILED
    _note(spark, log, job, SUCCEEDED, None)
    return SUCCEEDED
