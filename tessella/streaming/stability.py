"""Stable states of screens as a stream, and as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STABLE = "key string, fingerprint string, n long, since timestamp, at timestamp"


class _Runs(StatefulProcessor):
    """The run of equal fingerprints that a key is in: what it shows, how often, since when, and whether that was told."""

    def __init__(self, times: int, least_ms: int, idle_ms: int):
        self.times, self.least, self.idle = times, least_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last string, n long, since_ms long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, since, told = self.run.get() if self.run.exists() else (None, 0, 0, False)
        out = []
        for value, at in pd.concat(list(rows)).sort_values(["at", "seq"])[["fingerprint", "at"]].itertuples(index=False):
            ms = at.value // 1_000_000
            if n and value == last:
                n += 1
            else:
                last, n, since, told = value, 1, ms, False
            if not told and n >= self.times and ms - since >= self.least:
                told = True
                out.append((key[0], last, n, pd.Timestamp(since, unit="ms"), at))
        self.run.update((last, n, since, told))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle)
        yield pd.DataFrame(out, columns=["key", "fingerprint", "n", "since", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        yield pd.DataFrame([], columns=["key", "fingerprint", "n", "since", "at"])

    def close(self) -> None:
        pass


def stable_runs(observations: DataFrame, times: int, least_ms: int = 0, idle_ms: int = 600_000, late: str = "1 minute") -> DataFrame:
    """STABLE, once for each run of a key's equal fingerprints that was seen `times` times over at least least_ms.

    observations (key string, seq long, fingerprint string, at timestamp), a stream; within a batch they are taken in order of
    (at, seq). A key has one value of state, which a timer clears after idle_ms of event time without news. For append mode,
    with a state store that has column families (RocksDB). Null fingerprints are equal to each other.
    """
    watermarked = observations.withWatermark("at", late)
    return watermarked.groupBy("key").transformWithStateInPandas(_Runs(times, least_ms, idle_ms), STABLE, "Append", "EventTime")


def stable_runs_of_batch(observations: DataFrame, times: int, least_ms: int = 0) -> DataFrame:
    """The same of a table: gaps and islands. A run's number is that of the changes before it, its first row that fulfils both
    conditions is the answer."""
    order = Window.partitionBy("key").orderBy("at", "seq")
    changed = ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order)) | F.lag(F.lit(1)).over(order).isNull()
    runs = observations.withColumn("run", F.sum(changed.cast("int")).over(order))
    own = Window.partitionBy("key", "run").orderBy("at", "seq")
    counted = runs.withColumns({"n": F.row_number().over(own).cast("long"), "since": F.first("at").over(own)})
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    lasted = (millis("at") - millis("since")) >= least_ms
    good = counted.where((F.col("n") >= times) & lasted)
    first = good.groupBy("key", "run").agg(F.min(F.struct("n", "fingerprint", "since", "at")).alias("f"))
    return first.select("key", "f.fingerprint", "f.n", "f.since", "f.at")
