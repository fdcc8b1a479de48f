"""Review logs and observations as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.relations import set_or_reset


def effective_corrections(log: DataFrame, key: str = "item_id") -> DataFrame:
    """The correction in force of each item, updated as actions arrive: the batch fold itself, which aggregates and so
    holds one row of state an item. Late actions are placed by their own time. For update mode."""
    return set_or_reset(log, key, F.struct("created_at", "action_id"), F.when(F.col("action") == "correct", F.col("corrected_payload")), F.col("action") == "reset")


def stable_fingerprints(observations: DataFrame, times: int, idle_ms: int = 600_000) -> DataFrame:
    """(key, fingerprint, n) each time a key has shown one fingerprint `times` times running, once for each run.

    observations (key, seq long, fingerprint, at timestamp). Within a batch they are taken by seq. State is one row a
    key and goes after idle_ms of event time without news; for append mode. stability.stable_runs also asks for a least time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (None, 0)
        out = []
        for value in pd.concat(list(batches)).sort_values("seq")["fingerprint"]:
            n = n + 1 if value == last else 1
            last = value
            if n == times:
                out.append((key[0], value, n))
        state.update((last, n))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_ms)
        yield pd.DataFrame(out, columns=["key", "fingerprint", "n"])

    watermarked = observations.withWatermark("at", f"{idle_ms} milliseconds")
    return watermarked.groupBy("key").applyInPandasWithState(step, "key string, fingerprint string, n long", "last string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_window(events: DataFrame, at: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in windows of time, late ones up to `late` behind."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", "w.end", kind, "n")
