"""Structured Streaming twins of the admission operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartulary.operators.limits import Limiter


def rate_limit(calls: DataFrame, *, window_us: int, per_key: int, watermark: str = "1 hour") -> DataFrame:
    """calls (key, ts, id) of a stream with their outcome.

    Calls wait in the key's state until the watermark has passed them and are then
    decided in the order (ts, id), so the result is that of the batch operator
    whatever the order of arrival within the watermark.  State holds the waiting
    calls and at most per_key hits; a key without either is dropped.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, waiting = state.get if state.exists else ([], [])
        waiting = list(map(tuple, waiting))
        for batch in batches:
            waiting += list(zip(batch["ts"].astype("int64").floordiv(1000 if batch["ts"].dtype == "datetime64[ns]" else 1).tolist(), batch["id"].tolist()))
        passed = state.getCurrentWatermarkMs() * 1000
        due, later = sorted(c for c in waiting if c[0] < passed), [c for c in waiting if c[0] >= passed]
        limiter, queue = Limiter(window_us, per_key), deque(hits)
        outcome = [limiter.admit(queue, None, at) for at, _ in due]
        if later or queue:
            state.update((list(queue), later))
            state.setTimeoutTimestamp(max(passed // 1000 + 1, min((c[0] for c in later), default=queue[-1] + window_us if queue else passed) // 1000 + 1))
        else:
            state.remove()
        if due:
            yield pd.DataFrame({"key": key[0], "at": [c[0] for c in due], "id": [c[1] for c in due], "outcome": outcome})

    return calls.withWatermark("ts", watermark).groupBy("key").applyInPandasWithState(decide, "key long, at long, id long, outcome string", "hits array<long>, waiting array<struct<at:long,id:long>>", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(calls: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Calls of each UTC day."""
    return calls.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def debounce(events: DataFrame, *, gap: str, watermark: str = "1 hour") -> DataFrame:
    """The last value of each burst of (key, ts, value), unless it is null."""
    last = events.withWatermark("ts", watermark).groupBy("key", F.session_window("ts", gap)).agg(F.max(F.struct("ts", F.col("value").isNull().alias("cancel"), F.coalesce("value", F.lit("")).alias("value"))).alias("last"))
    return last.where("not last.cancel").select("key", "last.ts", "last.value")


def single_flight(calls: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The first of the calls (key, ts) of each key within the watermark: the one that is computed."""
    return calls.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["key"])


def newest(events: DataFrame, watermark: str = "1 hour", every: str = "1 minute") -> DataFrame:
    """The last (ts, value) of each key in each stretch of time."""
    return events.withWatermark("ts", watermark).groupBy("key", F.window("ts", every)).agg(F.max(F.struct("ts", "value")).alias("last")).select("key", F.col("window.start").alias("start"), "last.ts", "last.value")
