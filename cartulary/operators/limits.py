"""Admission control: sliding-window limits, daily quotas, debouncing, single flight."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Limiter:
    """The transition of the limiter, shared by batch and stream: rejected calls leave no trace."""

    def __init__(self, window: int, per_key: int, overall: int | None = None):
        self.window, self.per_key, self.overall = window, per_key, overall

    def admit(self, hits: deque, everyone: deque | None, now: int) -> str:
        """ok, key or global; hits that are a whole window old no longer count."""
        for queue in (hits, everyone):
            while queue and now - queue[0] >= self.window:
                queue.popleft()
        if everyone is not None and len(everyone) >= self.overall:
            return "global"
        if len(hits) >= self.per_key:
            return "key"
        hits.append(now)
        if everyone is not None:
            everyone.append(now)
        return "ok"


def rate_limit(calls: DataFrame, *, window_us: int, per_key: int, overall: int | None = None) -> DataFrame:
    """calls (key, at, id) with their outcome, in the order (at, id); at in microseconds.

    Calls are sorted within hash partitions and folded as a stream: a task holds
    the hits of one key, at most as many as the limit, whatever the key's size.  An
    overall limit couples all keys, but only within stretches of time without a
    pause of a window; each stretch is folded by itself.
    """
    if overall is None:
        dealt = calls.withColumn("stretch", F.lit(0).cast("long")).repartition("key").sortWithinPartitions("key", "at", "id")
    else:
        slot = F.floor(F.col("at") / window_us).cast("long")
        slots = calls.select(slot.alias("slot")).distinct()
        # As many rows as there are windows in the time that the calls span.
        gap = F.when(F.col("slot") - F.lag("slot").over(Window.orderBy("slot")) <= 1, 0).otherwise(1)
        stretches = slots.withColumn("gap", gap).withColumn("stretch", F.sum("gap").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
        dealt = calls.withColumn("slot", slot).join(stretches.select("slot", "stretch"), "slot").drop("slot").repartition("stretch").sortWithinPartitions("stretch", "at", "id")
    limiter = Limiter(window_us, per_key, overall)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hits, everyone = None, {}, deque()
        for batch in batches:
            out = []
            for key, at, stretch in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "stretch"))):
                group = (key, None) if limiter.overall is None else (None, stretch)
                if group != last:
                    last, hits, everyone = group, {}, deque()
                if len(hits) > 2000:
                    hits = {k: q for k, q in hits.items() if q and at - q[-1] < limiter.window}
                out.append(limiter.admit(hits.setdefault(key, deque()), None if limiter.overall is None else everyone, at))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), batch.column("id"), pa.array(out, pa.string())], ["key", "at", "id", "outcome"])

    return dealt.select("key", "at", "id", "stretch").mapInArrow(fold, "key long, at long, id long, outcome string")


def daily_quota(calls: DataFrame, *, cap: int, failed: Column, day: Column) -> DataFrame:
    """Outcome of calls (at, id) under a daily cap whose failed calls are given back at once.

    A call is rejected if as many calls of its day before it were neither rejected
    nor failed as the cap allows; that needs no recursion, since a running count of
    the day's calls that do not fail reaches the cap exactly there.
    """
    before = F.sum(F.when(failed, 0).otherwise(1)).over(Window.partitionBy("day").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1))
    return calls.withColumn("day", day).withColumn("outcome", F.when(F.coalesce(before, F.lit(0)) >= cap, "rejected").when(failed, "refunded").otherwise("ok"))


def debounce(events: DataFrame, *, gap_us: int) -> DataFrame:
    """The last event (key, at, id, value) of each burst, unless its value is null; a pause of the gap ends a burst."""
    following = F.lead("at").over(Window.partitionBy("key").orderBy("at", "id"))
    return events.withColumn("following", following).where(F.col("following").isNull() | (F.col("following") - F.col("at") >= gap_us)).where("value is not null").drop("following")


def latest_only(events: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of the newest version of their key; results of older requests are discarded."""
    newest = events.groupBy(key).agg(F.max(version).alias(version))
    return events.join(newest, [key, version])


def single_flight(calls: DataFrame, cache: DataFrame, key: str, order: list[str]) -> DataFrame:
    """calls with served: hit if the key was in the cache, computed for the first call of another key, shared for the rest."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    known = cache.select(key).distinct().withColumn("known", F.lit(True))
    return calls.join(known, key, "left").withColumn("served", F.when(F.col("known"), "hit").when(first, "computed").otherwise("shared")).drop("known")
