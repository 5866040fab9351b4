"""Incremental completion of units and related streams.

A unit is complete once it is final, so that its number of regions is known, and that
many distinct regions are recognised. Events come in any order and may be replayed.

One unit may own a large share of all events. Region events are therefore first counted
per ``(unit, bucket)``, where runs of neighbouring ids share a bucket: each bucket remembers the region ids it has seen and passes on
only how many were new in the micro-batch. What reaches the state of a unit is at most
one row per bucket and micro-batch.

What a bucket has seen is kept as intervals in one binary value, which is read and written
once per micro-batch, however many ids arrive; a unit numbered without gaps ends as one
interval per bucket. With an event time, buckets and finished units are forgotten once
the watermark is ``keep`` past their last event.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType, TimestampType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A prime, so that ids numbered in steps of a round number still spread.
BUCKETS = 251
#: Neighbouring region ids that share a bucket, so that a unit of ordinary size has one bucket and not one per region.
RUN = 1024
#: How late an event may come, and how long replays are recognised, where there is an event time.
DELAY, KEEP = "1 hour", "1 day"

PROGRESS_SCHEMA = StructType(
    [
        StructField("unit_id", LongType()),
        StructField("n_new", LongType()),
        StructField("expected", LongType()),
        StructField("at", TimestampType()),
    ]
)
READY_SCHEMA = StructType([StructField("unit_id", LongType()), StructField("expected", LongType())])


def add_to_intervals(seen: bytes, ids: np.ndarray) -> tuple[bytes, int]:
    """Add sorted distinct ``ids`` to disjoint intervals (pairs of first and past-the-last); also how many were new."""
    pairs = np.frombuffer(seen, np.int64).reshape(-1, 2)
    if len(pairs):
        k = np.searchsorted(pairs[:, 0], ids, side="right") - 1
        ids = ids[(k < 0) | (ids >= pairs[np.maximum(k, 0), 1])]
    starts, stops = np.concatenate([pairs[:, 0], ids]), np.concatenate([pairs[:, 1], ids + 1])
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], stops[order]
    gap = starts[1:] > stops[:-1]
    joined = np.column_stack([starts[np.append(True, gap)], stops[np.append(gap, True)]]) if len(starts) else pairs
    return joined.astype(np.int64).tobytes(), len(ids)


class Expiring(StatefulProcessor):
    """State in one value that can be forgotten ``keep_ms`` after its last event; ``keep_ms`` None keeps it for ever."""

    FIELDS: list[StructField] = []

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([*self.FIELDS, StructField("last_ms", LongType())]))

    def put(self, values: tuple, last_ms: int, fresh: bool) -> None:
        """A timer is set once, for new state; it is moved on when it runs out too early."""
        self.state.update((*values, last_ms))
        if fresh and self.keep_ms is not None:
            self.handle.registerTimer(last_ms + self.keep_ms)

    def forgettable(self, values: tuple) -> bool:
        return True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            *values, last_ms = self.state.get()
            ends = last_ms + self.keep_ms
            now = timerValues.getCurrentWatermarkInMs()
            if ends <= now and self.forgettable(tuple(values)):
                self.state.clear()
            else:
                self.handle.registerTimer(max(ends, now + self.keep_ms))
        return iter(())

    def close(self) -> None:
        pass


class NewRegions(Expiring):
    """Counts the region ids of a bucket that were not seen before."""

    FIELDS = [StructField("seen", BinaryType())]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        seen, last_ms = self.state.get() if known else (b"", 0)
        total, at = 0, None
        for batch in rows:
            ids = np.unique(batch["number"].to_numpy(np.int64))
            seen, new = add_to_intervals(bytes(seen), ids)
            total += new
            last_ms = max(last_ms, int(batch["at_ms"].max()))
            newest = batch["at"].max()
            at = newest if at is None or newest > at else at
        if total or not known:
            self.put((seen,), last_ms, not known)
        if total:
            yield pd.DataFrame({"unit_id": [key[0]], "n_new": [total], "expected": pd.array([None], dtype="Int64"), "at": [at]})


class CompleteUnits(Expiring):
    """Emits a unit once, when all expected regions are counted; units that wait are never forgotten."""

    FIELDS = [StructField("done", LongType()), StructField("expected", LongType()), StructField("told", BooleanType())]

    def forgettable(self, values: tuple) -> bool:
        return bool(values[2])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        done, expected, told, last_ms = self.state.get() if known else (0, -1, False, 0)
        for batch in rows:
            last_ms = max(last_ms, int(batch["at_ms"].max()))
            if told:
                continue
            done += int(batch["n_new"].fillna(0).sum())
            given = batch["expected"].dropna()
            if len(given):
                expected = int(given.iloc[0])
        if not told and 0 <= expected <= done:
            self.put((0, -1, True), last_ms, not known)
            yield pd.DataFrame({"unit_id": [key[0]], "expected": [expected]})
        else:
            self.put((done, expected, told), last_ms, not known)


def _without_copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        latest = frame.dropna(subset=["unit_id", "region_id"]).sort_values("at", kind="stable")
        yield latest.drop_duplicates(["unit_id", "region_id"], keep="last")


def milliseconds(spark: SparkSession, interval: str) -> int:
    """Length of an interval as Spark reads it."""
    epoch = F.timestamp_seconds(F.lit(0))
    return spark.range(1).select(F.unix_millis(epoch + F.expr(f"interval {interval}"))).first()[0]


def _timed(df: DataFrame, time: str | None) -> Column:
    return (F.col(time) if time else F.timestamp_seconds(F.lit(0))).cast("timestamp").alias("at")


def _at_ms() -> Column:
    return F.unix_millis("at").alias("at_ms")


def _modes(spark: SparkSession, time: str | None, keep: str) -> tuple[int | None, str]:
    return (milliseconds(spark, keep), "EventTime") if time else (None, "None")


def new_region_counts(
    region_done: DataFrame, buckets: int = BUCKETS, time: str | None = None, delay: str = DELAY, keep: str = KEEP
) -> DataFrame:
    """Counts of regions seen for the first time, from ``unit_id, region_id`` events.

    With an event time, a bucket is forgotten ``keep`` after its last event: a replay is recognised if it comes within
    ``keep`` of the last event of its bucket, and events more than ``delay`` late are left out. Without one all replays
    are recognised and nothing is forgotten; the state then holds the intervals of all units.
    """
    keep_ms, mode = _modes(region_done.sparkSession, time, keep)
    events = region_done.select(F.col("unit_id").cast("long"), F.col("region_id").cast("long"), _timed(region_done, time))
    # copies of an event within a batch go before the shuffle
    unique = events.mapInPandas(_without_copies, events.schema)
    bucket = F.pmod("run", F.lit(buckets)).cast("int").alias("bucket")
    # the runs of a bucket follow each other, so ids without gaps stay one interval
    number = F.expr(f"(run - pmod(run, {buckets})) div {buckets} * {RUN} + pmod(region_id, {RUN})").alias("number")
    numbered = unique.withColumn("run", F.expr(f"(region_id - pmod(region_id, {RUN})) div {RUN}"))
    keyed = numbered.select("unit_id", bucket, number, "at", _at_ms())
    return (
        (keyed.withWatermark("at", delay) if time else keyed)
        .groupBy("unit_id", "bucket")
        .transformWithStateInPandas(
            statefulProcessor=NewRegions(keep_ms),
            outputStructType=PROGRESS_SCHEMA,
            outputMode="Append",
            timeMode=mode,
            eventTimeColumnName="at" if time else "",
        )
    )


def complete_units(
    progress: DataFrame, unit_final: DataFrame, time: str | None = None, delay: str = DELAY, keep: str = KEEP
) -> DataFrame:
    """Units as they become complete, from counts and ``unit_id, expected`` events.

    ``progress`` comes from :func:`new_region_counts`, with an event time if ``time`` names one here. All that stays of
    an emitted unit is one mark, for ``keep`` after its last event where there is an event time.
    """
    keep_ms, mode = _modes(unit_final.sparkSession, time, keep)
    finals = unit_final.select(
        F.col("unit_id").cast("long"), F.lit(0).cast("long").alias("n_new"), F.col("expected").cast("long"), _timed(unit_final, time)
    )
    if time:
        finals = finals.withWatermark("at", delay)
    return (
        progress.select(*[f.name for f in PROGRESS_SCHEMA])
        .unionByName(finals)
        .withColumn("at_ms", _at_ms())
        .groupBy("unit_id")
        .transformWithStateInPandas(
            statefulProcessor=CompleteUnits(keep_ms),
            outputStructType=READY_SCHEMA,
            outputMode="Append",
            timeMode=mode,
        )
    )
