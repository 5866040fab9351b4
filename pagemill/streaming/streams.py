"""Streams of documents, task updates and worker progress."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from pagemill.functions.source import is_document_path, sniff_kind
from pagemill.operators import tasks
from pagemill.session import shared_dir
from pagemill.streaming.completion import ROCKSDB, milliseconds

# --- fixed value: pages in flight, used as back-pressure ---------------------
FILES_PER_TRIGGER = 100
#: How long finished tasks are remembered.
KEEP_TASKS = "7 days"


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Documents as they arrive under ``path``."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return files.where(is_document_path(F.col("path"))).withColumn("kind", sniff_kind(F.col("content")))


def run_available(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Run a stream over everything present and read back what it wrote."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .outputMode(output_mode)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def dedup_events(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop replayed events that arrive within ``delay`` of each other."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


# --- task state --------------------------------------------------------------

TASK_STATE = StructType(
    [
        StructField("task_id", LongType()),
        StructField("status", StringType()),
        StructField("at", TimestampType()),
        StructField("retry_count", IntegerType()),
        StructField("max_retries", IntegerType()),
        StructField("lock_expires_at", TimestampType()),
    ]
)
#: The same with times in microseconds, as the state holds them.
_MICROS = StructType([StructField(f.name, LongType() if f.dataType == TimestampType() else f.dataType) for f in TASK_STATE])
#: Tasks are dealt to so many buckets by a hash. Reading and writing state, timers and results cost much for each key,
#: so a key is a bucket of tasks and not one task.
TASK_BUCKETS = 2048
_BUCKET = StructType([StructField("tasks", StringType()), StructField("timer", LongType())])


def _frame(rows: list[list]) -> pd.DataFrame:
    # as objects, so that numbers stay whole beside nulls
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(_MICROS.names, zip(*rows))})


def _not_before(task: list, held: list) -> bool:
    """Whether an update is as late as the state; one without a time is older than any."""
    return held[2] is None or (task[2] is not None and task[2] >= held[2])


class TaskState(StatefulProcessor):
    """Latest state of the tasks of a bucket; a lease that runs out moves a task on by itself.

    A finished task is forgotten ``keep_ms`` after its last update; open tasks stay. A bucket holds its tasks as a JSON
    list, in the order of ``TASK_STATE``, and has one timer: the next time at which one of them moves on or is forgotten.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", _BUCKET)

    def due(self, task: list) -> int | None:
        """When a task moves on or is forgotten, in milliseconds."""
        _, status, at, _, _, lease = task
        if status == tasks.PROCESSING and lease is not None:
            return lease // 1000 + 1  # a timer runs out at its time, a lease only after it
        if status in (*tasks.FINISHED, tasks.DEAD_LETTER) and at is not None:
            return at // 1000 + self.keep_ms
        return None

    def held(self) -> tuple[dict, int | None]:
        text, timer = self.state.get() or ("[]", None)
        return {task[0]: task for task in json.loads(text)}, timer

    def hold(self, known: dict, timer: int | None) -> None:
        due = min((d for d in map(self.due, known.values()) if d is not None), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if known:
            self.state.update((json.dumps(list(known.values())), due))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self.held()
        told = {}
        for batch in rows:
            for update in json.loads(f"[{','.join(batch['update'])}]"):
                task = list(update.values())
                if task[0] not in known or _not_before(task, known[task[0]]):
                    known[task[0]] = task
                told[task[0]] = None
        self.hold(known, timer)
        yield _frame([known[task_id] for task_id in told])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self.held()
        now = timerValues.getCurrentWatermarkInMs()
        moved = []
        for task in list(known.values()):
            due = self.due(task)
            if due is None or due > now:
                continue
            task_id, status, _, retries, most, lease = task
            if status == tasks.PROCESSING:
                if retries is not None and most is not None and retries < most:
                    task = [task_id, tasks.PENDING, lease, retries + 1, most, None]
                else:
                    task = [task_id, tasks.DEAD_LETTER, lease, retries, most, lease]
                known[task_id] = task
                moved.append(task)
                due = self.due(task)
            if due is not None and due <= now:
                del known[task_id]
        self.hold(known, None)  # the timer that ran out goes by itself
        if moved:
            yield _frame(moved)

    def close(self) -> None:
        pass


def _latest_updates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        latest = frame.sort_values("at", kind="stable", na_position="first").drop_duplicates("task", keep="last")
        yield latest.drop(columns="task")


def stream_task_state(updates: DataFrame, delay: str = "0 seconds", keep: str = KEEP_TASKS, buckets: int = TASK_BUCKETS) -> DataFrame:
    """State of every task after each micro-batch of updates, lease timeouts included.

    A finished task is forgotten ``keep`` after its last update; updates older than the watermark are left out, so none
    of them can open it again. Leases are compared with the event-time watermark, so a replay gives the same result.
    A micro-batch reads and writes the whole buckets of its tasks; ``buckets`` must stay the same for a checkpoint.
    """
    typed = updates.select(*[F.col(f.name).cast(f.dataType) for f in TASK_STATE.fields])
    times = {f.name for f in TASK_STATE if f.dataType == TimestampType()}
    fields = [F.unix_micros(name).alias(name) if name in times else F.col(name) for name in TASK_STATE.names]
    rows = typed.select(
        F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int").alias("bucket"),
        "at",
        F.col("task_id").cast("string").alias("task"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("update"),
    )
    # only the last update of a task counts, so of a batch only that one is shuffled
    states = (
        rows.mapInPandas(_latest_updates, rows.drop("task").schema)
        .withWatermark("at", delay)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=TaskState(milliseconds(updates.sparkSession, keep)),
            outputStructType=_MICROS,
            outputMode="Update",
            timeMode="EventTime",
        )
    )
    return states.select(*[F.timestamp_micros(name).alias(name) if name in times else F.col(name) for name in TASK_STATE.names])


# --- progress ----------------------------------------------------------------


def stream_progress(
    snapshots: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Latest snapshot per worker; ``publish`` gets the totals after each micro-batch.

    The latest snapshots are kept in the query's own output, one row per worker.
    """
    latest = snapshots.groupBy("worker").agg(
        F.max_by(F.struct("completed", "total", "failed", "status", "timestamp"), "timestamp").alias("s")
    )
    flat = latest.select("worker", "s.*")

    def totals(batch: DataFrame, epoch: int) -> None:
        publish(tasks.progress_summary(batch), epoch)

    return (
        flat.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(totals)
        .start()
    )


def stream_finished_documents(
    ready: DataFrame,
    load_regions: Callable[[DataFrame], DataFrame],
    load_pages: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    load_crops: Callable[[DataFrame], DataFrame] | None = None,
    **trigger,
) -> StreamingQuery:
    """Assemble the documents of units as they become complete, with image numbers where crops are given.

    Rules that look at neighbours need whole pages, so they run on the regions of the
    units of a micro-batch, with the same operators as a batch job.
    """
    from pagemill.plans.documents import documents

    def assemble(batch: DataFrame, epoch: int) -> None:
        units = batch.select("unit_id").distinct()
        crops = load_crops(units) if load_crops else None
        write(documents(load_regions(units), load_pages(units), crops), epoch)

    return (
        ready.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(assemble)
        .start()
    )

