"""The task table: state changes as snapshot to snapshot, listings and reports.

Every operator takes the table and returns a table; ``now`` is always an argument.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions.errors import classify_error, is_retryable

# --- fixed values: task states ----------------------------------------------
PENDING, PROCESSING, COMPLETED, FAILED, CANCELLED, DEAD_LETTER = (
    "pending",
    "processing",
    "completed",
    "failed",
    "cancelled",
    "dead_letter",
)
FINISHED = (COMPLETED, FAILED, CANCELLED)
LOCK_RETRY_MESSAGE = "Lock expired, recovered for retry"
LOCK_DEAD_MESSAGE = "Lock expired and max retries exceeded"


def _now(now: datetime | str) -> Column:
    return F.lit(now).cast("timestamp")


def _set(tasks: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Update some columns of the rows where the condition holds; absent columns are left out."""
    where = F.coalesce(where, F.lit(False))
    return tasks.withColumns(
        {
            name: F.when(where, value.cast(tasks.schema[name].dataType)).otherwise(F.col(name))
            for name, value in values.items()
            if name in tasks.columns
        }
    )


def can_retry() -> Column:
    return F.col("retry_count") < F.col("max_retries")


def _seconds_taken() -> Column:
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("completed_at", "started_at")]
    return (micros[0] - micros[1]) / F.lit(1_000_000.0)


def derive_flags(tasks: DataFrame, now: datetime | str) -> DataFrame:
    lease = F.col("lock_expires_at")
    seconds = _seconds_taken()
    return tasks.withColumns(
        {
            "is_locked": F.coalesce(lease > _now(now), F.lit(False)),
            "is_expired": F.coalesce(lease <= _now(now), F.lit(False)),
            "can_retry": can_retry(),
            "execution_time": seconds,
        }
    )


def _lease_over(now: datetime | str) -> Column:
    return (F.col("status") == PROCESSING) & (F.col("lock_expires_at") < _now(now))


def claimable(tasks: DataFrame, now: datetime | str) -> DataFrame:
    return tasks.where((F.col("status") == PENDING) | _lease_over(now))


def _retry_values(message: Column, now: datetime | str | None) -> dict[str, Column]:
    values = {
        "status": F.lit(PENDING),
        "worker_id": F.lit(None),
        "lock_expires_at": F.lit(None),
        "retry_count": F.col("retry_count") + 1,
        "error_message": message,
        "started_at": F.lit(None),
        "current_step": F.lit(None),
        "progress": F.lit(0.0),
    }
    if now is not None:
        values["last_retry_at"] = _now(now)
    return values


def reset_for_retry(
    tasks: DataFrame, which: Column, message: Column, now: datetime | str | None = None
) -> DataFrame:
    """Back to pending with one more attempt on record, where attempts are left."""
    return _set(tasks, which & can_retry(), **_retry_values(message, now))


def recover_expired(tasks: DataFrame, now: datetime | str) -> DataFrame:
    """Tasks whose lease ran out: another attempt, or the dead letters."""
    tasks = tasks.withColumns({"_over": F.coalesce(_lease_over(now), F.lit(False)), "_again": can_retry()})
    over, again = F.col("_over"), F.col("_again")
    revived = _set(tasks, over & again, **_retry_values(F.lit(LOCK_RETRY_MESSAGE), now))
    dead = _set(
        revived, over & ~again, status=F.lit(DEAD_LETTER), error_message=F.lit(LOCK_DEAD_MESSAGE)
    )
    return dead.drop("_over", "_again")


def handle_failure(
    tasks: DataFrame, which: Column, message: Column, now: datetime | str | None = None
) -> DataFrame:
    """A failed attempt: retried when that makes sense, else a dead letter."""
    kind = classify_error(message)
    tasks = tasks.withColumns(
        {
            "_failed": F.coalesce(which, F.lit(False)),
            "_kind": kind,
            "_again": can_retry() & is_retryable(kind),
            "_message": message,
        }
    )
    revived = _set(tasks, F.col("_failed") & F.col("_again"), **_retry_values(F.col("_message"), now))
    note = F.concat(
        F.lit("Moved to dead letter: "), F.col("_message"), F.lit(" (error_type: "), F.col("_kind"), F.lit(")")
    )
    dead = _set(revived, F.col("_failed") & ~F.col("_again"), status=F.lit(DEAD_LETTER), error_message=note)
    return dead.drop("_failed", "_kind", "_again", "_message")


def retry_delay(retry_count: Column, base: Column, jitter: Column | None = None) -> Column:
    """Seconds to wait: doubling with each attempt, plus up to a tenth, at most an hour.

    ``jitter`` is a number in [0, 1), such as ``F.rand()``; without it the plain delay.
    """
    delay = (base * F.pow(F.lit(2.0), retry_count)).cast("bigint")
    if jitter is not None:
        delay = delay + F.floor(jitter * (F.floor(delay * 0.1) + 1))
    return F.least(delay, F.lit(config.MAX_RETRY_DELAY)).cast("int")


def apply_status(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply one status update per task: ``task_id, status, at`` and an optional message.

    Processing starts the clock; completed, failed and cancelled stop it, dead letters do not.
    """
    renamed = updates.select(
        "task_id",
        F.col("status").alias("_status"),
        F.col("at").alias("_at"),
        (F.col("error_message") if "error_message" in updates.columns else F.lit(None).cast("string")).alias("_message"),
    )
    joined = tasks.join(renamed, "task_id", "left")
    new = F.col("_status")
    changed = _set(joined, new == PROCESSING, started_at=F.col("_at"))
    changed = _set(changed, new.isin(*FINISHED), completed_at=F.col("_at"))
    changed = _set(changed, F.col("_message").isNotNull(), error_message=F.col("_message"))
    return _set(changed, new.isNotNull(), status=new).select(*tasks.columns)


def cancel(tasks: DataFrame, which: Column, now: datetime | str) -> DataFrame:
    """Only pending and processing tasks can be cancelled."""
    open_ = which & F.col("status").isin(PENDING, PROCESSING)
    return _set(
        _set(tasks, open_, completed_at=_now(now)), open_, status=F.lit(CANCELLED)
    )


def clamp_progress(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def weighted_progress(stage: Column, value: Column, weights=config.STAGE_WEIGHTS) -> Column:
    """Overall progress from the progress of one stage."""
    result = None
    for name, base, weight in weights:
        part = F.lit(base) + value * weight
        result = F.when(stage == name, part) if result is None else result.when(stage == name, part)
    return result


def expire_old(
    tasks: DataFrame, now: datetime, days: int = 30, statuses: Sequence[str] = FINISHED
) -> DataFrame:
    """The table without finished tasks older than ``days``."""
    cutoff = F.lit(now - timedelta(days=days))
    old = F.col("status").isin(list(statuses)) & (F.col("completed_at") < cutoff)
    return tasks.where(~F.coalesce(old, F.lit(False)))


def latest_state(events: DataFrame, key: str = "task_id", at: str = "at") -> DataFrame:
    """Current row of every task from its update events; a running maximum needs no sort."""
    rest = [c for c in events.columns if c != key]
    order = [at, *[c for c in ("seq",) if c in events.columns]]
    latest = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return latest.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def task_report(tasks: DataFrame, reports: DataFrame) -> DataFrame:
    """Tasks with their merged document; tasks without one keep their row."""
    return tasks.join(reports, "task_id", "left")


# --- listings ----------------------------------------------------------------


def pending(tasks: DataFrame, limit: int = 10) -> DataFrame:
    return (
        tasks.where(F.col("status") == PENDING)
        .orderBy(F.col("priority").desc(), "created_at", "task_id")
        .limit(limit)
    )


def in_progress(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") == PROCESSING).orderBy("started_at", "task_id")


def expired_leases(tasks: DataFrame, now: datetime | str, limit: int = 100) -> DataFrame:
    return tasks.where(_lease_over(now)).orderBy("lock_expires_at", "task_id").limit(limit)


def _matching(tasks: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    known = [F.col(name) == value for name, value in filters.items() if name in tasks.columns]
    return tasks.where(reduce(lambda a, b: a & b, known)) if known else tasks


def listing(
    tasks: DataFrame,
    status: str | None = None,
    processing_mode: str | None = None,
    priority: int | None = None,
    skip: int = 0,
    limit: int = 100,
) -> DataFrame:
    """One page of the task list, newest first, with the size of the whole list."""
    wanted = {"status": status, "processing_mode": processing_mode, "priority": priority}
    found = _matching(tasks, {k: v for k, v in wanted.items() if v})
    page = found.orderBy(F.col("created_at").desc(), "task_id").offset(skip).limit(limit)
    total = found.agg(F.count(F.lit(1)).alias("total"))  # always one row
    return page.join(F.broadcast(total), F.lit(True), "left")


def find(tasks: DataFrame, skip: int = 0, limit: int = 100, order: str = "task_id", **filters: object) -> DataFrame:
    """Tasks by column values; names that are no column are ignored."""
    return _matching(tasks, filters).orderBy(order).offset(skip).limit(limit)


def count_where(tasks: DataFrame, **filters: object) -> DataFrame:
    return _matching(tasks, filters).agg(F.count(F.lit(1)).alias("n"))


# --- figures -----------------------------------------------------------------


def status_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per status and in total; ``is_total`` tells the total from tasks without a status."""
    return tasks.rollup("status").agg(F.count(F.lit(1)).alias("n"), (F.grouping("status") == 1).alias("is_total"))


def worker_metrics(tasks: DataFrame) -> DataFrame:
    """Started, completed, failed and execution time per worker."""
    seconds = _seconds_taken()
    done = F.col("status") == COMPLETED
    metrics = tasks.where(F.col("worker_id").isNotNull()).groupBy("worker_id").agg(
        F.count_if(F.col("started_at").isNotNull()).alias("tasks_started"),
        F.count_if(done).alias("tasks_completed"),
        F.count_if(F.col("status").isin(FAILED, DEAD_LETTER)).alias("tasks_failed"),
        F.coalesce(F.sum(F.when(done, seconds)), F.lit(0.0)).alias("total_execution_time"),
        F.max(F.when(F.col("status") == PROCESSING, F.col("task_id"))).alias("current_task"),
    )
    average = F.coalesce(F.try_divide("total_execution_time", "tasks_completed"), F.lit(0.0))
    return metrics.withColumns(
        {
            "avg_execution_time": average,
            "state": F.when(F.col("current_task").isNull(), "idle").otherwise("busy"),
        }
    )


def progress_summary(snapshots: DataFrame) -> DataFrame:
    """Totals over the latest snapshot of each worker.

    Snapshots: ``worker, completed, total, failed, status, timestamp``.
    """
    latest = snapshots.groupBy("worker").agg(
        F.max_by(F.struct("completed", "total", "failed", "status"), "timestamp").alias("s")
    )
    status = F.coalesce(F.col("s.status"), F.lit("init"))
    finished = status.isin("done", "done_with_errors") | status.startswith("error")
    return latest.agg(
        F.count(F.lit(1)).alias("workers"),
        F.coalesce(F.sum("s.completed"), F.lit(0)).alias("completed"),
        F.coalesce(F.sum("s.failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.bool_and(finished), F.lit(True)).alias("all_done"),
    )


def failure_list(failures: Sequence[DataFrame]) -> DataFrame:
    """All workers' failed files in one table."""
    return reduce(DataFrame.unionByName, failures)
