"""Queries on the task table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pagemill.operators import tasks
from pagemill.plans.catalog.registry import query
from pagemill.plans.catalog.text_queries import sql_error
from pagemill.plans.fixtures import Inputs, duckdb_with

NOW = datetime(1995, 6, 1)
TS = "timestamp '1995-06-01'"
OVER = f"(status='processing' and lock_expires_at < {TS})"
AGAIN = "retry_count < max_retries"
STATE = ["task_id", "status", "retry_count", "worker_id", "error_message", "started_at", "completed_at", "lock_expires_at"]


def _sql(body: str) -> str:
    return duckdb_with(["fx_tasks"], body)


def _update(where: str, **values: str) -> str:
    """Select of the state columns with some replaced where a condition holds."""
    columns = [f"case when {where} then {values[c]} else {c} end as {c}" if c in values else c for c in STATE]
    return "select " + ", ".join(columns)


_RETRY = {
    "status": "'pending'",
    "retry_count": "retry_count+1",
    "worker_id": "null",
    "started_at": "null",
    "lock_expires_at": "null",
}


@query(
    "task_flags",
    _sql(
        f"""select task_id, coalesce(lock_expires_at > {TS}, false) as is_locked, coalesce(lock_expires_at <= {TS}, false) as is_expired,
{AGAIN} as can_retry, epoch(completed_at)-epoch(started_at) as execution_time from fx_tasks"""
    ),
)
def _(i: Inputs):
    flags = tasks.derive_flags(i.tasks(), NOW)
    return flags.select("task_id", "is_locked", "is_expired", "can_retry", "execution_time")


@query("claimable", _sql(f"select task_id from fx_tasks where status='pending' or {OVER}"))
def _(i: Inputs):
    return tasks.claimable(i.tasks(), NOW).select("task_id")


@query("reset_for_retry", _sql(_update(f"status='failed' and {AGAIN}", error_message="'again'", **_RETRY) + " from fx_tasks"))
def _(i: Inputs):
    return tasks.reset_for_retry(i.tasks(), F.col("status") == "failed", F.lit("again"), NOW).select(*STATE)


@query(
    "recover_expired",
    _sql(
        f"""with revived as (select *, {OVER} and {AGAIN} as again, {OVER} and not ({AGAIN}) as dead from fx_tasks)
select task_id, case when again then 'pending' when dead then 'dead_letter' else status end as status, case when again then retry_count+1 else retry_count end as retry_count,
case when not again then worker_id end as worker_id, case when again then 'Lock expired, recovered for retry' when dead then 'Lock expired and max retries exceeded' else error_message end as error_message,
case when not again then started_at end as started_at, completed_at, case when not again then lock_expires_at end as lock_expires_at
from (select * replace (coalesce(again, false) as again, coalesce(dead, false) as dead) from revived) t"""
    ),
)
def _(i: Inputs):
    return tasks.recover_expired(i.tasks(), NOW).select(*STATE)


@query(
    "handle_failure",
    _sql(
        f"""with failed as (select *, {sql_error('error_message')} as kind from fx_tasks),
judged as (select *, status='processing' and {AGAIN} and kind not in ('validation_error', 'not_found') as again, status='processing' and not ({AGAIN} and kind not in ('validation_error', 'not_found')) as dead from failed)
select task_id, case when again then 'pending' when dead then 'dead_letter' else status end as status, case when again then retry_count+1 else retry_count end as retry_count,
case when not again then worker_id end as worker_id, case when dead then 'Moved to dead letter: ' || error_message || ' (error_type: ' || kind || ')' else error_message end as error_message,
case when not again then started_at end as started_at, completed_at, case when not again then lock_expires_at end as lock_expires_at from judged"""
    ),
)
def _(i: Inputs):
    failed = tasks.handle_failure(i.tasks(), F.col("status") == "processing", F.col("error_message"), NOW)
    return failed.select(*STATE)


@query("retry_delay", _sql("select task_id, cast(least(retry_delay*pow(2, retry_count), 3600) as int) as delay from fx_tasks"))
def _(i: Inputs):
    return i.tasks().select("task_id", tasks.retry_delay(F.col("retry_count"), F.col("retry_delay")).alias("delay"))


_UPDATES = "updates as (select task_id, case task_id%5 when 0 then 'processing' when 1 then 'completed' when 2 then 'cancelled' when 3 then 'dead_letter' else 'failed' end as s, created_at + interval 10 day as t from fx_tasks where task_id%2=0)"


@query(
    "apply_status",
    _sql(
        f"""with {_UPDATES}
select f.task_id, coalesce(s, status) as status, retry_count, worker_id, error_message, case when s='processing' then t else started_at end as started_at,
case when s in ('completed', 'failed', 'cancelled') then t else completed_at end as completed_at, lock_expires_at from fx_tasks f left join updates using (task_id)"""
    ),
)
def _(i: Inputs):
    new = (
        F.when(F.col("task_id") % 5 == 0, "processing")
        .when(F.col("task_id") % 5 == 1, "completed")
        .when(F.col("task_id") % 5 == 2, "cancelled")
        .when(F.col("task_id") % 5 == 3, "dead_letter")
        .otherwise("failed")
    )
    updates = i.tasks().where("task_id % 2 = 0").select(
        "task_id", new.alias("status"), (F.col("created_at") + F.expr("interval 10 days")).alias("at")
    )
    return tasks.apply_status(i.tasks(), updates).select(*STATE)


@query(
    "cancel",
    _sql(_update("priority=4 and status in ('pending', 'processing')", status="'cancelled'", completed_at=TS) + " from fx_tasks"),
)
def _(i: Inputs):
    return tasks.cancel(i.tasks(), F.col("priority") == 4, NOW).select(*STATE)


@query(
    "progress_values",
    _sql(
        """select task_id, cast(least(greatest(task_id%150-20, 0), 100) as double) as clamped, case task_id%3 when 0 then 0.0::double+(task_id%101)*0.2::double when 1 then 20.0::double+(task_id%101)*0.65::double
else 85.0::double+(task_id%101)*0.15::double end as overall from fx_tasks"""
    ),
)
def _(i: Inputs):
    stage = F.element_at(F.array(F.lit("convert"), F.lit("recognise"), F.lit("merge")), (F.col("task_id") % 3 + 1).cast("int"))
    return i.tasks().select(
        "task_id",
        tasks.clamp_progress((F.col("task_id") % 150 - 20).cast("double")).alias("clamped"),
        tasks.weighted_progress(stage, F.col("task_id") % 101).alias("overall"),
    )


@query(
    "expire_old",
    _sql(
        f"""select task_id, status from fx_tasks where not coalesce(status in ('completed', 'failed', 'cancelled') and completed_at < {TS} - interval 30 day, false)"""
    ),
)
def _(i: Inputs):
    return tasks.expire_old(i.tasks(), NOW).select("task_id", "status")


@query(
    "latest_task_state",
    duckdb_with(
        [],
        "select user_id as task_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as at from events group by 1",
    ),
)
def _(i: Inputs):
    events = i.table("events").select(
        F.col("user_id").alias("task_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")
    )
    return tasks.latest_state(events).select("task_id", "status", "at")


@query(
    "task_report",
    duckdb_with(
        ["fx_tasks", "fx_regions"],
        """with reports as (select unit_id as task_id, count(*) as n_blocks from fx_regions group by 1)
select task_id, status, n_blocks from fx_tasks left join reports using (task_id)""",
    ),
)
def _(i: Inputs):
    reports = i.regions().groupBy(F.col("unit_id").alias("task_id")).agg(F.count(F.lit(1)).alias("n_blocks"))
    return tasks.task_report(i.tasks(), reports).select("task_id", "status", "n_blocks")


# --- listings ----------------------------------------------------------------


@query("pending", _sql("select task_id, priority, created_at from fx_tasks where status='pending' order by priority desc, created_at, task_id limit 25"))
def _(i: Inputs):
    return tasks.pending(i.tasks(), 25).select("task_id", "priority", "created_at")


@query("in_progress", _sql("select task_id, started_at from fx_tasks where status='processing'"))
def _(i: Inputs):
    return tasks.in_progress(i.tasks()).select("task_id", "started_at")


@query("expired_leases", _sql(f"select task_id from fx_tasks where {OVER} order by lock_expires_at, task_id limit 40"))
def _(i: Inputs):
    return tasks.expired_leases(i.tasks(), NOW, 40).select("task_id")


@query(
    "task_listing",
    _sql(
        "select task_id, status, created_at, (select count(*) from fx_tasks where status='failed' and priority=2) as total from fx_tasks where status='failed' and priority=2 order by created_at desc, task_id limit 20 offset 30"
    ),
)
def _(i: Inputs):
    page = tasks.listing(i.tasks(), status="failed", priority=2, skip=30, limit=20)
    return page.select("task_id", "status", "created_at", "total")


@query("find_tasks", _sql("select task_id, status from fx_tasks where status='failed' and retry_count=2 order by task_id limit 10 offset 5"))
def _(i: Inputs):
    return tasks.find(i.tasks(), 5, 10, status="failed", retry_count=2, nonsense=1).select("task_id", "status")


@query(
    "ordered_results",
    _sql("select task_id, cast(row_number() over (order by created_at, task_id)-1 as bigint) as position from fx_tasks"),
)
def _(i: Inputs):
    from pagemill.operators.ordering import global_rank

    return global_rank(i.tasks().select("task_id", "created_at"), ["created_at", "task_id"], "position").select(
        "task_id", "position"
    )


# --- figures -----------------------------------------------------------------


@query("status_counts", _sql("select status, count(*) as n, grouping(status) = 1 as is_total from fx_tasks group by rollup (status)"))
def _(i: Inputs):
    return tasks.status_counts(i.tasks())


@query("count_where", _sql("select count(*) as n from fx_tasks where status='failed' and priority=2"))
def _(i: Inputs):
    return tasks.count_where(i.tasks(), status="failed", priority=2, nonsense=3)


_WORKERS = "workers as (select *, 'w' || (task_id%7) as w from fx_tasks)"


@query(
    "worker_metrics",
    _sql(
        f"""with {_WORKERS}
select w as worker_id, count(started_at) as tasks_started, count(*) filter (where status='completed') as tasks_completed, count(*) filter (where status in ('failed', 'dead_letter')) as tasks_failed,
coalesce(sum(epoch(completed_at)-epoch(started_at)) filter (where status='completed'), 0)::double as total_execution_time,
coalesce(sum(epoch(completed_at)-epoch(started_at)) filter (where status='completed') / nullif(count(*) filter (where status='completed'), 0), 0)::double as avg_execution_time,
case when count(*) filter (where status='processing') > 0 then 'busy' else 'idle' end as state from workers group by 1"""
    ),
)
def _(i: Inputs):
    rows = i.tasks().withColumn("worker_id", F.concat(F.lit("w"), (F.col("task_id") % 7).cast("string")))
    return tasks.worker_metrics(rows).drop("current_task")


_SNAPSHOTS = """snapshots as (select user_id%8 as worker, event_id as seq, ts, event_id%100 as completed, event_id%7 as failed,
  case when event_id%2=0 then 'done' else 'running' end as status from events)"""


def snapshots(events):
    number = F.col("event_id")
    return events.select(
        (F.col("user_id") % 8).alias("worker"),
        (number % 100).alias("completed"),
        F.lit(100).cast("bigint").alias("total"),
        (number % 7).alias("failed"),
        F.when(number % 2 == 0, "done").otherwise("running").alias("status"),
        F.col("ts").alias("timestamp"),
    )


PROGRESS_SQL = duckdb_with(
    [],
    f"""with {_SNAPSHOTS}, latest as (select worker, arg_max(completed, ts) as completed, arg_max(failed, ts) as failed, arg_max(status, ts) as status from snapshots group by 1)
select count(*) as workers, sum(completed)::bigint as completed, sum(failed)::bigint as failed, bool_and(status='done') as all_done from latest""",
)


@query("progress_summary", PROGRESS_SQL)
def _(i: Inputs):
    return tasks.progress_summary(snapshots(i.table("events")))


@query(
    "failure_list",
    _sql("select task_id, error_message from fx_tasks where status='failed' union all select task_id, error_message from fx_tasks where status='dead_letter'"),
)
def _(i: Inputs):
    lists = [i.tasks().where(F.col("status") == s).select("task_id", "error_message") for s in ("failed", "dead_letter")]
    return tasks.failure_list(lists)


@query("distinct_paths", duckdb_with([], "select distinct url as path from pages"))
def _(i: Inputs):
    return i.table("pages").select(F.col("url").alias("path")).dropDuplicates(["path"])
