"""Queries that run as streams over the given tables and read back their output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.plans import fixtures
from pagemill.plans.catalog.document_queries import _TEXTS
from pagemill.plans.catalog.registry import query
from pagemill.plans.catalog.task_queries import PROGRESS_SQL, snapshots
from pagemill.plans.fixtures import Inputs, duckdb_with
from pagemill.session import shared_dir
from pagemill.sources import store
from pagemill.streaming import completion, streams


def _stream(i: Inputs, table: str):
    # the glob makes the single file of the table a source that can be streamed
    schema = i.table(table).schema
    return i.spark.readStream.schema(schema).parquet(f"{i.sf_dir}/{table}*.parquet")


def _ready_units(i: Inputs):
    events = i._sql(fixtures.UNIT_EVENTS, events=_stream(i, "events"))
    # what a unit expects comes with its final event, so some units still wait
    finals = events.where("kind = 'unit_final'").select("unit_id", "ts", (F.lit(15) + F.col("unit_id") % 6).alias("expected"))
    # the events of the table lie in no order of time, so none may count as late
    timed = {"time": "ts", "delay": "36500 days", "keep": "1 day"}
    counts = completion.new_region_counts(events.where("kind = 'region_done'"), **timed)
    return completion.complete_units(counts, finals, **timed)


_READY = """ready as (select unit_id, 15+unit_id%6 as expected from fx_unit_events where kind='region_done'
  and unit_id in (select unit_id from fx_unit_events where kind='unit_final') group by 1 having count(distinct region_id) >= 15+unit_id%6)"""


@query("stream_unit_completion", duckdb_with(["fx_unit_events"], f"with {_READY}\nselect unit_id, expected from ready"))
def _(i: Inputs):
    return streams.run_available(_ready_units(i))


@query(
    "stream_finished_documents",
    duckdb_with(
        ["fx_regions", "fx_doc_pages", "fx_crops", "fx_unit_events"],
        f"with {_TEXTS},\n{_READY}\nselect unit_id, 0 as part_page, 0 as part_seq, n_pages, n_regions, markdown from docs join ready using (unit_id)",
        True,
    ),
)
def _(i: Inputs):
    folder = f"{shared_dir(i.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    ready = streams.run_available(_ready_units(i))
    ready.write.parquet(f"{folder}/ready")
    units = i.spark.readStream.schema(ready.schema).parquet(f"{folder}/ready")
    tables = {"regions": i.regions(), "pages": i.doc_pages(), "crops": i.crops()}
    for name, rows in tables.items():
        store.write_units(rows, f"{folder}/{name}")

    def load(name: str):
        return lambda wanted: store.read_units(store.open_store(i.spark, f"{folder}/{name}", tables[name].schema), wanted)

    def write(documents, epoch: int) -> None:
        documents.select("unit_id", "part_page", "part_seq", "n_pages", "n_regions", "markdown").write.mode("overwrite").parquet(
            f"{folder}/documents/epoch={epoch}"
        )

    streams.stream_finished_documents(
        units,
        load("regions"),
        load("pages"),
        write,
        f"{folder}/state",
        load("crops"),
    ).awaitTermination()
    return i.spark.read.parquet(f"{folder}/documents").drop("epoch")


@query(
    "regions_of_units",
    duckdb_with(
        ["fx_regions"],
        "select unit_id, page_idx, idx, native_label, content, bx1, by1, bx2, by2 from fx_regions where unit_id in (select user_id from events where event_type = 'signup')",
    ),
)
def _(i: Inputs):
    path = f"{shared_dir(i.spark).rstrip('/')}/units-{uuid.uuid4().hex}"
    regions = i.regions()
    store.write_units(regions, path)
    wanted = i.table("events").where("event_type = 'signup'").select(F.col("user_id").alias("unit_id"))
    return store.read_units(store.open_store(i.spark, path, regions.schema), wanted)


@query("stream_progress", PROGRESS_SQL)
def _(i: Inputs):
    folder = f"{shared_dir(i.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def publish(totals, epoch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{folder}/totals")

    streams.stream_progress(snapshots(_stream(i, "events")), publish, f"{folder}/state").awaitTermination()
    return i.spark.read.parquet(f"{folder}/totals")


@query(
    "stream_task_state",
    duckdb_with(
        ["fx_tasks"],
        """with horizon as (select max(created_at) as h from fx_tasks)
select task_id, status, retry_count from fx_tasks
union all select task_id, case when retry_count < max_retries then 'pending' else 'dead_letter' end, case when retry_count < max_retries then retry_count+1 else retry_count end
from fx_tasks, horizon where status='processing' and lock_expires_at < h""",
    ),
)
def _(i: Inputs):
    updates = i._sql(fixtures.TASKS, orders=_stream(i, "orders")).withColumnRenamed("created_at", "at")
    return streams.run_available(streams.stream_task_state(updates), "append").select("task_id", "status", "retry_count")


@query(
    "stream_dedup_events",
    duckdb_with([], "select distinct user_id, event_type from events"),
)
def _(i: Inputs):
    events = _stream(i, "events").select("user_id", "event_type", "ts")
    kept = streams.dedup_events(events, ["user_id", "event_type"], "ts", "3650 days")
    return streams.run_available(kept).select("user_id", "event_type")
