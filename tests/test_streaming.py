"""Streams fed in small pieces give what a batch gives."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from pagemill.sources import store
from pagemill.streaming import completion, streams


def feed(spark, tmp_path, name, schema, batches):
    """One file per micro-batch."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{k:02d}"))
    frame = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return frame.parquet(str(folder))


def test_completion_in_any_order(spark, tmp_path):
    done = feed(
        spark, tmp_path, "done", "unit_id bigint, region_id bigint",
        [[(1, 1), (2, 1)], [(1, 1), (1, 2)], [(2, 2), (4, 1)], [(1, 2), (2, 2)]],
    )
    final = feed(spark, tmp_path, "final", "unit_id bigint, expected bigint", [[(3, 0)], [(2, 2)], [(1, 2), (4, 2)]])
    ready = completion.complete_units(completion.new_region_counts(done, buckets=3), final)
    rows = [(r.unit_id, r.expected) for r in streams.run_available(ready).collect()]
    assert sorted(rows) == [(1, 2), (2, 2), (3, 0)]  # each once; unit 4 still waits


def test_neighbouring_regions_share_their_state(spark, tmp_path):
    ids = [*range(200), *range(-30, 0), *range(251 * 1024, 251 * 1024 + 40)]
    first = [(u, k) for u in (1, 2, 3) for k in ids]
    again = [(1, k) for k in ids] + [(2, 200), (2, -31), (2, 10**12)]
    done = feed(spark, tmp_path, "done", "unit_id bigint, region_id bigint", [first, again])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", completion.ROCKSDB)
    try:
        query = (
            completion.new_region_counts(done).writeStream.format("memory").queryName("new_regions")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    counted = {r.unit_id: r.n for r in spark.table("new_regions").groupBy("unit_id").agg(F.sum("n_new").alias("n")).collect()}
    assert counted == {1: 270, 2: 273, 3: 270}
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows[-1] == 7, rows  # buckets 0 and 250 of each unit and one for the far id, not one per region


def test_intervals():
    rng = np.random.default_rng(1)
    for _ in range(200):
        seen, ids = b"", set()
        for _ in range(6):
            add = np.unique(rng.integers(-20, 40, rng.integers(0, 15)))
            seen, n = completion.add_to_intervals(seen, add)
            assert n == len(set(add.tolist()) - ids)
            ids |= set(add.tolist())
            pairs = np.frombuffer(seen, np.int64).reshape(-1, 2).tolist()
            assert sorted(k for a, b in pairs for k in range(a, b)) == sorted(ids)
            assert all(b < c for (_, b), (c, _) in zip(pairs, pairs[1:]))  # neighbours are joined


def test_state_is_forgotten_after_emission(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    far = [[(100 + h, 0, at(h))] for h in (60, 61)]  # later events, so that time passes
    done = feed(
        spark, tmp_path, "done", "unit_id bigint, region_id bigint, ts timestamp",
        [[(1, k, at(0)) for k in range(500)], [(1, k, at(1)) for k in range(500)], [(2, 1, at(2)), (3, 7, at(2))], *far],
    )
    final = feed(
        spark, tmp_path, "final", "unit_id bigint, expected bigint, ts timestamp",
        [[(1, 500, at(1))], [(2, 1, at(2))], [(1, 500, at(3))], [(100 + h, 2, at(h)) for h in (60,)], [(100 + h, 2, at(h)) for h in (61,)]],
    )
    timed = {"time": "ts", "delay": "1 hour", "keep": "10 hours"}
    counts = completion.new_region_counts(done, buckets=3, **timed)
    ready = completion.complete_units(counts, final, **timed)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", completion.ROCKSDB)
    try:
        query = (
            ready.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = [(r.unit_id, r.expected) for r in spark.table("told").collect()]
    assert sorted(rows) == [(1, 500), (2, 1)]  # each once, replays or not; the others wait
    last = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]
    most = [max(p["stateOperators"][k]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) for k in range(2)]
    # units 3, 160 and 161 wait; of the others no row is left, and of the buckets those of the last two events
    assert all(now < before for now, before in zip(last, most)), (last, most)


def test_store_prunes_folders(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id % 500 as unit_id", "id as n")
    path = str(tmp_path / "store")
    store.write_units(rows, path, slots=16)
    store.write_units(spark.createDataFrame([(None, -1), (3, -2)], "unit_id bigint, n bigint"), path, slots=16)
    stored = store.open_store(spark, path, rows.schema)
    wanted = spark.createDataFrame([(3,), (3,), (77,), (9999,)], "unit_id bigint")
    got = store.read_units(stored, wanted, slots=16)
    assert got.columns == ["unit_id", "n"]
    assert sorted(r.n for r in got.collect()) == [-2, 3, 77, 503, 577, 1003, 1077, 1503, 1577]
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(unit_slot" in scan or "PartitionFilters: [unit_slot" in scan, scan
    assert store.read_units(stored, wanted.limit(0), slots=16).count() == 0


def test_lease_timeout(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    schema = "task_id bigint, status string, at timestamp, retry_count int, max_retries int, lock_expires_at timestamp"
    updates = feed(
        spark, tmp_path, "tasks", schema,
        [
            [(1, "processing", at(0), 0, 3, at(5)), (2, "processing", at(0), 3, 3, at(5)), (3, "processing", at(1), 0, 3, at(5))],
            [(3, "completed", at(3), 0, 3, None)],
            [(9, "pending", at(60), 0, 3, None)],
        ],
    )
    rows = streams.run_available(streams.stream_task_state(updates), "append").collect()
    latest = {}
    for r in sorted(rows, key=lambda r: (r.at, r.status != "processing")):
        latest[r.task_id] = (r.status, r.retry_count)
    assert latest[1] == ("pending", 1)
    assert latest[2] == ("dead_letter", 3)
    assert latest[3] == ("completed", 0)


def test_a_lease_ends_after_its_time(spark, tmp_path):
    at = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    schema = "task_id bigint, status string, at timestamp, retry_count int, max_retries int, lock_expires_at timestamp"
    leases = [(k, "processing", at(0), 0, 3, at(ms)) for k, ms in ((1, 999), (2, 1000), (3, 1001))]
    updates = feed(spark, tmp_path, "tasks", schema, [leases, [(9, "pending", at(1000), 0, 3, None)]])
    rows = streams.run_available(streams.stream_task_state(updates), "append").collect()
    assert sorted(r.task_id for r in rows if r.retry_count == 1) == [1]  # the others have not run out by then


def test_finished_tasks_are_forgotten(spark, tmp_path):
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    schema = "task_id bigint, status string, at timestamp, retry_count int, max_retries int, lock_expires_at timestamp"
    days = [[(k, "completed", at(d), 0, 3, None) for k in range(50)] for d in (0,)] + [[(100 + d, "pending", at(d), 0, 3, None)] for d in (3, 20, 21)]
    updates = feed(spark, tmp_path, "tasks", schema, days)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", completion.ROCKSDB)
    try:
        query = (
            streams.stream_task_state(updates, keep="5 days").writeStream.format("memory").queryName("task_states")
            .option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert spark.table("task_states").count() == 53
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) > 50 and rows[-1] < 20, rows


def test_tasks_share_buckets_of_state(spark, tmp_path):
    at = lambda m: None if m is None else datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "task_id bigint, status string, at timestamp, retry_count int, max_retries int, lock_expires_at timestamp"
    rng = np.random.default_rng(3)
    ids = [None, 2**53 + 1, *range(-10, 110)]
    batches = []
    for k in range(5):
        rows, times = [], iter(rng.permutation(np.arange(100 * k, 100 * k + 100)).tolist())  # no two at one time
        for _ in range(60):
            status = ["processing", "processing", "completed", "pending", "dead_letter"][rng.integers(5)]
            retries = [None, 0, 2, 3][rng.integers(4)] if status == "processing" else 1
            lease = 100 * k + int(rng.integers(0, 250)) if status == "processing" and rng.random() < 0.8 else None
            rows.append((ids[rng.integers(len(ids))], status, next(times), retries, 3, lease))
        batches.append(rows)
    batches[0].append((500, "completed", None, 0, 3, None))  # without a time
    batches[1] += [(500, "pending", None, 1, 3, None), (2**53, "pending", 150.5, 7, 9, None)]

    told, state, keep, watermark = [], {}, 120, None
    for rows in [*batches, []]:  # at the end time passes once more
        touched = {}
        for row in rows:
            if row[0] not in state or state[row[0]][2] is None or (row[2] is not None and row[2] >= state[row[0]][2]):
                state[row[0]] = row
            touched[row[0]] = None
        told += [state[t] for t in touched]
        for t, (_, status, when, retries, most, lease) in list(state.items()) if watermark is not None else ():
            if status == "processing" and lease is not None and lease < watermark:
                again = retries is not None and retries < most
                state[t] = (t, "pending", lease, retries + 1, most, None) if again else (t, "dead_letter", lease, retries, most, lease)
                told.append(state[t])
            if state[t][1] in ("completed", "dead_letter") and state[t][2] is not None and state[t][2] + keep <= watermark:
                del state[t]
        watermark = max([watermark or 0, *(r[2] for r in rows if r[2] is not None)])

    updates = feed(spark, tmp_path, "tasks", schema, [[(*r[:2], at(r[2]), *r[3:5], at(r[5])) for r in rows] for rows in batches])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", completion.ROCKSDB)
    try:
        query = (
            streams.stream_task_state(updates, keep="120 minutes", buckets=3).writeStream.format("memory").queryName("bucket_states")
            .option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in spark.table("bucket_states").collect()]
    wanted = [(*r[:2], at(r[2]), *r[3:5], at(r[5])) for r in told]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) <= 3 * 3, rows  # a state and a timer (two rows) for each bucket, not for each task
