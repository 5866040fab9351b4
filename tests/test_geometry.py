"""Box rules: hand-made cases, invariants, and both ways of treating a page."""

from __future__ import annotations

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.functions import boxes
from pagemill.operators import geometry
from pagemill.plans.layout import LayoutSettings, layout_regions

SCHEMA = "unit_id bigint, page_idx int, det_id int, cls_id int, score double, x1 double, y1 double, x2 double, y2 double, order_seq int"


def detections(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_boxes(seed: int, pages: int = 4, n: int = 40):
    """Overlapping boxes with exact copies, boxes inside others and boxes without area."""
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        for det in range(n):
            x, y = rng.randint(0, 120), rng.randint(0, 120)
            w, h = rng.choice([0, 10, 40, 41, 42, 150]), rng.choice([5, 40, 41, 150])
            if det and rng.random() < 0.3:
                copied = rng.choice([r for r in rows if r[1] == page])
                x, y, w, h = copied[5], copied[6], copied[7] - copied[5], copied[8] - copied[6]
            rows.append(
                (1, page, det, rng.choice([3, 14, 18, 21, 22]), rng.randint(0, 9) / 10, float(x), float(y), float(x + w), float(y + h), rng.randint(0, 5))
            )
    return rows


def keys(df, *more):
    return sorted(tuple(r) for r in df.select("unit_id", "page_idx", "det_id", *more).collect())


def brute_nms(rows, same, other):
    """Keep a box unless a kept, better one overlaps it too much."""

    def iou(a, b):
        w = min(a[7], b[7]) - max(a[5], b[5]) + 1
        h = min(a[8], b[8]) - max(a[6], b[6]) + 1
        inter = max(0, w) * max(0, h)
        area = lambda r: (r[7] - r[5] + 1) * (r[8] - r[6] + 1)
        return inter / (area(a) + area(b) - inter)

    kept = []
    for row in sorted(rows, key=lambda r: (r[1], -r[4], r[2])):
        if all(k[1] != row[1] or iou(k, row) < (same if k[3] == row[3] else other) for k in kept):
            kept.append(row)
    return sorted(r[:3] for r in kept)


@pytest.mark.parametrize("thresholds", [(0.6, 0.98), (0.3, 0.49)])
@pytest.mark.parametrize("limit", [2048, 5])
def test_nms(spark, thresholds, limit):
    rows = random_boxes(1)
    assert keys(geometry.nms(detections(spark, rows), *thresholds, limit=limit)) == brute_nms(rows, *thresholds)


def test_nms_is_idempotent(spark):
    once = geometry.nms(detections(spark, random_boxes(2)))
    assert keys(geometry.nms(once)) == keys(once)


@pytest.mark.parametrize("mode", ["large", "small", {3: "small", 14: "large", 18: "small", 21: "large", 22: "large"}])
def test_merge_is_the_same_on_large_pages(spark, mode):
    df = detections(spark, random_boxes(3))
    assert keys(geometry.merge_boxes(df, mode, limit=5)) == keys(geometry.merge_boxes(df, mode))


@pytest.mark.parametrize(("category", "mode"), [(None, None), (18, "small"), (21, "large")])
def test_flags_are_the_same_on_large_pages(spark, category, mode):
    df = detections(spark, random_boxes(4))
    flags = [
        keys(geometry.containment_flags(df, category=category, mode=mode, limit=limit), "contains_other", "contained_by_other")
        for limit in (2048, 5)
    ]
    assert flags[0] == flags[1]


def test_order_and_polygons_are_the_same_on_large_pages(spark):
    df = detections(spark, random_boxes(5)).withColumn(
        "polygon", F.when(F.col("det_id") % 3 != 0, F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2")))
    )
    pages = df.select("unit_id", "page_idx").distinct().withColumns({"width": F.lit(200), "height": F.lit(180)})
    assert keys(geometry.reading_order(df, limit=5), "idx") == keys(geometry.reading_order(df), "idx")
    moved = df.withColumn("x1", F.col("x1") + 0.7)
    both = [keys(geometry.attach_polygons(moved, df, pages, limit=limit), "polygon") for limit in (2048, 5)]
    assert both[0] == both[1]
    whole = [
        sorted(map(str, layout_regions(df, pages, LayoutSettings(page_rows_limit=limit, unclip_ratio=1.1)).collect()))
        for limit in (2048, 5)
    ]
    assert whole[0] == whole[1]


def test_layout_invariants(spark):
    df = detections(spark, random_boxes(6))
    pages = df.select("unit_id", "page_idx").distinct().withColumns({"width": F.lit(200), "height": F.lit(180)})
    rows = layout_regions(df, pages).collect()
    assert rows
    for page in {r.page_idx for r in rows}:
        assert sorted(r.idx for r in rows if r.page_idx == page) == list(range(sum(r.page_idx == page for r in rows)))
    assert all(0 <= v <= 1000 for r in rows for v in (r.bx1, r.by1, r.bx2, r.by2))
    assert {r.task_type for r in rows} <= {"text", "table", "formula", "skip"}


def test_page_sized_images(spark):
    pages = spark.createDataFrame([(1, 0, 100, 100), (1, 1, 100, 100), (1, 2, 100, 100)], "unit_id bigint, page_idx int, width int, height int")
    whole, part = (0.0, 0.0, 99.0, 99.0, 1), (0.0, 0.0, 50.0, 50.0, 1)
    rows = [
        (1, 0, 0, 14, 0.9, *whole), (1, 0, 1, 22, 0.9, *part),  # dropped beside another box
        (1, 1, 0, 14, 0.9, *whole),  # alone on its page
        (1, 2, 0, 14, 0.9, *whole), (1, 2, 1, 14, 0.8, *whole),  # nothing would be left
    ]
    assert keys(geometry.drop_page_sized_images(detections(spark, rows), pages)) == [
        (1, 0, 1), (1, 1, 0), (1, 2, 0), (1, 2, 1)
    ]


def test_preserved_classes_stay(spark):
    outer, inner = (0.0, 0.0, 100.0, 100.0, 1), (10.0, 10.0, 20.0, 20.0, 2)
    rows = [(1, 0, 0, 21, 0.9, *outer), (1, 0, 1, 14, 0.9, *inner), (1, 0, 2, 22, 0.9, *inner)]
    # the text goes, held by table and image alike; the image inside the table stays
    assert keys(geometry.merge_boxes(detections(spark, rows), "large")) == [(1, 0, 0), (1, 0, 1)]


def test_box_without_area_is_not_contained(spark):
    pair = spark.createDataFrame([((5.0, 5.0, 5.0, 9.0), (0.0, 0.0, 9.0, 9.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert pair.select(boxes.contained_ratio(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_service_boxes(spark):
    from pagemill.sources.readers import normalised_service_box

    rows = [([500, 500, 1000, 1000], 2000, 2000), ([431, 1762, 1061, 2189], 2040, 2640), (None, 10, 10), ([1, 2, 3], 10, 10), ([1, 2, 3, 4], 0, 10)]
    df = spark.createDataFrame(rows, "box array<int>, w int, h int")
    got = [r[0] for r in df.select(normalised_service_box(F.col("box"), F.col("w"), F.col("h"))).collect()]
    assert got == [[250, 250, 500, 500], [211, 667, 520, 829], None, [1, 2, 3], [1, 2, 3, 4]]


def test_points_on_crowded_pages(spark):
    rng = random.Random(7)
    blocks = [(1, p, b, x := rng.randint(0, 300), y := rng.randint(0, 300), x + rng.randint(0, 90), y + rng.randint(0, 90)) for p in (1, 2) for b in range(30)]
    points = [(1, f"{p}-{k}", p, float(rng.randint(0, 390)), float(rng.randint(0, 390))) for p in (1, 2) for k in range(80)]
    block_df = spark.createDataFrame(blocks, "unit_id bigint, page_index int, block_id int, x1 int, y1 int, x2 int, y2 int")
    point_df = spark.createDataFrame(points, "unit_id bigint, point_id string, page_index int, px double, py double")
    wanted = {}
    for _, name, page, x, y in points:
        inside = [b for _, q, b, x1, y1, x2, y2 in blocks if q == page and x1 <= x <= x2 and y1 <= y <= y2]
        wanted[name] = min(inside) if inside else None
    for limit in (2048, 5):
        got = {r.point_id: r.block_id for r in geometry.blocks_at_points(point_df, block_df, limit).collect()}
        assert got == wanted


def chain(n):
    """Every box overlaps the next one too much, so what stays depends on all boxes before it."""
    return [(1, 0, k, 22, 1 - k / n, 3.0 * k, 0.0, 3.0 * k + 20, 30.0, 0) for k in range(n)]


def pile(n, seed=1):
    """Jittered boxes of one place, and a far group in a band of its own."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = rng.uniform(0, 6), rng.uniform(0, 6) + (500 if k % 5 == 0 else 0)
        rows.append((1, 0, k, rng.choice([21, 22]), rng.random(), x, y, x + rng.uniform(90, 110), y + rng.uniform(90, 110), 0))
    return rows


def jobs_of(spark, build):
    """How many Spark jobs it takes to build and collect."""
    tracker = spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        rows = build()
        return rows, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_long_chains_take_no_rounds(spark):
    # thresholds so low that only every few boxes stay
    rows = chain(5000)
    kept, jobs = jobs_of(spark, lambda: keys(geometry.nms(detections(spark, rows), 0.6, 0.6)))
    expected, last = [], None
    for r in rows:
        if last is None or (21 - (r[5] - last)) * 31 / (21 * 31 * 2 - (21 - (r[5] - last)) * 31) < 0.6:
            expected.append(r[:3])
            last = r[5]
    assert kept == sorted(expected) and jobs < 20


def test_jittered_pile(spark):
    rows = pile(1500)
    df = detections(spark, rows)
    assert keys(geometry.nms(df, 0.6, 0.98, limit=5)) == brute_nms(rows, 0.6, 0.98)
    large = pile(20_000)
    kept, jobs = jobs_of(spark, lambda: keys(geometry.nms(detections(spark, large), 0.6, 0.98)))
    assert 0 < len(kept) < 1000 and jobs < 20


@pytest.mark.parametrize("mode", ["large", "small", {21: "small", 22: "large"}])
def test_merge_of_a_jittered_pile(spark, mode):
    df = detections(spark, pile(1500, 2))
    assert keys(geometry.merge_boxes(df, mode, limit=5)) == keys(geometry.merge_boxes(df, mode))
    flags = [keys(geometry.containment_flags(df, limit=n), "contains_other", "contained_by_other") for n in (5, 2048)]
    assert flags[0] == flags[1]


def test_pile_writes_no_pairs(spark):
    from pagemill.operators import crowded

    frame = detections(spark, pile(20_000)).toPandas()
    frame = frame.assign(n=1, inner_bits=3, outer_bits=3, cell=0, probe=True).rename(columns={"page_idx": "page"})
    both = pd.concat([frame, frame.assign(probe=False)])
    step = crowded.witnesses(["unit_id", "page", "cell"], 0.8, ["any", "any"], 1, 2)
    found = pd.concat(step(iter([both.iloc[:30_000], both.iloc[30_000:]])))
    assert 20_000 < len(found) <= 40_000
