"""Layout geometry on detection tables.

Detections carry ``unit_id, page_idx, det_id, cls_id, score, x1, y1, x2, y2, order_seq``
(optionally ``polygon``); ``det_id`` numbers the boxes of a page from 0. Rules that
compare the boxes of a page run on one array per page: a single shuffle by
``(unit_id, page_idx)``, then array expressions. Pages with more boxes than
``PAGE_ROWS_LIMIT`` go through the joins in :mod:`pagemill.operators.large_pages`.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import boxes
from pagemill.operators import large_pages
from pagemill.operators.ordering import by_page_size
from pagemill.session import materialise

log = logging.getLogger(__name__)
PAGE = config.PAGE_KEYS


# --- row-local rules ---------------------------------------------------------


def class_thresholds(per_class: Mapping[int | str, float], labels: Mapping[int, str] = config.ID_TO_LABEL) -> dict[int, float]:
    """Thresholds by class id from a table keyed by ids or names; unknown names are ignored."""
    by_name = {name: cls for cls, name in labels.items()}
    result: dict[int, float] = {}
    for key, value in per_class.items():
        if isinstance(key, str):
            if key not in by_name:
                log.warning("unknown class name %r in the threshold table, ignored", key)
                continue
            key = by_name[key]
        result[int(key)] = float(value)
    return result


def threshold_by_class(
    detections: DataFrame,
    default: float = config.SCORE_THRESHOLD,
    per_class: Mapping[int | str, float] | None = None,
    labels: Mapping[int, str] = config.ID_TO_LABEL,
) -> DataFrame:
    """Keep boxes that reach the score threshold of their class."""
    thresholds = class_thresholds(per_class or {}, labels)
    coarse = pre_threshold(detections, default, thresholds)
    if not thresholds:
        return coarse
    return coarse.where(F.col("score") >= F.coalesce(boxes.lookup(thresholds, F.col("cls_id")), F.lit(default)))


def pre_threshold(detections: DataFrame, default: float, thresholds: Mapping[int, float]) -> DataFrame:
    """Cut at the lowest threshold of all: a plain predicate the scan can use."""
    return detections.where(F.col("score") >= min([default, *thresholds.values()]))


def unclip(detections: DataFrame, ratio=config.UNCLIP_RATIO) -> DataFrame:
    """Scale boxes about their centre; classes missing from a per-class table stay."""
    if not ratio:
        return detections
    ratio_w, ratio_h = boxes.unclip_ratios(ratio, F.col("cls_id"))
    scaled = boxes.unclip_sides(*[F.col(s) for s in boxes.SIDES], ratio_w, ratio_h)
    return detections.withColumns({s: F.coalesce(new, F.col(s)) for s, new in zip(boxes.SIDES, scaled)})


def with_page_size(rows: DataFrame, pages: DataFrame, how: str = "inner") -> DataFrame:
    """Attach ``width`` and ``height`` of the page."""
    return rows.join(pages.select(*PAGE, "width", "height"), PAGE, how)


def clamp_boxes(detections: DataFrame) -> DataFrame:
    """Clamp to the page and drop boxes left without area; coordinates stay fractional."""
    clamped = detections.withColumns(
        {
            "x1": boxes.clamp(F.col("x1"), F.col("width")),
            "y1": boxes.clamp(F.col("y1"), F.col("height")),
            "x2": boxes.clamp(F.col("x2"), F.col("width")),
            "y2": boxes.clamp(F.col("y2"), F.col("height")),
        }
    )
    return clamped.where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


def label_of(cls: Column, labels: Mapping[int, str] = config.ID_TO_LABEL) -> Column:
    """Name of a class id, ``class_<id>`` when unknown."""
    return F.coalesce(boxes.lookup(labels, cls), F.concat(F.lit("class_"), cls.cast("string")))


def task_of(label: Column, task_labels: Mapping[str, Sequence[str]] | None = config.TASK_LABELS) -> Column:
    """Recognition task of a label: the first task that lists it, null when none does.

    Without a table every label is recognised as text.
    """
    if task_labels is None:
        return F.lit("text")
    first: dict[str, str] = {}
    for task, names in task_labels.items():
        for name in names:
            first.setdefault(name, task)
    return boxes.lookup(first, label)


def route_tasks(regions: DataFrame, label: str = "label", task_labels=config.TASK_LABELS) -> DataFrame:
    """Attach ``task_type``; rows without a task or marked ``abandon`` are dropped."""
    routed = regions.withColumn("task_type", task_of(F.col(label), task_labels))
    return routed.where(F.col("task_type").isNotNull() & (F.col("task_type") != "abandon"))


def normalise_boxes(rows: DataFrame) -> DataFrame:
    """Add ``bx1..by2``: the box in thousandths of the page, truncated."""
    return rows.withColumns(
        {
            "b" + s: boxes.to_thousandths(F.col(s), F.col("width" if s[0] == "x" else "height"))
            for s in boxes.SIDES
        }
    )


# --- rules on the array of one page's boxes ---------------------------------

CARRIED = ["det_id", "cls_id", "score", "x1", "y1", "x2", "y2", "order_seq"]


def _page_array(detections: DataFrame, fields: Sequence[str]) -> DataFrame:
    by_score = F.struct((-F.col("score")).alias("neg_score"), *[F.col(c) for c in fields])
    return detections.groupBy(*PAGE).agg(F.sort_array(F.collect_list(by_score)).alias("items"))


def _fields(detections: DataFrame) -> list[str]:
    return [c for c in [*CARRIED, "polygon"] if c in detections.columns]


def _rows(arrays: DataFrame, fields: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return arrays.select(*PAGE, *extra, F.explode("items").alias("i")).select(
        *PAGE, *[f"i.{c}" for c in fields], *extra
    )


def nms_array(items: Column, iou_same: float, iou_other: float) -> Column:
    """Greedy suppression over an array sorted by descending score."""
    nothing = F.filter(items, lambda _: F.lit(False))

    def step(kept: Column, box: Column) -> Column:
        beaten = F.exists(
            kept,
            lambda k: boxes.iou(k, box)
            >= F.when(k["cls_id"] == box["cls_id"], F.lit(iou_same)).otherwise(F.lit(iou_other)),
        )
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(box)))

    return F.aggregate(items, nothing, step)


def drop_page_sized_images_array(items: Column, width: Column, height: Column, image_cls: int | None) -> Column:
    """Drop image boxes that cover nearly the whole page, unless nothing would be left."""
    if image_cls is None:
        return items
    limit = page_image_limit(width, height)
    kept = F.filter(items, lambda b: (b["cls_id"] != image_cls) | (_clamped_area(b, width, height) <= limit))
    return F.when((F.size(items) > 1) & (F.size(kept) > 0), kept).otherwise(items)


def page_image_limit(width: Column, height: Column) -> Column:
    share = F.when(width > height, F.lit(config.PAGE_IMAGE_RATIO_LANDSCAPE)).otherwise(
        F.lit(config.PAGE_IMAGE_RATIO_OTHER)
    )
    return share * (width * height)


def _clamped_area(box: Column, width: Column, height: Column) -> Column:
    w = F.least(width.cast("double"), box["x2"]) - F.greatest(F.lit(0.0), box["x1"])
    h = F.least(height.cast("double"), box["y2"]) - F.greatest(F.lit(0.0), box["y1"])
    return w * h


def preserved_classes(labels: Mapping[int, str]) -> list[int]:
    return [cls for cls, name in labels.items() if name in config.PRESERVED_LABELS]


def _one_of(col: Column, values: Sequence[int]) -> Column:
    return col.isin(list(values)) if values else F.lit(False)


def contained_by_other(items: Column, box: Column, preserved: Sequence[int], other_ok: Callable[[Column], Column]) -> Column:
    """Some other box with ``other_ok`` holds most of ``box``."""
    return ~_one_of(box["cls_id"], preserved) & F.exists(
        items,
        lambda o: (o["det_id"] != box["det_id"])
        & other_ok(o)
        & boxes.is_contained(box, o, config.CONTAINED_RATIO),
    )


def contains_other(items: Column, box: Column, preserved: Sequence[int], other_ok: Callable[[Column], Column]) -> Column:
    """``box`` holds most of some other box with ``other_ok``."""
    return F.exists(
        items,
        lambda o: (o["det_id"] != box["det_id"])
        & other_ok(o)
        & ~_one_of(o["cls_id"], preserved)
        & boxes.is_contained(o, box, config.CONTAINED_RATIO),
    )


def split_modes(modes: Mapping[int, str]) -> tuple[list[int], list[int]]:
    for mode in modes.values():
        if mode not in ("union", "large", "small"):
            raise ValueError(f"unknown merge mode {mode!r}")
    large = [int(c) for c, m in modes.items() if m == "large"]
    small = [int(c) for c, m in modes.items() if m == "small"]
    return large, small


def merge_array(items: Column, mode: str | Mapping[int, str] | None, preserved: Sequence[int]) -> Column:
    """Remove nested boxes.

    ``large`` drops a box held by another; ``small`` drops a box that holds another and
    is not held itself. A per-class table applies the mode of the outer box's class
    (large) or the inner box's class (small), every class against the same boxes.
    """
    if not mode or mode == "union":
        return items
    any_box = lambda _: F.lit(True)
    if mode == "large":
        return F.filter(items, lambda b: ~contained_by_other(items, b, preserved, any_box))
    if mode == "small":
        return F.filter(
            items,
            lambda b: ~contains_other(items, b, preserved, any_box)
            | contained_by_other(items, b, preserved, any_box),
        )
    if isinstance(mode, str):
        raise ValueError(f"unknown merge mode {mode!r}")
    large, small = split_modes(mode)

    def drop(b: Column) -> Column:
        by_large = contained_by_other(items, b, preserved, lambda o: _one_of(o["cls_id"], large))
        if not small:
            return by_large
        # an inner box of a small-mode class removes the outer one, unless the outer
        # box has the same class and lies inside another box itself
        by_small = contains_other(
            items,
            b,
            preserved,
            lambda o: _one_of(o["cls_id"], small) & ~((o["cls_id"] == b["cls_id"]) & b["held"]),
        )
        return by_large | by_small

    if not small:
        return F.filter(items, lambda b: ~drop(b))
    # whether a box is held itself is found once per box, not once per pair
    flagged = F.transform(items, lambda b: b.withField("held", contained_by_other(items, b, preserved, any_box)))
    return F.transform(F.filter(flagged, lambda b: ~drop(b)), lambda b: b.dropFields("held"))


def reading_order_array(items: Column) -> Column:
    """Sort by the predicted order, ties by position in the raw list."""
    keyed = F.transform(items, lambda b: F.struct(b["order_seq"].alias("o"), b["det_id"].alias("d"), b.alias("b")))
    return F.transform(F.sort_array(keyed), lambda k: k["b"])


# --- the same rules as operators on a detection table ----------------------


def nms(
    detections: DataFrame,
    iou_same: float = config.IOU_SAME_CLASS,
    iou_other: float = config.IOU_OTHER_CLASS,
    limit: int = config.PAGE_ROWS_LIMIT,
) -> DataFrame:
    """Greedy non-maximum suppression per page; ties in score go to the lower ``det_id``.

    Thresholds above 1 never suppress, for pages of any size; those of 0 or less are refused, for pages of any size.
    """
    if min(iou_same, iou_other) <= 0:
        raise ValueError("overlap thresholds must be above 0")
    fields = _fields(detections)

    def ordinary(df: DataFrame) -> DataFrame:
        arrays = _page_array(df, fields)
        return _rows(arrays.withColumn("items", nms_array(F.col("items"), iou_same, iou_other)), fields)

    return by_page_size(
        detections.select(*PAGE, *fields), "det_id", ordinary, lambda df: large_pages.nms(df, iou_same, iou_other), limit
    )


def drop_page_sized_images(
    detections: DataFrame, pages: DataFrame, labels: Mapping[int, str] = config.ID_TO_LABEL
) -> DataFrame:
    """Drop image boxes that cover nearly the whole page, unless nothing would be left."""
    image_cls = next((c for c, n in labels.items() if n == "image"), None)
    fields = _fields(detections)
    if image_cls is None:
        return detections
    sized = with_page_size(detections.select(*PAGE, *fields), pages)
    box = F.struct(*boxes.SIDES)
    limit = page_image_limit(F.col("width"), F.col("height"))
    fits = (F.col("cls_id") != image_cls) | (_clamped_area(box, F.col("width"), F.col("height")) <= limit)
    # one row per page with counts, so a page of any size costs no more than a partial sum
    counts = sized.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(fits).alias("_fitting")
    )
    judged = sized.join(counts, PAGE)
    return judged.where(fits | (F.col("_all") <= 1) | (F.col("_fitting") == 0)).select(*PAGE, *fields)


def containment_flags(
    detections: DataFrame,
    preserved: Sequence[int] | None = None,
    category: int | None = None,
    mode: str | None = None,
    limit: int = config.PAGE_ROWS_LIMIT,
) -> DataFrame:
    """Add ``contains_other`` and ``contained_by_other`` (0 or 1) to every box."""
    preserved = preserved_classes(config.ID_TO_LABEL) if preserved is None else list(preserved)
    fields = _fields(detections)
    inner_ok = lambda b: (b["cls_id"] == category) if category is not None and mode == "small" else F.lit(True)
    outer_ok = lambda b: (b["cls_id"] == category) if category is not None and mode == "large" else F.lit(True)

    def ordinary(df: DataFrame) -> DataFrame:
        arrays = _page_array(df, fields)
        items = F.col("items")
        flagged = F.transform(
            items,
            lambda b: F.struct(
                *[b[c].alias(c) for c in fields],
                (outer_ok(b) & contains_other(items, b, preserved, inner_ok)).cast("int").alias("contains_other"),
                (inner_ok(b) & contained_by_other(items, b, preserved, outer_ok)).cast("int").alias("contained_by_other"),
            ),
        )
        return _rows(arrays.withColumn("items", flagged), [*fields, "contains_other", "contained_by_other"])

    return by_page_size(
        detections.select(*PAGE, *fields),
        "det_id",
        ordinary,
        lambda df: large_pages.containment_flags(df, preserved, inner_ok, outer_ok),
        limit,
    )


def merge_boxes(
    detections: DataFrame,
    mode: str | Mapping[int, str] | None = None,
    labels: Mapping[int, str] = config.ID_TO_LABEL,
    limit: int = config.PAGE_ROWS_LIMIT,
) -> DataFrame:
    """Remove nested boxes by a mode or a per-class table of modes."""
    mode = config.MERGE_MODES if mode is None else mode
    preserved = preserved_classes(labels)
    fields = _fields(detections)
    if mode == "union":
        return detections

    def ordinary(df: DataFrame) -> DataFrame:
        arrays = _page_array(df, fields)
        return _rows(arrays.withColumn("items", merge_array(F.col("items"), mode, preserved)), fields)

    return by_page_size(
        detections.select(*PAGE, *fields),
        "det_id",
        ordinary,
        lambda df: large_pages.merge_boxes(df, mode, preserved),
        limit,
    )


def reading_order(detections: DataFrame, limit: int = config.PAGE_ROWS_LIMIT) -> DataFrame:
    """Add ``idx`` (position in reading order) and ``order`` (null when not positive)."""

    def ordinary(df: DataFrame) -> DataFrame:
        window = Window.partitionBy(*PAGE).orderBy("order_seq", "det_id")
        return df.withColumn("idx", F.row_number().over(window) - 1)

    ordered = by_page_size(detections, "det_id", ordinary, large_pages.reading_order, limit)
    return ordered.withColumn("order", F.when(F.col("order_seq") > 0, F.col("order_seq")))


def _close(raw: Column, box: Column) -> Column:
    tests = [
        F.abs(raw[s] - box[s]) <= F.lit(config.POLYGON_ATOL) + F.lit(config.POLYGON_RTOL) * F.abs(box[s])
        for s in boxes.SIDES
    ]
    return tests[0] & tests[1] & tests[2] & tests[3]


def _clamped_polygon(polygon: Column, width: Column, height: Column) -> Column:
    return F.transform(polygon, lambda p: F.array(boxes.clamp(p[0], width), boxes.clamp(p[1], height)))


def attach_polygons(
    kept: DataFrame, raw: DataFrame, pages: DataFrame, limit: int = config.PAGE_ROWS_LIMIT
) -> DataFrame:
    """Give each kept box the outline of the first raw box at (almost) the same place.

    When that raw box has no outline, or there is none, the clamped box itself is used.
    """
    keep_fields = [c for c in kept.columns if c not in (*PAGE, "polygon")]

    def ordinary(df: DataFrame) -> DataFrame:
        arrays = df.groupBy(*PAGE).agg(
            F.sort_array(F.collect_list(F.when(F.col("_raw"), F.col("r")))).alias("raws"),
            F.collect_list(F.when(~F.col("_raw"), F.col("k"))).alias("items"),
        )
        raws = F.col("raws")
        matched = F.transform(
            "items",
            lambda k: F.struct(
                *[k[c].alias(c) for c in keep_fields],
                F.get(F.filter(raws, lambda r: _close(r, k)), F.lit(0))["polygon"].alias("polygon"),
            ),
        )
        return _rows(arrays.withColumn("items", matched), [*keep_fields, "polygon"])

    kept_rows = kept.select(
        *PAGE,
        F.col("det_id"),
        F.lit(False).alias("_raw"),
        F.lit(None).cast(_raw_type(raw)).alias("r"),
        F.struct(*keep_fields).alias("k"),
    )
    raw_rows = raw.select(
        *PAGE,
        F.col("det_id"),
        F.lit(True).alias("_raw"),
        F.struct("det_id", *boxes.SIDES, "polygon").alias("r"),
        F.lit(None).cast(kept_rows.schema["k"].dataType).alias("k"),
    )
    both = kept_rows.unionByName(raw_rows)
    matched = by_page_size(
        both, "det_id", ordinary, lambda df: large_pages.attach_polygons(df, keep_fields, _close), limit
    )
    sized = with_page_size(matched, pages)
    clamped = [
        boxes.clamp(F.col(s), F.col("width" if s[0] == "x" else "height")) for s in boxes.SIDES
    ]
    return sized.withColumn(
        "polygon",
        F.coalesce(_clamped_polygon(F.col("polygon"), F.col("width"), F.col("height")), boxes.rectangle(*clamped)),
    ).drop("width", "height")


def _raw_type(raw: DataFrame) -> str:
    polygon = raw.schema["polygon"].dataType.simpleString()
    types = {s: raw.schema[s].dataType.simpleString() for s in boxes.SIDES}
    fields = [f"det_id:{raw.schema['det_id'].dataType.simpleString()}"]
    fields += [f"{s}:{t}" for s, t in types.items()] + [f"polygon:{polygon}"]
    return f"struct<{','.join(fields)}>"


# --- points and blocks -------------------------------------------------------


def blocks_at_points(points: DataFrame, block_table: DataFrame, limit: int = config.PAGE_ROWS_LIMIT) -> DataFrame:
    """First block (by ``block_id``) whose box holds the point, misses kept.

    Points carry ``unit_id, point_id, page_index, px, py``; blocks ``unit_id,
    page_index, block_id, x1, y1, x2, y2``. The blocks of a page are one list, in which each point finds its
    first hit: one row per point, and a join that Spark can split where a page has very many points. Points of pages
    that may hold more than ``limit`` blocks meet only those of the grid cells around them.
    """
    page = ["unit_id", "page_index"]
    names = ["unit_id", "point_id", *[c for c in points.columns if c not in ("unit_id", "point_id")]]
    usable = block_table.where(F.col("x1").isNotNull()).select(*page, "block_id", *boxes.SIDES)
    beyond = usable.where(F.col("block_id") >= limit).select(*page)
    if beyond.isEmpty():
        return _first_in_list(points, usable).select(*names, "block_id")
    big = materialise(beyond.distinct())
    plain = _first_in_list(points.join(big, page, "left_anti"), usable.join(big, page, "left_anti"))
    crowded = points.join(big, page, "left_semi")
    dots = crowded.select(
        "unit_id", F.col("page_index").alias("page_idx"), "point_id",
        F.col("px").cast("double").alias("x1"), F.col("py").cast("double").alias("y1"),
        F.col("px").cast("double").alias("x2"), F.col("py").cast("double").alias("y2"),
    )
    hot = usable.join(big, page, "left_semi").withColumnRenamed("page_index", "page_idx")
    pairs = large_pages.overlapping(dots, hot, 0, None)
    found = pairs.where(
        F.col("a.x1").between(F.col("b.x1"), F.col("b.x2")) & F.col("a.y1").between(F.col("b.y1"), F.col("b.y2"))
    ).select("unit_id", F.col("a.point_id").alias("point_id"), F.col("b.block_id").alias("block_id"))
    first = found.groupBy("unit_id", "point_id").agg(F.min("block_id").alias("block_id"))
    others = crowded.join(first, ["unit_id", "point_id"], "left")
    return plain.select(*names, "block_id").unionByName(others.select(*names, "block_id"))


def _first_in_list(points: DataFrame, usable: DataFrame) -> DataFrame:
    lists = usable.groupBy("unit_id", "page_index").agg(
        F.sort_array(F.collect_list(F.struct("block_id", *boxes.SIDES))).alias("_blocks")
    )
    inside = lambda b: F.col("px").between(b["x1"], b["x2"]) & F.col("py").between(b["y1"], b["y2"])
    hit = F.get(F.filter("_blocks", inside), F.lit(0))["block_id"]
    return points.join(lists, ["unit_id", "page_index"], "left").withColumn("block_id", hit).drop("_blocks")


def rescale_points(points: DataFrame, shown_w: Column, shown_h: Column, page_w: Column, page_h: Column, reverse: bool = False) -> DataFrame:
    """Display to document coordinates: divide by the display scale, or multiply by its inverse."""
    if reverse:
        return points.withColumns({"dx": F.col("px") * (page_w / shown_w), "dy": F.col("py") * (page_h / shown_h)})
    return points.withColumns({"dx": F.col("px") / (shown_w / page_w), "dy": F.col("py") / (shown_h / page_h)})


def block_table(layout: DataFrame) -> DataFrame:
    """Blocks for display: blank ones dropped, trimmed, with size and image flag."""
    from pagemill.functions.strings import strip

    content = strip(F.col("block_content"))
    return (
        layout.where(F.col("block_content").isNotNull() & (content != ""))
        .withColumn("content", content)
        .withColumns(
            {
                "page_index": F.coalesce("page_index", F.lit(1)),
                "is_image": F.col("content").startswith("![]("),
                "width": F.coalesce(F.col("x2") - F.col("x1"), F.lit(0)),
                "height": F.coalesce(F.col("y2") - F.col("y1"), F.lit(0)),
            }
        )
        .drop("block_content")
    )
