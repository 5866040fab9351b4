"""From raw detections to ordered, routed and normalised regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import boxes
from pagemill.operators import geometry, large_pages
from pagemill.operators.ordering import ChunkedOrder, WindowOrder, by_page_size
from pagemill.session import materialise

PAGE = config.PAGE_KEYS


@dataclass(frozen=True)
class LayoutSettings:
    """Settings of the layout rules; defaults are the shipped ones."""

    threshold: float = config.SCORE_THRESHOLD
    threshold_by_class: Mapping[int | str, float] = field(default_factory=dict)
    suppress: bool = True
    iou_same: float = config.IOU_SAME_CLASS
    iou_other: float = config.IOU_OTHER_CLASS
    merge_mode: str | Mapping[int, str] | None = field(default_factory=lambda: dict(config.MERGE_MODES))
    unclip_ratio: object = config.UNCLIP_RATIO
    labels: Mapping[int, str] = field(default_factory=lambda: dict(config.ID_TO_LABEL))
    task_labels: Mapping[str, Sequence[str]] | None = field(default_factory=lambda: dict(config.TASK_LABELS))
    page_rows_limit: int = config.PAGE_ROWS_LIMIT


def layout_regions(detections: DataFrame, pages: DataFrame, settings: LayoutSettings | None = None) -> DataFrame:
    """Apply all layout rules.

    Ordinary pages take one shuffle by page: boxes are gathered per page, every
    set rule is an array expression, and the reading position comes from the array.
    """
    s = settings or LayoutSettings()
    passed = geometry.threshold_by_class(detections, s.threshold, s.threshold_by_class, s.labels)
    preserved = geometry.preserved_classes(s.labels)
    image_cls = next((c for c, n in s.labels.items() if n == "image"), None)
    fields = geometry._fields(detections)
    passed = passed.select(*PAGE, *fields)

    def ordinary(df: DataFrame) -> DataFrame:
        arrays = geometry._page_array(df, fields).withColumn("raws", F.col("items"))
        if s.suppress:
            arrays = arrays.withColumn("items", geometry.nms_array(F.col("items"), s.iou_same, s.iou_other))
        arrays = geometry.with_page_size(arrays, pages)
        arrays = arrays.withColumn(
            "items",
            geometry.drop_page_sized_images_array(F.col("items"), F.col("width"), F.col("height"), image_cls),
        )
        arrays = arrays.withColumn("items", geometry.merge_array(F.col("items"), s.merge_mode, preserved))
        if "polygon" in fields:
            arrays = arrays.withColumn("raws", F.array_sort(F.transform("raws", lambda r: F.struct(
                r["det_id"].alias("det_id"), *[r[c].alias(c) for c in boxes.SIDES], r["polygon"].alias("polygon")))))
            raws = F.col("raws")
            arrays = arrays.withColumn(
                "items",
                F.transform(
                    "items",
                    lambda b: F.struct(
                        *[b[c].alias(c) for c in fields if c != "polygon"],
                        F.get(
                            F.filter(raws, lambda r: geometry._close(r, _unclipped(b, s.unclip_ratio))), F.lit(0)
                        )["polygon"].alias("polygon"),
                    ),
                ),
            )
        ordered = arrays.select(
            *PAGE, "width", "height", F.posexplode(geometry.reading_order_array(F.col("items"))).alias("idx", "b")
        )
        return ordered.select(*PAGE, "width", "height", "idx", *[f"b.{c}" for c in fields])

    def large(df: DataFrame) -> DataFrame:
        kept = large_pages.nms(df, s.iou_same, s.iou_other) if s.suppress else df
        kept = geometry.drop_page_sized_images(kept, pages, s.labels)
        if s.merge_mode and s.merge_mode != "union":
            kept = large_pages.merge_boxes(kept, s.merge_mode, preserved)
        if "polygon" in fields:
            moved = geometry.unclip(kept, s.unclip_ratio)
            both = moved.select(
                *PAGE, F.lit(False).alias("_raw"), F.lit(None).cast(geometry._raw_type(df)).alias("r"),
                F.struct("det_id", *boxes.SIDES).alias("k"),
            ).unionByName(
                df.select(
                    *PAGE, F.lit(True).alias("_raw"), F.struct("det_id", *boxes.SIDES, "polygon").alias("r"),
                    F.lit(None).cast(moved.select(F.struct("det_id", *boxes.SIDES).alias("k")).schema["k"].dataType).alias("k"),
                )
            )
            outlines = large_pages.attach_polygons(both, ["det_id"], geometry._close)
            kept = kept.drop("polygon").join(outlines, [*PAGE, "det_id"])
        ordered = large_pages.reading_order(kept.select(*PAGE, *fields))
        return geometry.with_page_size(ordered, pages).select(*PAGE, "width", "height", "idx", *fields)

    def finish(placed: DataFrame, order: WindowOrder) -> DataFrame:
        placed = placed.withColumn("order", F.when(F.col("order_seq") > 0, F.col("order_seq")))
        placed = geometry.clamp_boxes(geometry.unclip(placed, s.unclip_ratio))
        if "polygon" in fields:
            placed = placed.withColumn(
                "polygon",
                F.coalesce(
                    geometry._clamped_polygon(F.col("polygon"), F.col("width"), F.col("height")),
                    boxes.rectangle(*[F.col(c) for c in boxes.SIDES]),
                ),
            )
        # boxes are whole pixels from here on; the polygon keeps its fractions
        placed = placed.withColumns({c: F.col(c).cast("int") for c in boxes.SIDES})
        labelled = placed.withColumn("label", geometry.label_of(F.col("cls_id"), s.labels))
        routed = geometry.normalise_boxes(geometry.route_tasks(labelled, "label", s.task_labels))
        if "polygon" in fields:
            routed = routed.withColumn(
                "polygon",
                F.transform(
                    "polygon",
                    lambda p: F.array(
                        boxes.to_thousandths(p[0], F.col("width")), boxes.to_thousandths(p[1], F.col("height"))
                    ),
                ),
            )
        routed = routed.select(
            *PAGE, "idx", "det_id", "label", "task_type", "score", "order", "bx1", "by1", "bx2", "by2",
            *(["polygon"] if "polygon" in fields else []),
        )
        return order.dense(routed, "idx")

    return by_page_size(
        passed,
        "det_id",
        lambda df: finish(ordinary(df), WindowOrder(PAGE, "idx")),
        lambda df: finish(materialise(large(df)), ChunkedOrder(PAGE, "idx")),
        s.page_rows_limit,
    )


def _unclipped(box, ratio):
    if not ratio:
        return box
    ratio_w, ratio_h = boxes.unclip_ratios(ratio, box["cls_id"])
    scaled = boxes.unclip_sides(*[box[c] for c in boxes.SIDES], ratio_w, ratio_h)
    return F.struct(*[F.coalesce(new, box[c]).alias(c) for c, new in zip(boxes.SIDES, scaled)])


def reindex(rows: DataFrame, limit: int = config.PAGE_ROWS_LIMIT, pos: str = "idx") -> DataFrame:
    """Dense zero-based position inside the page after rows were dropped."""

    def ordinary(df: DataFrame) -> DataFrame:
        window = Window.partitionBy(*PAGE).orderBy(pos)
        return df.withColumn(pos, F.row_number().over(window) - 1)

    return by_page_size(rows, pos, ordinary, lambda df: ChunkedOrder(PAGE, pos).dense(df, pos), limit)
