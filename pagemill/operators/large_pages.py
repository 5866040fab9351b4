"""Layout rules for pages with too many boxes for one array.

The rules only ever relate boxes that overlap, so boxes meet in the cells of a grid. The
grid has one level per power of two of box size: a box covers at most four cells of its
own level, whatever the size of the page. Suppression reads the boxes of a band of the
page in order of their score; containment looks for one witness per box. Neither writes
pairs of boxes, and neither takes rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import boxes
from pagemill.operators import crowded
from pagemill.operators.ordering import ChunkedOrder, before
from pagemill.session import materialise

PAGE = config.PAGE_KEYS
TOP_LEVEL = 20  # 2**20 pixels, larger than any page side
#: Pixels of a stripe of a page, where bands of boxes may be parted.
STRIPE = 16
Test = Callable[[Column], Column]


def _level(df: DataFrame) -> Column:
    """Smallest level whose cell side is at least the longer side of the box."""
    longer = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(0.0)) + 1
    return F.least(F.ceil(F.log2(longer)), F.lit(TOP_LEVEL)).cast("int")


def _in_cells(df: DataFrame, levels: Column) -> DataFrame:
    """One row per level and covered cell."""
    at_level = df.withColumn("_lv", F.explode(levels))
    side = F.pow(F.lit(2.0), F.col("_lv"))

    def covered(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / side), F.floor((F.col(high) + 1) / side))

    return at_level.withColumn("_cx", F.explode(covered("x1", "x2"))).withColumn(
        "_cy", F.explode(covered("y1", "y2"))
    )


def overlapping(small: DataFrame, large: DataFrame, down: int, up: int | None) -> DataFrame:
    """Pairs of overlapping boxes, each pair once, as structs ``a`` and ``b``.

    ``large`` is filed at its own level only; ``small`` at levels from ``down`` below its
    own up to ``up`` above (all above when ``up`` is None). A pair meets in every shared
    cell and is kept in the one that holds the corner of its intersection.
    """
    own = _level(small)
    top = F.lit(TOP_LEVEL) if up is None else F.least(own + up, F.lit(TOP_LEVEL))
    left = _in_cells(small, F.sequence(F.greatest(own - down, F.lit(0)), top))
    right = _in_cells(large, F.array(_level(large)))
    cell = [*PAGE, "_lv", "_cx", "_cy"]
    pairs = left.select(*cell, F.struct(*small.columns).alias("a")).join(
        right.select(*cell, F.struct(*large.columns).alias("b")), cell
    )
    side = F.pow(F.lit(2.0), F.col("_lv"))
    corner_x = F.floor(F.greatest(F.col("a.x1"), F.col("b.x1")) / side)
    corner_y = F.floor(F.greatest(F.col("a.y1"), F.col("b.y1")) / side)
    return pairs.where((corner_x == F.col("_cx")) & (corner_y == F.col("_cy"))).select(*PAGE, "a", "b")


def _bands(detections: DataFrame) -> DataFrame:
    """Rows with ``_band``: boxes of different bands of a page do not touch.

    A band ends at a stripe of the page that no box reaches into. What is ordered is a row per stripe of a page, not per
    box, so its number depends on the height of pages only.
    """
    stripe = F.floor(F.col("y1") / STRIPE)
    reach = F.greatest(stripe, F.floor((F.col("y2") + 1) / STRIPE))
    rows = detections.withColumn("_stripe", stripe)
    stripes = rows.groupBy(*PAGE, "_stripe").agg(F.max(reach).alias("_reach"))
    down = Window.partitionBy(*PAGE).orderBy("_stripe")
    above = F.max("_reach").over(down.rowsBetween(Window.unboundedPreceding, -1))
    starts = stripes.withColumn("_starts", F.when(F.col("_stripe") > above, 1).otherwise(0))
    bands = starts.select(*PAGE, "_stripe", F.sum("_starts").over(down).alias("_band"))
    return rows.join(bands, [*PAGE, "_stripe"]).drop("_stripe")


def nms(detections: DataFrame, iou_same: float, iou_other: float) -> DataFrame:
    """Greedy suppression of each band of a page, its boxes read in order of their score.

    One sort, whatever the chains of overlaps: a box meets the kept boxes of its size in the cells around it, and a task
    holds only what was kept. Polygons and other columns stay where they are.
    """
    lowest = min(iou_same, iou_other)
    if lowest > 1:
        return detections
    # sides of boxes that reach the threshold differ by at most the factor 1/threshold
    levels = 1
    while 2.0**levels < 1 / lowest:
        levels += 1
    keys = [*PAGE, "_band"]
    ranked = _bands(detections.select(*PAGE, "det_id", "cls_id", (-F.col("score")).alias("_neg"), *boxes.SIDES))
    in_order = ranked.repartition(*keys).sortWithinPartitions(*keys, "_neg", "det_id")
    schema = detections.select(*PAGE, "det_id").schema
    kept = in_order.mapInPandas(crowded.suppress(keys, iou_same, iou_other, levels, TOP_LEVEL), schema)
    return detections.join(kept, [*PAGE, "det_id"], "left_semi")


def _witnesses(
    detections: DataFrame, preserved: Sequence[int], conditions: Mapping[str, tuple[str, Test, Test, str]]
) -> tuple[DataFrame, list[str]]:
    """A row per shape that meets a condition, with a column 0 or 1 for each.

    A condition ``(side, inner_ok, outer_ok, relation)`` holds for the ``inner`` or the ``outer`` box of a pair, some box
    inside another one, that passes both tests and whose classes are the ``same``, ``other`` or ``any``. Copies are
    collapsed first; a shape lies inside its own copies. Only whether there is such a pair is asked for, so pairs are
    looked at in the cells of a grid until a witness is found and never written.
    """
    shape = [*PAGE, "cls_id", *boxes.SIDES]
    movable = ~F.col("cls_id").isin(list(preserved)) if preserved else F.lit(True)
    own = F.struct("cls_id", *boxes.SIDES)

    def bits(test: int) -> Column:
        return reduce(
            lambda x, y: x + y, [F.when(c[test](own), 1 << k).otherwise(0) for k, c in enumerate(conditions.values())]
        ).cast("bigint")

    shapes = materialise(
        detections.groupBy(*shape)
        .agg(F.count(F.lit(1)).alias("n"), F.min("det_id").alias("det_id"))
        .withColumns({"inner_bits": F.when(movable, bits(1)).otherwise(0), "outer_bits": bits(2)})
    )
    probes = shapes.where(F.col("inner_bits") != 0)
    holders = shapes.where(F.col("outer_bits") != 0)
    # a box is at most 1/0.8 times as long as the one that holds 0.8 of its area
    levels = F.sequence(F.greatest(_level(probes) - 1, F.lit(0)), F.lit(TOP_LEVEL))
    cell = [*PAGE, "_lv", "_cx", "_cy"]
    filed = _in_cells(holders, F.array(_level(holders)))
    probing = _in_cells(probes, levels).join(filed.select(*cell).distinct(), cell, "left_semi")
    rows = probing.withColumn("probe", F.lit(True)).unionByName(filed.withColumn("probe", F.lit(False)))
    sides = {side: sum(1 << k for k, c in enumerate(conditions.values()) if c[0] == side) for side in ("inner", "outer")}
    relation = [c[3] for c in conditions.values()]
    step = crowded.witnesses(cell, config.CONTAINED_RATIO, relation, sides["inner"], sides["outer"])
    schema = shapes.select(*PAGE, "det_id", "inner_bits", "outer_bits").schema
    found = rows.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(step, schema)
    either = F.bit_or(F.col("inner_bits").bitwiseOR(F.col("outer_bits")))
    met = found.groupBy(*PAGE, "det_id").agg(either.alias("_met"))
    flags = [(F.col("_met").bitwiseAND(F.lit(1 << k)) != 0).cast("int").alias(name) for k, name in enumerate(conditions)]
    return shapes.select(*shape, "det_id").join(met, [*PAGE, "det_id"]).select(*shape, *flags), shape


def _any(_: Column) -> Column:
    return F.lit(True)


def containment_flags(detections: DataFrame, preserved: Sequence[int], inner_ok: Test, outer_ok: Test) -> DataFrame:
    conditions = {"_outer": ("outer", inner_ok, outer_ok, "any"), "_inner": ("inner", inner_ok, outer_ok, "any")}
    met, shape = _witnesses(detections, preserved, conditions)
    return detections.join(met, shape, "left").select(
        *detections.columns,
        F.coalesce("_outer", F.lit(0)).alias("contains_other"),
        F.coalesce("_inner", F.lit(0)).alias("contained_by_other"),
    )


def merge_boxes(detections: DataFrame, mode: str | Mapping[int, str], preserved: Sequence[int]) -> DataFrame:
    from pagemill.operators.geometry import split_modes

    if mode == "large":
        conditions = {"_held": ("inner", _any, _any, "any")}
        drop = F.col("_held") == 1
    elif mode == "small":
        conditions = {"_held": ("inner", _any, _any, "any"), "_holds": ("outer", _any, _any, "any")}
        drop = (F.col("_holds") == 1) & (F.col("_held") == 0)
    else:
        large, small = split_modes(mode)
        is_large, is_small = (lambda b: b["cls_id"].isin(large)), (lambda b: b["cls_id"].isin(small))
        conditions = {
            "_held": ("inner", _any, _any, "any"),
            "_by_large": ("inner", _any, is_large, "any"),
            "_other": ("outer", is_small, _any, "other"),
            "_same": ("outer", is_small, _any, "same"),
        }
        drop = (F.col("_by_large") == 1) | (F.col("_other") == 1) | ((F.col("_same") == 1) & (F.col("_held") == 0))
    met, shape = _witnesses(detections, preserved, conditions)
    return detections.join(met.where(drop).select(*shape), shape, "left_anti").select(*detections.columns)


def reading_order(detections: DataFrame) -> DataFrame:
    """Rank by (order_seq, det_id): rows of smaller order plus rank among equals."""
    per_value = detections.groupBy(*PAGE, "order_seq").agg(F.count(F.lit(1)).alias("_n"))
    earlier = ChunkedOrder(PAGE, "order_seq").running(per_value, {"_before": before("sum", F.col("_n"))})
    among = ChunkedOrder([*PAGE, "order_seq"], "det_id").dense(detections, "_among")
    ranked = among.join(earlier.drop("_n"), [*PAGE, "order_seq"])
    return ranked.select(*detections.columns, (F.col("_before") + F.col("_among")).cast("int").alias("idx"))


def attach_polygons(both: DataFrame, keep_fields: Sequence[str], close: Callable[[Column, Column], Column]) -> DataFrame:
    """First raw box near each kept one, through cells of the upper left corner."""
    cell = 8.0
    kept = both.where(~F.col("_raw")).select(*PAGE, "k.*")
    raws = both.where("_raw").select(*PAGE, "r")
    # equal coordinates share their raw box: keep the first of every place
    place = [F.col(f"r.{s}").alias(s) for s in boxes.SIDES]
    raws = (
        raws.groupBy(*PAGE, *place)
        .agg(F.min_by(F.col("r"), F.col("r.det_id")).alias("r"))
        .select(
            *PAGE,
            "r",
            F.floor(F.col("x1") / cell).alias("_cx"),
            F.floor(F.col("y1") / cell).alias("_cy"),
        )
    )
    places = kept.select(*PAGE, *boxes.SIDES).distinct()

    def near(side: str) -> Column:
        reach = F.lit(config.POLYGON_ATOL) + F.lit(config.POLYGON_RTOL) * F.abs(F.col(side))
        return F.sequence(F.floor((F.col(side) - reach) / cell), F.floor((F.col(side) + reach) / cell))

    probes = places.withColumn("_cx", F.explode(near("x1"))).withColumn("_cy", F.explode(near("y1")))
    found = (
        probes.join(raws, [*PAGE, "_cx", "_cy"])
        .where(close(F.col("r"), F.struct(*boxes.SIDES)))
        .groupBy(*PAGE, *boxes.SIDES)
        .agg(F.min_by(F.col("r.polygon"), F.col("r.det_id")).alias("polygon"))
    )
    return kept.join(found, [*PAGE, *boxes.SIDES], "left").select(*PAGE, *keep_fields, "polygon")
