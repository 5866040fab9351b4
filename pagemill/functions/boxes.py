"""Column arithmetic on boxes. A box is anything with fields x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def literal_map(values: Mapping) -> Column:
    """A map literal; small fixed tables only."""
    return F.create_map(*[F.lit(part) for item in values.items() for part in item])


def lookup(values: Mapping, key: Column) -> Column:
    """Value of ``key`` in a small fixed table, null when absent."""
    if not values:
        return F.lit(None)
    return F.try_element_at(literal_map(values), key)


def _overlap(a: Column, b: Column, plus: int) -> Column:
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + plus
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + plus
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; sides count pixels, so every length is one longer."""
    inter = _overlap(a, b, 1)
    area_a = (a["x2"] - a["x1"] + 1) * (a["y2"] - a["y1"] + 1)
    area_b = (b["x2"] - b["x1"] + 1) * (b["y2"] - b["y1"] + 1)
    return F.coalesce(F.try_divide(inter, area_a + area_b - inter), F.lit(0.0))


def contained_ratio(a: Column, b: Column) -> Column:
    """Share of ``a`` covered by ``b``; 0 for a box without area."""
    area = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    return F.when(area > 0, F.try_divide(_overlap(a, b, 0), area)).otherwise(F.lit(0.0))


def is_contained(a: Column, b: Column, ratio: float) -> Column:
    return contained_ratio(a, b) >= ratio


def to_thousandths(value: Column, extent: Column) -> Column:
    """Pixel to 0-1000, truncated; null for an extent of 0. Dividing first is part of the definition."""
    return (F.try_divide(value.cast("double"), extent) * 1000).cast("int")


def to_thousandths_rounded(value: Column, extent: Column) -> Column:
    """Pixel to 0-1000 as the service reports it: multiply first, round half to even."""
    return F.when(extent > 0, F.bround(value.cast("double") * 1000 / extent).cast("int")).otherwise(
        value.cast("int")
    )


def from_thousandths(value: Column, extent: Column) -> Column:
    """0-1000 to pixel, truncated."""
    return (value * extent / F.lit(1000.0)).cast("int")


def polygon_from_thousandths(value: Column, extent: Column, origin: Column) -> Column:
    """0-1000 to crop-local pixel; here the scale is computed first."""
    return (value * (extent / F.lit(1000.0))).cast("int") - origin


def unclip_sides(
    x1: Column, y1: Column, x2: Column, y2: Column, ratio_w: Column, ratio_h: Column
) -> tuple[Column, Column, Column, Column]:
    """Scale a box about its centre."""
    width, height = x2 - x1, y2 - y1
    cx, cy = x1 + width / 2, y1 + height / 2
    half_w, half_h = width * ratio_w / 2, height * ratio_h / 2
    return cx - half_w, cy - half_h, cx + half_w, cy + half_h


def unclip_ratios(ratio: float | Sequence[float] | Mapping[int, Sequence[float]], cls: Column) -> tuple[Column, Column]:
    """Width and height ratio; null for classes a per-class table does not name."""
    if isinstance(ratio, Mapping):
        return (
            lookup({int(k): float(v[0]) for k, v in ratio.items()}, cls),
            lookup({int(k): float(v[1]) for k, v in ratio.items()}, cls),
        )
    if isinstance(ratio, (int, float)):
        return F.lit(float(ratio)), F.lit(float(ratio))
    if len(ratio) != 2:
        raise ValueError("an unclip ratio pair has two entries")
    return F.lit(float(ratio[0])), F.lit(float(ratio[1]))


def clamp(value: Column, extent: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, extent.cast("double")))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Four-point polygon of a box."""
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def polygon_or_rectangle(polygon: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Outline traced from a mask, or the box when the outline is unusable.

    Boxes without area and outlines of fewer than four points fall back to the box
    with its corners truncated to whole pixels.
    """
    corners = [side.cast("int").cast("double") for side in (x1, y1, x2, y2)]
    no_area = (x2.cast("int") <= x1.cast("int")) | (y2.cast("int") <= y1.cast("int"))
    unusable = no_area | polygon.isNull() | (F.size(polygon) < 4)
    return F.when(unusable, rectangle(*corners)).otherwise(polygon)


def plan_render(width_pt: Column, height_pt: Column, dpi: float, max_side: float) -> Column:
    """Scale at which a page is rendered so that its longer side stays within bounds."""
    scale = F.lit(dpi / 72.0)
    longer = F.greatest(width_pt, height_pt).cast("double")
    return F.when(longer * scale > max_side, F.lit(float(max_side)) / longer).otherwise(scale)


def smart_resize(
    height: Column,
    width: Column,
    frames: Column,
    frame_factor: int = 1,
    factor: int = 28,
    min_pixels: int = 112 * 112,
    max_pixels: int = 14 * 14 * 4 * 15000,
) -> Column:
    """Target size as ``struct(h, w)``: multiples of ``factor`` within the pixel budget."""
    h, w, t = (c.cast("double") for c in (height, width, frames))
    near = [F.bround(side / factor) * factor for side in (h, w)]
    near_t = F.bround(t / frame_factor) * frame_factor
    total = near_t * near[0] * near[1]
    shrink = F.sqrt(t * h * w / max_pixels)
    grow = F.sqrt(F.lit(float(min_pixels)) / (t * h * w))

    def side(value: Column, rounded: Column) -> Column:
        return (
            F.when(total > max_pixels, F.floor(value / shrink / factor) * factor)
            .when(total < min_pixels, F.ceil(value * grow / factor) * factor)
            .otherwise(rounded)
            .cast("int")
        )

    checked = F.when(t < frame_factor, F.raise_error(F.lit("fewer frames than the frame factor")))
    sized = F.struct(side(h, near[0]).alias("h"), side(w, near[1]).alias("w"))
    return F.when(checked.isNull(), sized)
