"""Places where a user's model or codec joins in, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import config
from pagemill.session import materialise

PAGE = config.PAGE_KEYS
PAGES_PER_BATCH = 64
DETECTION_TYPE = (
    "array<struct<det_id:int,cls_id:int,score:double,x1:double,y1:double,x2:double,y2:double,order_seq:int>>"
)


def _in_batches(values: Sequence[Any], size: int) -> Iterator[Sequence[Any]]:
    for start in range(0, len(values), size):
        yield values[start : start + size]


def apply_detector(
    pages: DataFrame,
    load: Callable[[], Callable[[list[Any]], Sequence[Sequence[dict]]]],
    image: str = "image",
    batch: int = 8,
) -> DataFrame:
    """Run a layout detector over the pages and return a detection table.

    ``load`` is called once per task and returns the detector, which maps a list of images to a
    list of detections per image. A batch that fails is repeated image by image; an image
    that fails alone gives no detections and an error text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for frame in frames:
            found: list[list[dict]] = []
            errors: list[str | None] = []
            for images in _in_batches(list(frame[image]), batch):
                try:
                    result = [list(r) for r in detect(list(images))]
                    found += result
                    errors += [None] * len(result)
                except Exception:
                    for one in images:
                        try:
                            found.append(list(detect([one])[0]))
                            errors.append(None)
                        except Exception as e:
                            found.append([])
                            errors.append(str(e))
            numbered = [[{"det_id": i, **d} for i, d in enumerate(ds)] for ds in found]
            yield pd.DataFrame(
                {"unit_id": frame["unit_id"], "page_idx": frame["page_idx"], "detections": numbered, "error": errors}
            )

    unit_type = pages.schema["unit_id"].dataType.simpleString()
    schema = f"unit_id {unit_type}, page_idx int, detections {DETECTION_TYPE}, error string"
    return pages.select(*PAGE, image).mapInPandas(run, schema)


def detections_of(detected: DataFrame) -> DataFrame:
    """Detection table from detector output."""
    return detected.select(*PAGE, F.inline("detections"))


def apply_recogniser(
    regions: DataFrame,
    load: Callable[[], Callable[[list[dict]], Sequence[tuple[int, str | None]]]],
    inputs: Sequence[str],
    batch: int = 32,
) -> DataFrame:
    """Recognise the content of all regions that are not to be skipped.

    ``load`` returns a function from a list of input rows to ``(status, text)`` pairs.
    Skipped regions never reach it: the rows are parted before the Python stage, because
    a filter behind it would not be moved in front of it. A failing row, or a status other than 200, gives null content.
    """
    keys = [*PAGE, "idx"]
    regions = materialise(regions)  # both branches read it
    skipped = F.coalesce(F.col("task_type") == "skip", F.lit(False))
    rest = [c for c in regions.columns if c not in (*keys, "content")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = load()
        for frame in frames:
            contents: list[str | None] = []
            for rows in _in_batches(frame[list(inputs)].to_dict("records"), batch):
                try:
                    answers: Iterable[tuple[int, str | None]] = recognise(list(rows))
                except Exception:
                    answers = [_one(recognise, row) for row in rows]
                contents += [text.strip() if status == 200 and text is not None else None for status, text in answers]
            yield frame.assign(content=pd.Series(contents, index=frame.index, dtype=object))

    wanted = regions.where(~skipped).select(*keys, *rest)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    done = wanted.mapInPandas(run, f"{types}, content string")
    kept = regions.where(skipped).select(*keys, *rest, F.lit(None).cast("string").alias("content"))
    return done.unionByName(kept)


def _one(recognise: Callable[[list[dict]], Sequence[tuple[int, str | None]]], row: dict) -> tuple[int, str | None]:
    try:
        return recognise([row])[0]
    except Exception as e:
        return 500, str(e)


def expand_documents(
    units: DataFrame, load: Callable[[], Callable[[bytes, int | None], Iterable[dict]]], max_pages: int | None = None
) -> DataFrame:
    """Pages of documents through a user's renderer; a unit that cannot be read yields one error row.

    The renderer gets the page limit, since a limit behind the Python stage would not
    stop it from rendering. It yields dicts with ``width, height, image``; a page may carry
    an ``error`` instead, and the pages after it still count.
    """

    columns = ["unit_id", "page_idx", "width", "height", "image", "error"]

    def rows_of(unit, content, expand) -> Iterator[tuple]:
        number = 0
        try:
            for page in expand(content, max_pages):
                if page.get("error") is not None:
                    yield unit, None, None, None, None, page["error"]
                    continue
                yield unit, number, page["width"], page["height"], page["image"], None
                number += 1
                if max_pages and number >= max_pages:
                    return
        except Exception as e:
            yield unit, None, None, None, None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = load()
        for frame in frames:
            pages = (
                row for unit, content in zip(frame["unit_id"], frame["content"]) for row in rows_of(unit, content, expand)
            )
            # pages leave in small groups, so a long document is never held as a whole
            while group := list(islice(pages, PAGES_PER_BATCH)):
                yield pd.DataFrame(group, columns=columns).astype({"page_idx": "Int32", "width": "Int32", "height": "Int32"})

    unit_type = units.schema["unit_id"].dataType.simpleString()
    schema = f"unit_id {unit_type}, page_idx int, width int, height int, image binary, error string"
    return units.select("unit_id", "content").mapInPandas(run, schema)


# --- cropping ----------------------------------------------------------------

#: Bytes of crops, and their number, that a task passes on at a time.
CROP_BYTES, CROP_ROWS = 1 << 22, 10_000


def crop_array(pixels: np.ndarray, box: Sequence[int], polygon: Sequence[Sequence[int]] | None) -> np.ndarray:
    """Rectangle of an image, white outside the polygon; all coordinates in thousandths."""
    height, width = pixels.shape[:2]
    x1, y1, x2, y2 = (int(box[i] * (width if i % 2 == 0 else height) / 1000) for i in range(4))
    if x2 < x1 or y2 < y1:
        raise ValueError("box without area")
    # beyond the image a crop is black
    cut = np.zeros((y2 - y1, x2 - x1, *pixels.shape[2:]), dtype=pixels.dtype)
    inside = pixels[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
    top, left = max(-y1, 0), max(-x1, 0)
    cut[top : top + inside.shape[0], left : left + inside.shape[1]] = inside
    if polygon is None or len(polygon) < 3:
        return cut
    points = [(int(p[0] * (width / 1000)) - x1, int(p[1] * (height / 1000)) - y1) for p in polygon]
    cut[~polygon_mask(points, cut.shape[1], cut.shape[0])] = 255
    return cut


def polygon_mask(points: Sequence[tuple[int, int]], width: int, height: int) -> np.ndarray:
    """Pixels inside a polygon or on its outline (even-odd rule)."""
    xs, ys = np.arange(width, dtype=float)[None, :], np.arange(height, dtype=float)[:, None]
    inside = np.zeros((height, width), dtype=bool)
    edge = np.zeros((height, width), dtype=bool)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]]):
        crosses = (ay > ys) != (by > ys)
        if ay != by:
            inside ^= crosses & (xs < (bx - ax) * (ys - ay) / (by - ay) + ax)
        length = max(abs(bx - ax), abs(by - ay))
        steps = np.arange(length + 1) / max(length, 1)
        x = np.rint(ax + (bx - ax) * steps).astype(int)
        y = np.rint(ay + (by - ay) * steps).astype(int)
        seen = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        edge[y[seen], x[seen]] = True
    return inside | edge


def crop_regions(images: DataFrame, regions: DataFrame, use_polygon: bool = False) -> DataFrame:
    """Pixels of each region.

    ``images`` holds decoded pages as Spark's ``image`` source gives them: ``unit_id,
    page_idx, image``. The regions of a page are gathered first, so a page is sent once
    per group of regions and not once per region. A region that cannot be cut keeps empty
    content.
    """
    box = [F.col(c) for c in ("bx1", "by1", "bx2", "by2")]
    polygon = F.col("polygon") if use_polygon and "polygon" in regions.columns else F.lit(None).cast("array<array<int>>")
    group = F.floor(F.col("idx") / 64)
    wanted = regions.groupBy(*PAGE, group.alias("_group")).agg(
        F.collect_list(F.struct("idx", F.array(*box).alias("box"), polygon.alias("polygon"))).alias("_regions")
    )
    joined = wanted.join(images.select(*PAGE, "image"), PAGE, "left").select(
        *PAGE, "_regions", *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")]
    )
    unit_type = regions.schema["unit_id"].dataType.simpleString()
    schema = f"unit_id {unit_type}, page_idx int, idx int, height int, width int, nChannels int, data binary, content string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            kinds = [batch.schema.field("unit_id").type, *[pa.int32()] * 5, pa.binary(), pa.string()]

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

            pages = zip(*(batch.column(c).to_pylist() for c in (*PAGE, "height", "width", "nChannels")))
            for k, (unit, page, *shape) in enumerate(pages):
                pixels, data = None, batch.column("data")[k].as_buffer()  # a page without image: its regions keep empty content
                if data is not None:
                    pixels = np.frombuffer(data, dtype=np.uint8).reshape(shape)
                for region in batch.column("_regions")[k].as_py():
                    try:
                        piece = crop_array(pixels, region["box"], region["polygon"])
                        out.append((unit, page, region["idx"], *piece.shape[:2], pixels.shape[2], piece.tobytes(), None))
                        size += piece.nbytes
                    except Exception:
                        out.append((unit, page, region["idx"], None, None, None, None, ""))
                    if size >= CROP_BYTES or len(out) >= CROP_ROWS:
                        yield flush()
                        out, size = [], 0
            if out:
                yield flush()
                out, size = [], 0

    names = [*PAGE, "idx", "height", "width", "nChannels", "data", "content"]
    return joined.mapInArrow(cut, schema)
