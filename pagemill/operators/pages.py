"""Units and their pages: numbering, limits, batches, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.ordering import ChunkedOrder, before, global_rank


def number_pages(pages: DataFrame, units: DataFrame) -> DataFrame:
    """Global page number over all units in unit order.

    ``pages`` has ``unit_id, page_idx`` with pages of a unit numbered from 0 without
    gaps; ``units`` has ``unit_id, unit_idx``. Only the page counts of the units are
    summed up, in chunks of the unit index.
    """
    counts = pages.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n"))
    per_unit = units.join(counts, "unit_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    offsets = ChunkedOrder([], "unit_idx", durable=False).running(
        per_unit, {"_before": before("sum", F.col("_n"))}
    )
    return pages.join(offsets.select("unit_id", "unit_idx", "_before"), "unit_id").withColumn(
        "global_page", F.col("_before") + F.col("page_idx")
    ).drop("_before")


def local_page_index(pages: DataFrame, page_no: str, out: str = "page_idx") -> DataFrame:
    """Zero-based page index per unit from any increasing page number."""
    return ChunkedOrder(["unit_id"], page_no, durable=False).dense(pages, out)


def limit_pages(pages: DataFrame, max_pages: int | str | None) -> DataFrame:
    """First ``max_pages`` pages of every unit; all of them without a positive number."""
    try:
        wanted = int(max_pages) if max_pages is not None else 0
    except (TypeError, ValueError):
        wanted = 0
    return pages.where(F.col("page_idx") < wanted) if wanted > 0 else pages


def page_range(pages: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages ``first`` to ``last``, both counted from 1 and included."""
    number = F.col("page_idx") + 1
    if first is not None:
        pages = pages.where(number >= first)
    return pages if last is None else pages.where(number <= last)


def page_batches(pages: DataFrame, size: int) -> DataFrame:
    """Number of the detector batch a page falls into; batches end with the unit."""
    return pages.withColumn("batch", F.floor(F.col("page_idx") / size).cast("int"))


def tolerant_expand(units: DataFrame, pages: Column, error: Column | None = None) -> DataFrame:
    """Explode the page array of each unit; a unit without usable pages keeps one empty row.

    ``error`` describes a source that could not be read; its unit is kept, without pages.
    """
    usable = F.when(error.isNull(), pages) if error is not None else pages
    kept = units.withColumn("error", error if error is not None else F.lit(None).cast("string"))
    return kept.select(
        *[c for c in kept.columns], F.posexplode_outer(F.filter(usable, lambda p: p.isNotNull())).alias("page_idx", "page")
    )


def units_without_pages(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Units that still owe an (empty) result."""
    return units.join(pages.select("unit_id").distinct(), "unit_id", "left_anti")


def document_metadata(units: DataFrame, pages: DataFrame, dpi: int = 200, image_format: str = "png") -> DataFrame:
    """File facts of each unit with its page count and the size of its first page."""
    summary = pages.groupBy("unit_id").agg(
        F.count(F.lit(1)).cast("int").alias("pages"),
        F.min_by("width", "page_idx").alias("width"),
        F.min_by("height", "page_idx").alias("height"),
    )
    return units.join(summary, "unit_id", "left").withColumns(
        {"pages": F.coalesce("pages", F.lit(0)), "dpi": F.lit(dpi), "format": F.lit(image_format)}
    )


def round_robin(files: DataFrame, shards: int, path: str = "path") -> DataFrame:
    """Shard number of each file: position in path order modulo ``shards``."""
    return global_rank(files, [path], "_at").withColumn("shard", F.pmod("_at", F.lit(shards)).cast("int")).drop("_at")


def reshard(files: DataFrame, lost: list[int], survivors: list[int], path: str = "path") -> DataFrame:
    """Deal the files of lost shards out to the surviving ones."""
    if not survivors:
        raise ValueError("no shard is left to take the files")
    stay = files.where(~F.col("shard").isin(lost))
    moved = round_robin(files.where(F.col("shard").isin(lost)).drop("shard"), len(survivors), path)
    target = F.element_at(F.array(*[F.lit(s) for s in survivors]), F.col("shard") + 1)
    return stay.unionByName(moved.withColumn("shard", target))


MODES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_mode(name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Make a DataFrame transformation selectable by name."""
    MODES[name] = transform


def run_mode(name: str, df: DataFrame) -> DataFrame:
    if name not in MODES:
        raise KeyError(f"unknown processing mode {name!r}; known: {', '.join(sorted(MODES))}")
    return df.transform(MODES[name])
