"""From recognised regions to finished documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import config
from pagemill.operators import assemble, repair
from pagemill.operators.ordering import ChunkedOrder, WindowOrder, by_page_size, split_by_page_size
from pagemill.session import materialise
from pagemill.sources import sinks

PAGE = config.PAGE_KEYS


#: Regions of a page and a way of access to their neighbours; gives the rows with their final content, numbered anew.
Formatter = Callable[[DataFrame, WindowOrder], DataFrame]


def finished_regions(
    regions: DataFrame,
    crops: DataFrame | None = None,
    image_prefix: str = "cropped",
    lexicon: DataFrame | None = None,
    limit: int = config.PAGE_ROWS_LIMIT,
    formatter: Formatter | None = None,
    **switches: bool,
) -> tuple[DataFrame, DataFrame | None]:
    """Regions with their final content, image numbers and pieces of Markdown: of ordinary pages, and of larger ones.

    ``formatter`` takes the place of the usual repairs. Its rows carry ``image_no`` besides the columns of regions;
    what it gives back needs ``label``, ``is_image`` and an ``idx`` from 0. It is called for pages of every size, with
    an order that suits them.
    """
    rest, hot = split_by_page_size(regions, "idx", limit)
    # a narrow table of the image rows alone; kept apart, it is computed and planned once
    images = None if crops is None else materialise(assemble.matched_crops(regions, crops))

    def finished(rows: DataFrame, order: WindowOrder, by_list: int | None) -> DataFrame:
        def attach(df: DataFrame) -> DataFrame:
            if images is None:
                return df.withColumn("image_no", F.lit(None).cast("int"))
            return assemble.attach_image_numbers(df, images, by_list)

        # the usual repairs attach the numbers behind their own shuffle by page
        final = formatter(attach(rows), order) if formatter else repair.repair_regions(rows, order, lexicon=lexicon, attach=attach, **switches)
        return assemble.with_pieces(final, image_prefix)

    ordinary = finished(rest, WindowOrder(PAGE, "idx"), limit)
    return ordinary, None if hot is None else materialise(finished(hot, ChunkedOrder(PAGE, "idx"), None))


def documents(
    regions: DataFrame,
    pages: DataFrame,
    crops: DataFrame | None = None,
    image_prefix: str = "cropped",
    lexicon: DataFrame | None = None,
    limit: int = config.PAGE_ROWS_LIMIT,
    pages_per_part: int = config.PAGES_PER_PART,
    formatter: Formatter | None = None,
    **switches: bool,
) -> DataFrame:
    """JSON and Markdown of every document; ``formatter`` as in :func:`finished_regions`.

    Content crosses the network twice: once by page for the repairs and page texts, once
    by document for the assembly. Image numbers are worked out from the image rows alone.
    """
    ordinary, large = finished_regions(regions, crops, image_prefix, lexicon, limit, formatter, **switches)
    return assemble.assemble_documents(ordinary, pages, large, pages_per_part)


def document_pages(regions: DataFrame, pages: DataFrame, crops: DataFrame | None = None, **options) -> DataFrame:
    """The pages of every document: ``unit_id, page_idx, fragment, n_regions, page_json, page_text``.

    One shape for documents of any length: a row per page, or per piece of a page of very many regions, in the order of
    ``(page_idx, fragment)``. Pages without regions have one row. This is what the sink of document files takes.
    """
    ordinary, large = finished_regions(regions, crops, **options)
    rows = ordinary if large is None else ordinary.unionByName(large)
    whole = assemble.assemble_pages(rows, pages)
    return whole.select(
        *PAGE, "fragment", F.size("regions").alias("n_regions"), sinks.page_json(F.col("regions")).alias("page_json"), "page_text"
    )


def on_pages(
    regions: DataFrame, rule: Callable[[DataFrame, WindowOrder], DataFrame], limit: int = config.PAGE_ROWS_LIMIT
) -> DataFrame:
    """Apply a repair to pages of every size."""
    return by_page_size(
        regions,
        "idx",
        lambda df: rule(df, WindowOrder(PAGE, "idx")),
        lambda df: rule(df, ChunkedOrder(PAGE, "idx")),
        limit,
    )


def page_documents(regions: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """Only the Markdown of every document, with page and region counts."""
    return documents(regions, pages, **options).select(
        "unit_id", "part_page", "part_seq", "n_pages", "n_regions", "markdown"
    )
