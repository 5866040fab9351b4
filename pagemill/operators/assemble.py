"""From regions to pages, documents and results.

A document is the ordered list of its pages. Documents of ordinary length are one row;
longer ones are several rows, *parts*, keyed by ``(part_page, part_seq)``. Joined in
that order, the Markdown of the parts is the Markdown of the document, and their page
lists are its page list. No row ever has to hold more than ``PAGES_PER_PART`` pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import config
from pagemill.operators import content as content_rules
from pagemill.operators.ordering import ChunkedOrder, number_in_document, split_by_page_size
from pagemill.session import materialise

PAGE = config.PAGE_KEYS
BOX = ["bx1", "by1", "bx2", "by2"]
PAGE_BREAK = "\n\n---\n\n"


def matched_crops(regions: DataFrame, crops: DataFrame, categories=config.CATEGORY_LABELS) -> DataFrame:
    """Image regions for which a crop of exactly their box exists, with a running number.

    Equal boxes of a page share one crop, yet every region gets its own number. Numbers
    run through the document in reading order.
    """
    is_image = F.col("native_label").isin(list(categories["image"]))
    if "task_type" in regions.columns:
        is_image = is_image | F.coalesce(F.col("task_type") == "skip", F.lit(False))
    images = regions.where(is_image).select(*PAGE, "idx", *BOX)
    found = images.join(crops.select(*PAGE, *BOX).distinct(), [*PAGE, *BOX])
    return number_in_document(found.select(*PAGE, "idx"), "image_no")


def attach_image_numbers(regions: DataFrame, numbered: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``image_no``.

    Pages whose regions all come before ``limit`` get it through one list per page, which
    joins on the key the repairs use anyway; without a limit regions are matched one by one.
    """
    if limit is None:
        return regions.join(numbered, [*PAGE, "idx"], "left")
    per_page = numbered.where(F.col("idx") < limit).groupBy(*PAGE).agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "image_no"))).alias("_numbers")
    )
    joined = regions.join(per_page, PAGE, "left")
    return joined.withColumn("image_no", F.try_element_at("_numbers", F.col("idx"))).drop("_numbers")


def image_file(prefix: str, page: Column, number: Column) -> Column:
    return F.concat(
        F.lit(f"imgs/{prefix}_page"), page.cast("string"), F.lit("_idx"), number.cast("string"), F.lit(".jpg")
    )


def with_pieces(regions: DataFrame, prefix: str = "cropped") -> DataFrame:
    """Add ``image_path`` and ``piece``, what the region contributes to the Markdown."""
    path = F.when(
        F.col("is_image") & F.col("image_no").isNotNull(), image_file(prefix, F.col("page_idx"), F.col("image_no"))
    )
    with_path = regions.withColumn("image_path", path)
    tag = F.concat(
        F.lit("![Image "), F.col("page_idx").cast("string"), F.lit("-"), F.col("image_no").cast("string"),
        F.lit("]("), F.col("image_path"), F.lit(")"),
    )
    piece = F.when(F.col("is_image"), F.when(F.col("image_path").isNotNull(), tag)).otherwise(F.col("content"))
    return with_path.withColumn("piece", F.when(piece != "", piece))


_REGION = ["idx", "label", "native_label", "content", *BOX, "image_path", "piece"]


def page_fragments(regions: DataFrame) -> DataFrame:
    """Regions of a page in order, in arrays of bounded size."""
    present = [c for c in _REGION if c in regions.columns] + (["polygon"] if "polygon" in regions.columns else [])
    fragment = F.floor(F.col("idx") / config.REGIONS_PER_FRAGMENT).cast("int")
    grouped = (
        regions.withColumn("fragment", fragment)
        .groupBy(*PAGE, "fragment")
        .agg(F.sort_array(F.collect_list(F.struct(*present))).alias("regions"))
    )
    pieces = F.filter(F.transform("regions", lambda r: r["piece"]), lambda p: p.isNotNull())
    return grouped.withColumn("page_text", F.array_join(pieces, "\n\n")).withColumn(
        "regions", F.transform("regions", lambda r: r.dropFields("piece"))
    )


def assemble_pages(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per page (fragment) with its ordered regions; pages without regions stay."""
    fragments = page_fragments(regions)
    return pages.select(*PAGE).join(fragments, PAGE, "left").select(
        *PAGE,
        F.coalesce("fragment", F.lit(0)).alias("fragment"),
        F.coalesce("regions", F.array().cast(fragments.schema["regions"].dataType)).alias("regions"),
        F.coalesce("page_text", F.lit("")).alias("page_text"),
    )


def assemble_documents(
    regions: DataFrame, pages: DataFrame, large: DataFrame | None = None, pages_per_part: int = config.PAGES_PER_PART
) -> DataFrame:
    """Documents as parts: ``n_pages, n_regions, json_result, markdown``.

    ``regions`` are those of ordinary pages; ``large`` those of pages beyond the limit,
    of which every fragment becomes a part of its own.
    """
    block = F.floor(F.col("page_idx") / pages_per_part).cast("int")
    if large is None:
        rows = assemble_pages(regions, pages).withColumn("_start", block * pages_per_part)
        return _parts(rows)
    large = materialise(page_fragments(large))
    hot_pages = materialise(large.select(*PAGE).distinct())
    hot_blocks = hot_pages.select("unit_id", block.alias("_block")).distinct()
    plain = pages.select(*PAGE).join(hot_pages, PAGE, "left_anti")
    rows = assemble_pages(regions, plain).withColumn("_block", block)
    # pages around a large one stand alone, so that its fragments fit in between
    rows = rows.join(hot_blocks.withColumn("_near", F.lit(True)), ["unit_id", "_block"], "left").withColumn(
        "_start", F.when(F.col("_near"), F.col("page_idx")).otherwise(F.col("_block") * pages_per_part)
    )
    parts = _parts(rows.drop("_block", "_near"))
    first_text = large.groupBy(*PAGE).agg(
        F.min(F.when(F.col("page_text") != "", F.col("fragment"))).alias("_first")
    )
    opens_page = (F.col("fragment") == 0) & (F.col("page_idx") > 0)
    continues = (F.col("fragment") > F.col("_first")) & (F.col("page_text") != "")
    glue = F.when(opens_page | F.coalesce(continues, F.lit(False)), F.lit("\n\n")).otherwise(F.lit(""))
    hot_parts = large.join(first_text, PAGE).select(
        "unit_id",
        F.col("page_idx").alias("part_page"),
        F.col("fragment").alias("part_seq"),
        F.when(F.col("fragment") == 0, 1).otherwise(0).alias("n_pages"),
        F.size("regions").alias("n_regions"),
        F.array("regions").alias("json_result"),
        F.concat(glue, "page_text").alias("markdown"),
    )
    return parts.unionByName(hot_parts)


def _parts(rows: DataFrame) -> DataFrame:
    page = F.struct("page_idx", "page_text", "regions")
    grouped = rows.groupBy("unit_id", F.col("_start").alias("part_page")).agg(
        F.sort_array(F.collect_list(page)).alias("pages")
    )
    text = F.array_join(F.transform("pages", lambda p: p["page_text"]), "\n\n")
    counted = F.aggregate("pages", F.lit(0), lambda n, p: n + F.size(p["regions"]))
    return grouped.select(
        "unit_id",
        "part_page",
        F.lit(0).alias("part_seq"),
        F.size("pages").alias("n_pages"),
        counted.alias("n_regions"),
        F.transform("pages", lambda p: p["regions"]).alias("json_result"),
        F.concat(F.when(F.col("part_page") > 0, F.lit("\n\n")).otherwise(F.lit("")), text).alias("markdown"),
    )


def raw_snapshot(regions: DataFrame) -> DataFrame:
    """Regions as recognised, before formatting, renumbered."""
    window = Window.partitionBy(*PAGE).orderBy("idx")

    def number(df: DataFrame) -> DataFrame:
        return df.withColumn("idx", F.row_number().over(window) - 1)

    rest, hot = split_by_page_size(regions, "idx")
    rows = number(rest)
    if hot is not None:
        rows = rows.unionByName(ChunkedOrder(PAGE, "idx").dense(hot, "idx"))
    columns = [*PAGE, "idx", F.col("native_label").alias("label"), "content", *BOX]
    return rows.select(*columns, *(["polygon"] if "polygon" in regions.columns else []))


def unit_completion(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units whose expected number of regions has been recognised.

    ``units`` has one row per finalised unit with ``expected``; ``done`` one row per
    recognised region, replays included. Regions are counted once each.
    """
    counts = done.groupBy("unit_id", "region_id").agg(F.lit(1).alias("one")).groupBy("unit_id").agg(
        F.count("one").alias("n_done")
    )
    joined = units.join(counts, "unit_id", "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)))
    return joined.withColumn("ready", F.col("n_done") >= F.col("expected"))


def format_plain_pages(
    page_texts: DataFrame, cut_long: bool = True, pages_per_part: int = config.PAGES_PER_PART
) -> DataFrame:
    """Documents recognised page by page without layout: ``unit_id, page_idx, content``."""
    cleaned = content_rules.clean_content(page_texts.select(*PAGE, "content"), "content", cut_long=cut_long)
    start = (F.floor(F.col("page_idx") / pages_per_part) * pages_per_part).cast("int")
    grouped = cleaned.groupBy("unit_id", start.alias("part_page")).agg(
        F.sort_array(F.collect_list(F.struct("page_idx", "content"))).alias("pages")
    )
    region = lambda p: F.array(
        F.struct(
            F.lit(0).alias("index"),
            F.lit("text").alias("label"),
            p["content"].alias("content"),
            F.lit(None).cast("array<int>").alias("bbox_2d"),
        )
    )
    text = F.array_join(F.transform("pages", lambda p: p["content"]), PAGE_BREAK)
    return grouped.select(
        "unit_id",
        "part_page",
        F.size("pages").alias("n_pages"),
        F.transform("pages", region).alias("json_result"),
        F.concat(F.when(F.col("part_page") > 0, F.lit(PAGE_BREAK)).otherwise(F.lit("")), text).alias("markdown"),
    )


def merge_units(results: DataFrame, units_per_part: int = config.PAGES_PER_PART) -> DataFrame:
    """Results of one request: ``request_id, unit_idx, json, markdown`` in unit order.

    No unit gives an empty text, one unit its own result, several a list and their
    Markdown with rules between. Requests of very many units become several parts; joined in
    order of ``part_unit`` their JSON is one list and their Markdown one text.
    """
    start = (F.floor(F.col("unit_idx") / units_per_part) * units_per_part).cast("int")
    grouped = results.groupBy("request_id", start.alias("part_unit")).agg(
        F.sort_array(F.collect_list(F.struct("unit_idx", "json", "markdown"))).alias("units")
    )
    ends = results.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_all"), F.min(start).alias("_first"), F.max(start).alias("_last")
    )
    grouped = grouped.join(ends, "request_id")
    several, opens, closes = F.col("_all") > 1, F.col("part_unit") == F.col("_first"), F.col("part_unit") == F.col("_last")
    jsons = F.array_join(F.transform("units", lambda u: u["json"]), ", ")
    text = F.array_join(F.transform("units", lambda u: u["markdown"]), PAGE_BREAK)
    return grouped.select(
        "request_id",
        "part_unit",
        F.size("units").alias("n_units"),
        F.concat(
            F.when(~opens, ", ").when(several, "[").otherwise(""), jsons, F.when(several & closes, "]").otherwise("")
        ).alias("json_result"),
        F.concat(F.when(opens, "").otherwise(PAGE_BREAK), text).alias("markdown_result"),
    )


IMAGE_HTML = '<div style="text-align: center;"><img src="{src}" alt="Image"/></div>\n'


def merge_blocks(regions: DataFrame, file_url: str = "file?path=") -> DataFrame:
    """Blocks of the task report: document-wide ids from 1, pages from 1.

    Image blocks become an HTML image. Other blocks without content give an empty text.
    """
    numbered = number_in_document(regions, "block_id", start=1)
    page_no = F.col("page_idx") + 1
    path = F.format_string("split_%d_%04d.png", page_no, F.col("block_id"))
    before, after = IMAGE_HTML.split("{src}")
    html = F.concat(F.lit(before + file_url), path, F.lit(after))
    label = "native_label" if "native_label" in regions.columns else "label"
    return numbered.select(
        "unit_id",
        "page_idx",
        "idx",
        "block_id",
        page_no.alias("page_index"),
        F.when(F.col(label) == "image", html).otherwise(F.coalesce("content", F.lit(""))).alias("block_content"),
        *BOX,
        F.when(F.col(label) == "image", path).alias("image_path"),
    )


def merged_document(
    blocks: DataFrame, metadata: DataFrame | None = None, pages_per_part: int = config.PAGES_PER_PART
) -> DataFrame:
    """Task report: ``metadata, full_markdown, layout`` per document (part).

    The blocks of a page come together first, in bounded lists, then the pages.
    """
    chunk = F.floor(F.col("idx") / config.REGIONS_PER_FRAGMENT).cast("int")
    block = F.struct(
        "block_id", "block_content", F.array(*BOX).alias("bbox"), "page_index"
    )
    lists = blocks.groupBy("unit_id", "page_idx", chunk.alias("_chunk")).agg(
        F.sort_array(F.collect_list(block)).alias("layout")
    )
    # around a page beyond one list every page, and every further list, is a part of its own
    start = (F.floor(F.col("page_idx") / pages_per_part) * pages_per_part).cast("int")
    crowded = blocks.where(F.col("idx") >= config.REGIONS_PER_FRAGMENT).select(
        "unit_id", start.alias("_start"), F.lit(True).alias("_split")
    ).distinct()
    placed = lists.withColumn("_start", start).join(crowded, ["unit_id", "_start"], "left").withColumns(
        {
            "part_page": F.when(F.col("_split"), F.col("page_idx")).otherwise(F.col("_start")),
            "part_seq": F.when(F.col("_split"), F.col("_chunk")).otherwise(F.lit(0)),
        }
    )
    grouped = placed.groupBy("unit_id", "part_page", "part_seq").agg(
        F.sort_array(F.collect_list(F.struct("page_idx", "layout"))).alias("pages")
    )
    merged = grouped.withColumn("layout", F.flatten(F.transform("pages", lambda p: p["layout"])))
    text = F.array_join(F.transform("layout", lambda b: F.concat(b["block_content"], F.lit("\n"))), "")
    result = merged.select("unit_id", "part_page", "part_seq", text.alias("full_markdown"), "layout")
    if metadata is not None:
        result = result.join(metadata.select("unit_id", "metadata"), "unit_id", "left")
    return result


def label_profile(regions: DataFrame, label: str = "label") -> DataFrame:
    """Number of regions per page and label."""
    return regions.groupBy(*PAGE, label).agg(F.count(F.lit(1)).alias("n"))


def profile_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages and labels where two runs disagree."""
    a, b = left.withColumnRenamed("n", "n_left"), right.withColumnRenamed("n", "n_right")
    label = next(c for c in left.columns if c not in (*PAGE, "n"))
    joined = a.join(b, [*PAGE, label], "full")
    return joined.where(~F.col("n_left").eqNullSafe(F.col("n_right")))


def stable_order(regions: DataFrame) -> DataFrame:
    """Regions of a page in order of their index, in lists of bounded size."""
    chunk = F.floor(F.col("idx") / config.REGIONS_PER_FRAGMENT).cast("int")
    rest = [c for c in regions.columns if c not in (*PAGE, "idx")]
    return regions.groupBy(*PAGE, chunk.alias("fragment")).agg(
        F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("regions")
    )

