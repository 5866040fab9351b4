"""Image references of Markdown, matched to pages and regions by joins.

A text is split at its references; each reference is a row with its place, joined to what it names, and the text is put
together again in order of the places. Documents may have any number of pages and regions: no row holds a list of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import text
from pagemill.operators.assemble import image_file
from pagemill.operators.ordering import number_in_document

PAGE = config.PAGE_KEYS
#: Any reference to an image region, also one whose box lies partly outside its page.
_TAG = r"!\[\]\(page=\d+,bbox=\[[-\d,\s]+\]\)"


def references(documents: DataFrame, markdown: str = "markdown", pattern: str = text.REFERENCE) -> DataFrame:
    """The references of each document in order: ``unit_id, place, ref``."""
    found = F.regexp_extract_all(markdown, F.lit(pattern), F.lit(0))
    return documents.select("unit_id", F.posexplode(found).alias("place", "ref"))


def _put_back(documents: DataFrame, replaced: DataFrame, markdown: str, pattern: str) -> DataFrame:
    """Documents with the references at their places changed to ``new``; those without references stay as they are."""
    lists = replaced.groupBy("unit_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "new"))), lambda r: r["new"]).alias("_new")
    )
    between = F.split(F.col(markdown), pattern, -1)
    pieces = F.zip_with(F.concat(F.array(F.lit("")), F.col("_new")), between, lambda ref, piece: F.concat(ref, piece))
    joined = F.when(F.col("_new").isNotNull(), F.array_join(pieces, "")).otherwise(F.col(markdown))
    return documents.join(lists, "unit_id", "left").withColumn(markdown, joined).select(*documents.columns)


def rewrite_references(documents: DataFrame, pages: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Bring the boxes of references to thousandths of the page they name.

    ``documents`` has one row per ``unit_id``, ``pages`` ``unit_id, page_idx, width, height``. References to unknown
    pages, pages without size or with other than four numbers stay.
    """
    refs = references(documents, markdown).withColumn("page_idx", text.reference_page(F.col("ref")))
    sized = refs.join(pages.select(*PAGE, "width", "height"), PAGE, "left")
    new = text.scaled_reference(F.col("ref"), F.col("page_idx"), F.col("width"), F.col("height"))
    return _put_back(documents, sized.select("unit_id", "place", new.alias("new")), markdown, text.REFERENCE)


def region_tag(page: Column, box: Column) -> Column:
    """The reference that Markdown has for a region."""
    return F.concat(F.lit("![](page="), page.cast("string"), F.lit(",bbox=["), F.array_join(box.cast("array<string>"), ", "), F.lit("])"))


def resolve_tags(
    documents: DataFrame, regions: DataFrame, loaded: DataFrame, prefix: str = "cropped", markdown: str = "markdown"
) -> tuple[DataFrame, DataFrame]:
    """Documents whose references to image regions name files, and the regions with ``image_path``.

    ``regions`` has ``unit_id, page_idx, pos, label, bbox_2d``; ``loaded`` the pages whose image can be cropped. Every
    image region with a box on such a page gets the next number of its document, and its reference, where the text has
    it, becomes the file's: of equal references the first goes to the first region, and so on. Other references stay.
    """
    boxed = (F.col("label") == "image") & (F.size("bbox_2d") == 4)
    usable = regions.where(boxed).join(loaded.select(*PAGE).distinct(), PAGE, "left_semi")
    numbered = number_in_document(usable.select(*PAGE, "pos", "bbox_2d"), "image_no", pos="pos")
    path = image_file(prefix, F.col("page_idx"), F.col("image_no"))
    tagged = numbered.withColumns({"image_path": path, "ref": region_tag(F.col("page_idx"), F.col("bbox_2d"))})
    turn = F.row_number().over(Window.partitionBy("unit_id", "ref").orderBy("image_no"))
    shown = F.concat(
        F.lit("![Image "), F.col("page_idx").cast("string"), F.lit("-"), F.col("image_no").cast("string"), F.lit("]("), "image_path", F.lit(")")
    )
    news = tagged.select("unit_id", "ref", turn.alias("turn"), shown.alias("shown"))
    refs = references(documents, markdown, _TAG)
    refs = refs.withColumn("turn", F.row_number().over(Window.partitionBy("unit_id", "ref").orderBy("place")))
    replaced = refs.join(news, ["unit_id", "ref", "turn"], "left").select("unit_id", "place", F.coalesce("shown", "ref").alias("new"))
    with_path = regions.join(tagged.select(*PAGE, "pos", "image_path"), [*PAGE, "pos"], "left")
    return _put_back(documents, replaced, markdown, _TAG), with_path.select(*regions.columns, "image_path")
