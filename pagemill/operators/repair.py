"""Repairs across the regions of a page, in reading order.

Regions carry ``unit_id, page_idx, idx, native_label, content, bx1`` and any further
columns, which travel along. ``idx`` numbers the regions of a page from 0. The order of
the repairs is fixed: format, formula numbers, hyphens, bullets. Each takes the way of
access to neighbours as an argument, so the same rule serves pages of every size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import text
from pagemill.functions.strings import drop_last, is_blank, lstrip, rstrip
from pagemill.operators import content as content_rules
from pagemill.operators.ordering import WindowOrder, before, upto
from pagemill.session import materialise

PAGE = config.PAGE_KEYS
PAGE_ORDER = WindowOrder(PAGE, "idx")


def format_regions(
    regions: DataFrame,
    order: WindowOrder = PAGE_ORDER,
    categories: Mapping[str, Sequence[str]] = config.CATEGORY_LABELS,
    cut_long: bool = True,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Map labels, format content, drop blank regions (images stay) and renumber.

    ``attach`` adds columns by page and index, before the regions are renumbered; it gets them when they lie by page, so
    its join shuffles no content.
    """
    rows = content_rules.map_labels(regions, categories=categories)
    is_image = F.col("label") == "image"
    if "task_type" in rows.columns:
        is_image = is_image | F.coalesce(F.col("task_type") == "skip", F.lit(False))
    # One shuffle by page serves all repairs. It comes behind the only Python step, which
    # hides the partitioning from the planner, and before the rules that take the most
    # time, so that these are spread by page instead of by input file.
    rows = content_rules.prepare_content(rows.withColumn("is_image", is_image), cut_long=cut_long)
    rows = order.spread(rows)
    rows = content_rules.finish_content(attach(rows) if attach else rows)
    keep = F.col("is_image") | ~is_blank(F.col("content"))
    return order.kept(rows.drop("task_type", "score"), keep, "idx")


def merge_formula_numbers(regions: DataFrame, order: WindowOrder = PAGE_ORDER) -> DataFrame:
    """Join each formula number to the formula next to it, as its tag.

    Pairing goes from left to right, so within a stretch where formulas and numbers
    alternate the partners are positions 0-1, 2-3, and so on. A number without a partner
    is dropped; a formula without one stays.
    """
    columns = regions.columns
    carried = [c for c in columns if c not in (*PAGE, "idx")]
    kind = F.when(F.col("native_label") == "formula_number", "number").when(F.col("label") == "formula", "formula")
    around = {"_before": (-1, F.col("_kind")), "_after": (1, F.col("_kind"))}
    rows = order.shifted(
        regions.withColumn("_kind", kind), {**around, **{f"_next_{c}": (1, F.col(c)) for c in carried}}
    )
    starts = F.col("_kind").isNull() | F.col("_before").isNull() | (F.col("_before") == F.col("_kind"))
    rows = order.running(rows, {"_start": upto("max", F.when(starts, F.col("idx")))})
    leads = (F.col("idx") - F.col("_start")) % 2 == 0
    paired = leads & F.col("_kind").isNotNull() & F.coalesce(F.col("_after") != F.col("_kind"), F.lit(False))
    rows = rows.withColumns({"_leads": leads, "_paired": paired})
    keep = F.col("_kind").isNull() | (F.col("_leads") & (F.col("_paired") | (F.col("_kind") == "formula")))
    rows = rows.withColumn("_stays", keep)
    number_first = F.col("_paired") & (F.col("_kind") == "number")
    number = F.when(number_first, F.col("content")).otherwise(F.col("_next_content"))
    rows = rows.withColumn("_number", F.when(F.col("_paired"), text.clean_formula_number(number)))
    rows = rows.withColumns(
        {c: F.when(number_first, F.col(f"_next_{c}")).otherwise(F.col(c)) for c in carried}
    )
    tagged = F.concat(drop_last(F.col("content"), 3), F.lit(" \\tag{"), F.col("_number"), F.lit("}\n$$"))
    takes_tag = F.col("_paired") & F.col("content").endswith("\n$$")
    rows = rows.withColumn("content", F.when(takes_tag, tagged).otherwise(F.col("content")))
    return order.kept(rows.select(*columns, "_stays"), F.col("_stays"), "idx").select(*columns)


def _words(col: Column) -> Column:
    return F.filter(F.split(col, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def merge_hyphenated(
    regions: DataFrame, order: WindowOrder = PAGE_ORDER, lexicon: DataFrame | None = None
) -> DataFrame:
    """Join a text block that ends in a hyphen with the next block starting in lower case.

    The partner is the first later text block that starts with a lower-case letter, over
    whatever lies between; it is removed when the joined word is plausible. A block that
    was removed joins nothing itself. Only such a partner can be removed, so whether it
    is depends on the blocks since the partner before it, and on that one's own fate:
    removed if any other block takes it; otherwise, if the partner before it would take
    it, removed exactly when that one stays. The last case flips a state, so the fate
    follows from the last partner with a certain fate and the number of flips since.
    """
    columns = regions.columns
    body = F.col("content")
    is_text = (F.col("label") == "text") & ~is_blank(body)
    rows = regions.withColumns(
        {
            "_lower": F.coalesce(is_text & lstrip(body).rlike(r"^\p{IsLowercase}"), F.lit(False)),
            "_hyphen": F.coalesce(is_text & rstrip(body).endswith("-"), F.lit(False)),
        }
    )
    rows = order.nearest_later(rows, F.col("_lower"), {"_joined": lstrip(body)})
    rows = rows.withColumn("_head", F.when(F.col("_hyphen"), drop_last(rstrip(body), 1)))
    last_word = F.element_at(_words(F.col("_head")), -1)
    first_word = F.get(_words(F.col("_joined")), F.lit(0))
    has_both = F.col("_hyphen") & F.col("_joined").isNotNull() & (F.size(_words(F.col("_head"))) > 0)
    rows = rows.withColumn("_word", F.when(has_both, F.concat(last_word, first_word)))
    frequency = None
    if lexicon is not None:
        rows = _with_frequency(rows, lexicon)
        frequency = F.col("_frequency")
    takes = F.col("_word").isNotNull() & text.is_plausible_word(F.col("_word"), frequency)
    rows = rows.withColumn("_takes", F.coalesce(takes, F.lit(False)))

    at = F.col("idx")
    rows = order.running(
        rows,
        {
            "_taker": before("max", F.when(F.col("_takes") & ~F.col("_lower"), at)),
            "_last": before("max", F.when(F.col("_lower"), F.struct("idx", "_takes"))),
            "_count": upto("sum", F.when(F.col("_lower"), 1).otherwise(0)),
        },
    )
    taken = F.coalesce(F.col("_taker") > F.coalesce(F.col("_last.idx"), F.lit(-1)), F.lit(False))
    flips = ~taken & F.coalesce(F.col("_last._takes"), F.lit(False))
    rows = rows.withColumns({"_taken": taken, "_flips": flips})
    certain = F.when(F.col("_lower") & ~F.col("_flips"), F.struct("idx", "_count", "_taken"))
    rows = order.running(rows, {"_certain": upto("max", certain)})
    # every partner since the last certain one flips
    odd = (F.col("_count") - F.col("_certain._count")) % 2 == 1
    removed = F.col("_lower") & (F.col("_certain._taken") != odd)
    rows = rows.withColumn("_stays", ~F.coalesce(removed, F.lit(False)))
    rows = rows.withColumn("content", F.when(F.col("_takes"), F.concat("_head", "_joined")).otherwise(body))
    return order.kept(rows.select(*columns, "_stays"), F.col("_stays"), "idx").select(*columns)


def _with_frequency(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Look joined words up in a table ``(word, zipf)`` of any size.

    Only the distinct words that occur are looked up: they prune the lexicon, and what is found of them, far less than
    either table, is what meets the rows. It is broadcast only where it was counted to be small.
    """
    token = F.lower(F.col("_word"))
    asked = rows.where(F.col("_word").isNotNull()).select(token.alias("_token")).distinct()
    words = lexicon.groupBy(F.col("word").alias("_token")).agg(F.max("zipf").alias("_frequency"))
    found = materialise(words.join(asked, "_token", "left_semi"))
    if found.count() <= config.BROADCAST_ROWS:
        return rows.withColumn("_token", token).join(F.broadcast(found), "_token", "left").drop("_token")
    # rows without a word get a key of their own, so they do not meet in one task
    nobody = F.concat(F.lit("\u0001"), F.xxhash64(*PAGE, "idx").cast("string"))
    return rows.withColumn("_token", F.coalesce(token, nobody)).join(found, "_token", "left").drop("_token")


def infill_bullets(
    regions: DataFrame, order: WindowOrder = PAGE_ORDER, tolerance: float = config.BULLET_TOLERANCE
) -> DataFrame:
    """Give a text block between two aligned bullets a bullet of its own."""
    columns = regions.columns
    seen = {"native": F.col("native_label"), "content": F.col("content"), "left": F.col("bx1")}
    rows = order.shifted(
        regions, {f"{side}_{n}": (at, c) for side, at in (("_prev", -1), ("_next", 1)) for n, c in seen.items()}
    )
    between = (F.col("native_label") == "text") & ~F.col("content").startswith("- ")
    for side in ("_prev", "_next"):
        between = (
            between
            & (F.col(f"{side}_native") == "text")
            & F.col(f"{side}_content").startswith("- ")
            & (F.abs(F.col("bx1") - F.col(f"{side}_left")) <= tolerance)
        )
    filled = F.when(F.coalesce(between, F.lit(False)), F.concat(F.lit("- "), F.col("content")))
    return rows.withColumn("content", F.coalesce(filled, F.col("content"))).select(*columns)


def repair_regions(
    regions: DataFrame,
    order: WindowOrder = PAGE_ORDER,
    merge_numbers: bool = True,
    merge_text: bool = True,
    bullets: bool = True,
    lexicon: DataFrame | None = None,
    cut_long: bool = True,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Format regions and apply the repairs that are switched on; ``attach`` as in :func:`format_regions`."""
    rows = format_regions(regions, order, cut_long=cut_long, attach=attach)
    if merge_numbers:
        rows = merge_formula_numbers(rows, order)
    if merge_text:
        rows = merge_hyphenated(rows, order, lexicon)
    return infill_bullets(rows, order) if bullets else rows
