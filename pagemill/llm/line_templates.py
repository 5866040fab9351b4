"""Line dedup by a tree of log templates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import plain_names, stored

#: Leading words that, with the number of words, name a leaf of the tree.
DEPTH = 2
#: Documents (of different text) that a template must occur in to be dropped; words of a line from which that holds, and
#: the documents that a shorter line must occur in.
MIN_DOCS, MIN_WORDS, SHORT_DOCS = 3, 3, 10
#: Share of a template's words that must be fixed.
FIXED = 0.6
#: A word is fixed where this share of the texts has it that have the rarest of the words that must be fixed; and texts
#: that hold a template must be this share of those that have its rarest word.
COMMON, TOGETHER = 0.5, 0.5
#: Different lines before a template, and after it, as a share of the texts that hold it.
SPREAD = 0.8
#: Share of a document's words that must be its own for a template to go: in lines that one text has, or that are at least
#: ``RARER`` times as rare as the template.
OWN, RARER = 0.4, 4
#: What stands for a variable field. Words with a digit are variable from the start.
FIELD = "<*>"


def parsed(docs: DataFrame, depth: int) -> DataFrame:
    """One row per line with a letter: ``id_, tie_, line_, masked_, words_, all_, leaf_, before_, after_``.

    Words are what single spaces separate; those with a digit are masked. ``all_`` counts the words of the whole text.
    ``before_`` and ``after_`` are hashes of the masked neighbour lines (of the text, at its ends); they tell lines of
    copied documents, which have an equal neighbour everywhere, from lines that recur in different surroundings.
    """
    masked = F.expr(
        f"""transform(split(text_, '\n'), l -> if(l rlike '[0-9]',
            array_join(transform(split(l, ' '), w -> if(w rlike '[0-9]', '{FIELD}', w)), ' '), l))"""
    )
    lines = docs.select("id_", "tie_", masked.alias("lines_"))
    hashed = lines.withColumn("hashes_", F.expr("transform(lines_, l -> xxhash64(l))")).withColumn(
        "all_", F.expr("aggregate(lines_, 0L, (n, l) -> n + length(l) - length(replace(l, ' ', '')) + 1)")
    )
    around = """transform(lines_, (l, k) -> named_struct('line_', k, 'masked_', l,
        'before_', if(k > 0, hashes_[greatest(k - 1, 0)], tie_),
        'after_', if(k + 1 < size(hashes_), hashes_[least(k + 1, size(hashes_) - 1)], tie_)))"""
    rows = hashed.select("id_", "tie_", "all_", F.explode(F.expr(around)).alias("x")).select("id_", "tie_", "all_", "x.*")
    words = F.char_length("masked_") - F.char_length(F.replace("masked_", F.lit(" "), F.lit(""))) + 1
    rows = rows.withColumn("words_", words).filter(F.col("masked_").rlike(r"\p{L}"))
    return rows.withColumn("leaf_", F.xxhash64("words_", F.substring_index("masked_", " ", depth)))


def templates(forms: DataFrame, depth: int, min_docs: int, min_words: int, fixed: float) -> DataFrame:
    """The template of every form of a line: ``mask_, template_, rarest_``; forms without one are left out.

    In a leaf it is counted how many texts have each word at each place. A form must have ``fixed`` of its words fixed,
    one behind the leading ones at least (all, where it is shorter than ``min_words``). The rarest of its so many most
    common words sets the measure: words that at least ``COMMON`` as many texts have are fixed, the others are fields.
    The measure moves with the number of texts, so the same line has the same fields in a small and a large corpus.
    """
    words = forms.select("mask_", "leaf_", "n_", F.posexplode(F.split("masked_", " ")).alias("place_", "word_"))
    often = words.groupBy("leaf_", "place_", "word_").agg(F.sum("n_").alias("in_")).filter(F.col("in_") >= min_docs)
    counted = words.join(often, ["leaf_", "place_", "word_"], "left").withColumn("in_", F.coalesce("in_", F.lit(1)))
    form = counted.groupBy("mask_").agg(F.array_sort(F.collect_list(F.struct("place_", "word_", "in_"))).alias("w"))
    needed = f"if(size(w) < {min_words}, size(w), greatest(cast(ceil({fixed} * size(w)) as int), {depth + 1}))"
    counts = f"reverse(array_sort(transform(filter(w, x -> x.word_ <> '{FIELD}'), x -> x.in_)))"
    measured = form.withColumn("measure_", F.expr(f"get({counts}, {needed} - 1)")).filter("measure_ is not null")
    is_fixed = f"(x.word_ <> '{FIELD}' and x.in_ >= {COMMON} * measure_)"
    return measured.select(
        "mask_",
        F.expr(f"array_join(transform(w, x -> if({is_fixed}, x.word_, '{FIELD}')), ' ')").alias("template_"),
        F.expr(f"array_min(transform(filter(w, x -> {is_fixed}), x -> x.in_))").alias("rarest_"),
    )


def recurring_lines(
    docs: DataFrame,
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_words: int = MIN_WORDS,
    fixed: float = FIXED,
    spread: float = SPREAD,
    short_docs: int = SHORT_DOCS,
    own: float = OWN,
) -> DataFrame:
    """The lines that belong to a template recurring across documents: ``id_, tie_, line_, template_``.

    The tree has a fixed depth: a leaf is named by the number of words of a line and its leading words, variable
    fields masked. In a leaf, lines are generalised to templates (see :func:`templates`). A template is common if at least
    ``min_docs`` texts hold it (``short_docs`` for lines of fewer than ``min_words`` words), and at least ``TOGETHER`` of
    those that have its rarest word: common words that only happen to meet make no template.

    A common template may be boilerplate or belong to copied documents. A line of it goes where the text is otherwise
    different: either the lines before the template, and those after it, are at least ``spread`` times as many as its
    texts, or at least the share ``own`` of this text's words lies in lines that are its own or ``RARER`` times rarer; that also
    holds for blocks of several lines, which are about equally frequent. At least ``min_docs`` (``short_docs``) texts must
    have it so. Lines without a letter are never dropped. Texts are counted by their hash, so exact copies count once. All
    counts are over all rows and summed up per task before a shuffle; the lines of a leaf never meet in one task.
    """
    lines = parsed(docs, depth)
    shared = lines.groupBy("leaf_").agg(F.count_distinct("tie_").alias("n_")).filter(F.col("n_") >= min_docs).select("leaf_")
    lines = stored(lines.join(shared, "leaf_", "left_semi").withColumn("mask_", F.xxhash64("masked_")))
    held = lines.groupBy("mask_").agg(F.count_distinct("tie_").alias("n_"))
    forms = stored(lines.groupBy("mask_").agg(F.first("leaf_").alias("leaf_"), F.first("masked_").alias("masked_")).join(held, "mask_"))
    named = stored(templates(forms, depth, min_docs, min_words, fixed))
    places = lines.select("tie_", "before_", "after_", "words_", "mask_").join(named, "mask_")
    counts = places.groupBy("template_").agg(
        F.max("rarest_").alias("rarest_"), F.max("words_").alias("words_"), *[F.count_distinct(c).alias(c) for c in ("tie_", "before_", "after_")]
    )
    enough = F.when(F.col("words_") < min_words, short_docs).otherwise(min_docs)
    common = counts.filter((F.col("tie_") >= enough) & (F.col("tie_") >= TOGETHER * F.col("rarest_")))
    apart = F.least("before_", "after_") >= spread * F.col("tie_")
    common = common.select("template_", F.col("tie_").alias("often_"), apart.alias("apart_"), enough.alias("enough_"))
    judged = stored(forms.select("mask_", "n_").join(named.join(common, "template_"), "mask_", "left"))
    rows = lines.select("id_", "tie_", "line_", "words_", "all_", "mask_").join(judged, "mask_")
    frequency = F.greatest(F.col("n_"), F.coalesce("often_", F.lit(0)))
    # so many times rarer is a difference of logarithms; the margin takes up their rounding
    apart_by = f"{math.log2(RARER) - 1e-7:.9f}D"
    less = f"sum(words_) over (partition by id_, tie_ order by log_ range between unbounded preceding and {apart_by} preceding)"
    single = "sum(if(log_ = 0, words_, 0)) over (partition by id_, tie_)"
    seen = "sum(words_) over (partition by id_, tie_)"
    copies = "count(*) over (partition by id_, tie_, line_)"  # a row repeated with identifier and text has its lines as often
    rows = rows.withColumn("log_", F.log2(frequency.cast("double")))
    rows = rows.withColumn("rare_", F.expr(f"all_ + (greatest(coalesce({less}, 0), {single}) - {seen}) / {copies}"))
    free = rows.filter(F.col("template_").isNotNull() & F.col("often_").isNotNull() & (F.col("apart_") | (F.col("rare_") >= own * F.col("all_"))))
    free = stored(free.select("id_", "tie_", "line_", "template_", "enough_"))
    recurring = free.groupBy("template_", "enough_").agg(F.count_distinct("tie_").alias("n_")).filter("n_ >= enough_")
    return free.drop("enough_").join(recurring.select("template_"), "template_", "left_semi")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).withColumn(
        "tie_", F.xxhash64("text_")
    )


def with_gone_lines(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``df`` with ``gone_lines_``, the numbers of its lines that recur, null where there are none."""
    gone = recurring_lines(keyed(df, id_col, text_col), **options)
    gone = gone.groupBy("id_", "tie_").agg(F.collect_set("line_").alias("gone_lines_"))
    tie = F.xxhash64(F.coalesce(df[text_col], F.lit("")))
    match = df[id_col].cast("bigint").eqNullSafe(gone["id_"]) & (tie == gone["tie_"])
    return df.join(gone, match, "left").select(*(df[c] for c in df.columns), "gone_lines_")


def rest_of(text_col: str):
    left = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (l, k) -> not array_contains(gone_lines_, k)), '\\n')")
    return F.when(F.col("gone_lines_").isNull(), F.col(text_col)).otherwise(left)


def cut_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns, without the lines of recurring templates; texts without such lines stay as they are.

    Null and empty texts stay. Rows repeated with identifier and text are cut alike. A text that consists of such lines
    only becomes empty. An empty table gives no rows.
    """
    own, (id_, text) = plain_names(df, id_col, text_col)
    return with_gone_lines(own, id_, text, **options).withColumn(text, rest_of(text)).drop("gone_lines_").toDF(*df.columns)


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped, kept_sha256`` of the text without recurring lines; null counts as empty, which has one line.

    An empty table gives no rows. Rows repeated with identifier and text are cut alike; counts are of texts, so there are no
    ties to settle. Other columns are ignored.
    """
    own = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_gone_lines(own, "doc_id", "text", **options)
    return rows.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone_lines_"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(rest_of("text").cast("binary"), 256).alias("kept_sha256"),
    )
