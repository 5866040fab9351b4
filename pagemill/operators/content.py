"""Content rules for a whole column, one projection per step.

Each step refers to the result of the one before several times. Written as one nested
expression the steps would multiply; as projections each is computed once per row, and
all of them still run in one stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import text
from pagemill.functions.strings import bind, strip


def cut_repeated_lines(
    df: DataFrame,
    column: str,
    applies: Column | None = None,
    min_lines: int = config.REPEAT_LINE_COUNT,
    share: float = config.REPEAT_LINE_SHARE,
) -> DataFrame:
    """Cut after the first of three equal lines in a row when one line makes up most of the text.

    The share is above one half, so the line can only be the majority line, which stands in the middle of the sorted
    lines.
    """
    if share <= 0.5:
        raise ValueError("the share of the common line must be above one half")
    columns = df.columns
    content = F.col(column)
    wanted = F.lit(True) if applies is None else applies
    df = df.withColumn("_raw", F.when(wanted, F.split(content, "\n")))
    df = df.withColumn(
        "_lines",
        F.filter(
            F.transform("_raw", lambda line, i: F.struct(strip(line).alias("line"), i.alias("at"))),
            lambda x: x["line"] != "",
        ),
    )
    texts = F.sort_array(F.transform("_lines", lambda x: x["line"]))
    common = F.get(texts, F.floor(F.size("_lines") / 2).cast("int"))
    # bound, as Spark would move the expression of a column of its own into the comparison of each line
    df = df.withColumn("_same", bind(common, lambda c: F.transform("_lines", lambda x: x["line"] == c)))
    count = F.size(F.filter("_same", lambda same: same))
    total = F.size("_same")
    first = F.get(
        F.filter(
            F.transform("_same", lambda same, i: F.when(same & F.get("_same", i + 1) & F.get("_same", i + 2), i)),
            lambda i: i.isNotNull(),
        ),
        F.lit(0),
    )
    df = df.withColumn("_first", F.get("_lines", first)["at"])
    cut = (total >= min_lines) & (count >= min_lines) & (F.try_divide(count, total) >= share) & F.col("_first").isNotNull()
    return df.withColumn(
        column, F.when(cut, F.array_join(F.slice("_raw", F.lit(1), F.col("_first") + 1), "\n")).otherwise(content)
    ).select(*columns)


def cut_long_repeats(df: DataFrame, column: str, applies: Column | None = None) -> DataFrame:
    """For long text: cut at a repeated substring, else at a repeated line."""
    columns = df.columns
    wanted = F.length(column) >= config.LONG_CONTENT
    if applies is not None:
        wanted = wanted & applies
    df = df.withColumn("_cut", text.cut_repeats(F.when(wanted, F.col(column)), config.LONG_CONTENT))
    df = cut_repeated_lines(df, column, wanted & F.col("_cut").isNull())
    return df.withColumn(column, F.coalesce("_cut", column)).select(*columns)


def clean_content(df: DataFrame, column: str, applies: Column | None = None, cut_long: bool = True) -> DataFrame:
    """General clean-up of ``column`` where ``applies``; null becomes empty there."""
    wanted = F.lit(True) if applies is None else applies

    def only(new: Column) -> Column:
        return new if applies is None else F.when(wanted, new).otherwise(F.col(column))

    df = df.withColumn(column, only(text.collapse_punctuation(F.coalesce(column, F.lit("")))))
    if cut_long:
        df = cut_long_repeats(df, column, applies)
    df = df.withColumn(column, only(text.normalise_inline_formula(F.col(column))))
    return df.withColumn(column, only(strip(F.col(column))))


def prepare_content(df: DataFrame, content: str = "content", label: str = "label", cut_long: bool = True) -> DataFrame:
    """First half of the content rules: clean-up, with the cut of repeated text.

    Tables and formulas that have their delimiters are only trimmed. Null stays null.
    """
    columns = df.columns
    df = df.withColumn("_open", ~F.coalesce(text.is_finished(F.col(content), F.col(label)), F.lit(False)))
    body = F.col(content)
    df = df.withColumn(content, F.when(F.col("_open"), text.collapse_punctuation(body)).otherwise(strip(body)))
    if cut_long:
        df = cut_long_repeats(df, content, F.col("_open"))
    inline = strip(text.normalise_inline_formula(body))
    return df.withColumn(content, F.when(F.col("_open"), inline).otherwise(body)).select(*columns)


def finish_content(
    df: DataFrame, content: str = "content", label: str = "label", native: str = "native_label"
) -> DataFrame:
    """Second half: titles, formulas and running text get their Markdown form."""
    body, is_text, is_formula = F.col(content), F.col(label) == "text", F.col(label) == "formula"
    df = df.withColumn(content, text.format_title(body, F.col(native)))
    df = df.withColumn(
        content,
        F.when(is_formula, text.format_formula(body)).when(is_text, text.close_code_fence(body)).otherwise(body),
    )
    for step in (text.normalise_bullet, text.normalise_enumerator, text.double_newlines):
        df = df.withColumn(content, F.when(is_text, step(body)).otherwise(body))
    return df


def format_content(
    df: DataFrame,
    content: str = "content",
    label: str = "label",
    native: str = "native_label",
    cut_long: bool = True,
) -> DataFrame:
    """All content rules for recognised regions; null stays null."""
    return finish_content(prepare_content(df, content, label, cut_long), content, label, native)


def map_labels(
    df: DataFrame, native: str = "native_label", categories: Mapping[str, Sequence[str]] = config.CATEGORY_LABELS
) -> DataFrame:
    return df.withColumn("label", text.map_label(F.col(native), categories))
