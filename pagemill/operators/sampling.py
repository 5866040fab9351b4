"""Exact samples of a stated size, without bringing a candidate list of every partition together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that a round of counting looks at: at most 4,096 counts reach the driver.
DIGITS = 3
#: Rows around the cut-off that are few enough to be sorted.
SORTED = 10_000


def draw(key: Column, seed: int = 0) -> Column:
    """The number by which rows are drawn, as hexadecimal digits; any engine with MD5 gives the same."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def sample_n(rows: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, those whose ``key`` draws the lowest numbers; all rows where there are fewer.

    The cut-off comes from counts of leading digits, refined until few rows lie around it; the others are kept or dropped
    by a plain filter where they are. Rows of equal key, null keys among them, are taken in the order of their content.
    """
    drawn = rows.withColumn("_draw", draw(key, seed))
    prefix, left = "", n
    while True:
        inside = drawn.where(F.col("_draw").startswith(prefix)) if prefix else drawn
        digits = F.substring("_draw", len(prefix) + 1, DIGITS)
        counts = sorted(tuple(r) for r in inside.groupBy(digits.alias("digits")).count().collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return rows
        for bucket, count in counts:
            if count >= left:
                break
            left -= count
        prefix += bucket
        if count <= SORTED or len(prefix) + DIGITS > 32:
            break
    head = drawn.where(F.substring("_draw", 1, len(prefix)) < prefix)
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    edge = drawn.where(F.col("_draw").startswith(prefix)).orderBy("_draw", content).limit(left)
    return head.unionByName(edge).drop("_draw")


def truncate_tokens(text: Column, most: int) -> Column:
    """The first ``most`` tokens between white space, one space between them; shorter texts as they are."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.when(F.size(tokens) > most, F.array_join(F.slice(tokens, 1, most), " ")).otherwise(text)
