"""Ordered work inside a group: running values, neighbours and dense positions.

Most groups (the regions of a page) are small, and a window over the group is the
right plan. One group may still hold a large share of all rows; then a window would
put that share into one task. :class:`ChunkedOrder` gives the same results from
chunks of the position column: a window inside each chunk, one total per chunk, a
window over the few totals, and a join of the carried value back to the chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import BROADCAST_ROWS, PAGE_KEYS, PAGE_ROWS_LIMIT, SCAN_CHUNK
from pagemill.session import materialise

_AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}
# kind of aggregate, its input, and whether the row itself is left out
Running = tuple[str, Column, bool]


def upto(kind: str, col: Column) -> Running:
    """Aggregate over the rows up to this one."""
    return kind, col, False


def before(kind: str, col: Column) -> Running:
    """Aggregate over the rows before this one."""
    return kind, col, True


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


class WindowOrder:
    """Ordered access through one window per group; for groups of bounded size."""

    def __init__(self, keys: list[str], pos: str):
        self.keys = list(keys)
        self.pos = pos

    def spread(self, df: DataFrame) -> DataFrame:
        """Shuffle rows the way the other methods need them."""
        return df.repartition(*self.keys)

    def running(self, df: DataFrame, outs: dict[str, Running], reverse: bool = False) -> DataFrame:
        """Aggregates from the start of the group (or its end)."""
        order = F.col(self.pos).desc() if reverse else F.col(self.pos).asc()
        window = Window.partitionBy(*self.keys).orderBy(order)
        frames = {strict: window.rowsBetween(Window.unboundedPreceding, -1 if strict else 0) for strict in (False, True)}
        return df.withColumns(
            {name: _AGGREGATES[kind](col).over(frames[strict]) for name, (kind, col, strict) in outs.items()}
        )

    def shifted(self, df: DataFrame, outs: dict[str, tuple[int, Column]]) -> DataFrame:
        """Columns of the row so many positions away (negative: before)."""
        window = Window.partitionBy(*self.keys).orderBy(self.pos)
        return df.withColumns({name: F.lead(col, offset).over(window) for name, (offset, col) in outs.items()})

    def nearest_later(self, df: DataFrame, wanted: Column, outs: dict[str, Column]) -> DataFrame:
        """Columns of the first later row for which ``wanted`` holds."""
        window = (
            Window.partitionBy(*self.keys)
            .orderBy(F.col(self.pos).desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return df.withColumns(
            {name: F.last(F.when(wanted, col), ignorenulls=True).over(window) for name, col in outs.items()}
        )

    def dense(self, df: DataFrame, out: str) -> DataFrame:
        """Zero-based position after rows were removed."""
        window = Window.partitionBy(*self.keys).orderBy(self.pos)
        return df.withColumn(out, F.row_number().over(window) - 1)

    def kept(self, df: DataFrame, keep: Column, out: str) -> DataFrame:
        """Drop rows without ``keep`` and number the others from 0.

        The rows are filtered after they are counted: a filter in front of the window
        would be pushed down to the scan and repeat everything ``keep`` is computed from.
        """
        flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
        counted = self.running(flagged, {"_kept": upto("sum", F.when(F.col("_keep"), 1).otherwise(0))})
        return counted.where("_keep").withColumn(out, (F.col("_kept") - 1).cast("int")).drop("_keep", "_kept")


class ChunkedOrder(WindowOrder):
    """The same results for groups of any size; ``pos`` must be a unique integer."""

    def __init__(self, keys: list[str], pos: str, chunk: int = SCAN_CHUNK, durable: bool = True):
        super().__init__(keys, pos)
        self.chunk = chunk
        self.durable = durable

    def _input(self, df: DataFrame) -> DataFrame:
        """Rows are read twice below; a durable scan computes them once."""
        return materialise(df) if self.durable else df

    def spread(self, df: DataFrame) -> DataFrame:
        return df.repartition(*self.keys, F.floor(F.col(self.pos) / self.chunk))

    def running(self, df: DataFrame, outs: dict[str, Running], reverse: bool = False) -> DataFrame:
        names = df.columns
        chunked = self._input(
            df.withColumns(
                {
                    "_chunk": F.floor(F.col(self.pos) / self.chunk),
                    **{f"_in_{name}": col for name, (_, col, _) in outs.items()},
                }
            )
        )
        inner = WindowOrder([*self.keys, "_chunk"], self.pos)
        local = inner.running(
            chunked, {f"_local_{n}": (kind, F.col(f"_in_{n}"), strict) for n, (kind, _, strict) in outs.items()}, reverse
        )
        totals = chunked.groupBy(*self.keys, "_chunk").agg(
            *[_AGGREGATES[kind](f"_in_{n}").alias(f"_total_{n}") for n, (kind, _, _) in outs.items()]
        )
        outer = WindowOrder(self.keys, "_chunk")
        carried = outer.running(
            totals, {f"_carry_{n}": before(kind, F.col(f"_total_{n}")) for n, (kind, _, _) in outs.items()}, reverse
        ).drop(*[f"_total_{n}" for n in outs])
        joined = local.join(carried, [*self.keys, "_chunk"])
        return joined.select(
            *[c for c in names if c not in outs],
            *[
                _combine(kind, F.col(f"_carry_{n}"), F.col(f"_local_{n}")).alias(n)
                for n, (kind, _, _) in outs.items()
            ],
        )

    def shifted(self, df: DataFrame, outs: dict[str, tuple[int, Column]]) -> DataFrame:
        df = self._input(df)
        result = df
        for offset in {offset for offset, _ in outs.values()}:
            others = df.select(
                *self.keys,
                (F.col(self.pos) - offset).alias(self.pos),
                *[col.alias(name) for name, (o, col) in outs.items() if o == offset],
            )
            result = result.join(others, [*self.keys, self.pos], "left")
        return result

    def nearest_later(self, df: DataFrame, wanted: Column, outs: dict[str, Column]) -> DataFrame:
        aimed = self._input(self.running(df, {"_at": before("min", F.when(wanted, F.col(self.pos)))}, reverse=True))
        others = aimed.where(wanted).select(
            *self.keys, F.col(self.pos).alias("_at"), *[col.alias(name) for name, col in outs.items()]
        )
        return aimed.join(others, [*self.keys, "_at"], "left").drop("_at")

    def dense(self, df: DataFrame, out: str) -> DataFrame:
        counted = self.running(df, {"_dense": upto("sum", F.lit(1))})
        return counted.withColumn(out, (F.col("_dense") - 1).cast("int")).drop("_dense")


def split_by_page_size(
    df: DataFrame, pos: str, limit: int = PAGE_ROWS_LIMIT, keys: list[str] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of pages of bounded size, and the rows of all others (None when there are none).

    ``pos`` numbers the rows of a page from 0, so a page with more than ``limit`` rows
    has a row with ``pos >= limit``. That test is a plain predicate on one column: the
    parquet reader skips every row group without such a row, so it is nearly free when
    no page is large.
    """
    keys = list(keys or PAGE_KEYS)
    beyond = df.where(F.col(pos) >= limit).select(*keys)
    if beyond.isEmpty():
        return df, None
    big = materialise(beyond.distinct())
    if big.count() <= BROADCAST_ROWS:
        big = F.broadcast(big)
    return df.join(big, keys, "left_anti"), materialise(df.join(big, keys, "left_semi"))


def by_page_size(
    df: DataFrame,
    pos: str,
    ordinary: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    limit: int = PAGE_ROWS_LIMIT,
    keys: list[str] | None = None,
) -> DataFrame:
    """Run ``ordinary`` on pages of bounded size and ``large`` on all others."""
    rest, hot = split_by_page_size(df, pos, limit, keys)
    return ordinary(rest) if hot is None else ordinary(rest).unionByName(large(hot))


def number_in_document(
    df: DataFrame,
    out: str,
    unit: str = "unit_id",
    page: str = "page_idx",
    pos: str = "idx",
    start: int = 0,
) -> DataFrame:
    """Number the rows of a document in (page, position) order.

    A window over the document would put a long document into one task. The rows of
    each page are numbered in chunks of positions; what comes before a chunk is summed
    up from the counts of chunks and pages.
    """
    chunk = F.floor(F.col(pos) / SCAN_CHUNK)
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy(unit, page, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    in_page = WindowOrder([unit, page], "_chunk").running(counts, {"_earlier": before("sum", F.col("_n"))}).drop("_n")
    per_page = counts.groupBy(unit, page).agg(F.sum("_n").alias("_n"))
    pages = ChunkedOrder([unit], page, durable=False).running(per_page, {"_before": before("sum", F.col("_n"))})
    offsets = in_page.join(pages.drop("_n"), [unit, page])
    numbered = rows.withColumn(
        "_at", F.row_number().over(Window.partitionBy(unit, page, "_chunk").orderBy(pos)) - 1
    )
    number = F.col("_before") + F.coalesce("_earlier", F.lit(0)) + F.col("_at") + start
    return (
        numbered.join(offsets, [unit, page, "_chunk"])
        .withColumn(out, number.cast("int"))
        .drop("_before", "_earlier", "_at", "_chunk")
    )


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Zero-based position in a total order, without gathering rows in one task.

    Rows are range-partitioned by Spark's sort; the rank is the offset inside the
    partition plus the size of the partitions before it. Only one row per partition
    is ever brought together.
    """
    ranked = materialise(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    ranked = ranked.withColumns(
        {"_part": F.shiftright("_row", 33), "_offset": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    return (
        ranked.join(F.broadcast(earlier), "_part")
        .withColumn(out, F.col("_before") + F.col("_offset"))
        .drop("_part", "_offset", "_row", "_before")
    )
