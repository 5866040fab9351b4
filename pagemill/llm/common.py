"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import shared_dir

#: UTF-8 bytes of text that a Python step works on at a time; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_buckets(spark: SparkSession, parts: int) -> list[int]:
    """``parts`` numbers that ``repartition(parts, number)`` sends to a partition each, so that none gets two buckets."""
    tried = spark.range(40 * parts).select(F.col("id").cast("int").alias("number"))
    found = tried.groupBy(F.pmod(F.hash("number"), F.lit(parts)).alias("part")).agg(F.min("number").alias("number")).collect()
    return [{r.part: r.number for r in found}.get(p, p) for p in range(parts)]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def plain_names(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named so that none clashes with a name used inside, and the new names of ``wanted``."""
    names = [f"own_{k}_" for k in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(w)] for w in wanted]


def ranked(df: DataFrame, order: list[str], rank: str = "rank_") -> tuple[DataFrame, int]:
    """Number all rows from 0 in ``order`` (which must name rows uniquely) without one task that sees them all.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the counts of
    the partitions before. Only one count per partition reaches the driver. Returns the rows and their number.
    """
    spark = df.sparkSession

    def number(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(n, n + k, dtype=np.int64))],
                names=[*b.schema.names, "part_", "place_"],
            )
            n += k

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    dealt = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    rows = stored(dealt.mapInArrow(number, f"{fields}, part_ int, place_ bigint"))
    total, before = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("part_").count().collect()):
        before.append((part, total))
        total += n
    shift = spark.createDataFrame(before, "part_ int, before_ bigint")
    out = rows.join(F.broadcast(shift), "part_").withColumn(rank, F.col("before_") + F.col("place_"))
    return out.drop("part_", "place_", "before_"), total
