"""A store of tables keyed by unit, from which a few units are read without the others.

Rows lie in folders by a hash of ``unit_id``, sorted by unit in their files. The units of a micro-batch name the folders
that they lie in, so whole folders, and by the files' statistics whole row groups, are never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Folders of a store: a bound on what the driver sees of the units of a micro-batch.
SLOTS = 64
SLOT = "unit_slot"


def slot_of(unit: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(unit.cast("bigint")), F.lit(slots)).cast("int")


def write_units(df: DataFrame, path: str, slots: int = SLOTS, mode: str = "append") -> None:
    """Add rows with a ``unit_id`` to the store at ``path``. A slot may hold a very large unit: files are cut at their size by Spark."""
    by_slot = df.withColumn(SLOT, slot_of(F.col("unit_id"), slots))
    by_slot.sortWithinPartitions(SLOT, "unit_id").write.mode(mode).partitionBy(SLOT).parquet(path)


def open_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table of ``schema`` stored at ``path``; no file is opened to learn its columns."""
    return spark.read.schema(StructType([*schema.fields, StructField(SLOT, IntegerType())])).parquet(path)


def read_units(stored: DataFrame, units: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of ``units`` (column ``unit_id``) of a table read from a store, without its slot column.

    The driver sees at most ``slots`` numbers and the range of the units; they prune folders and row groups.
    """
    named = units.select(F.col("unit_id").cast("bigint").alias("unit_id"))
    found = named.groupBy(slot_of(F.col("unit_id"), slots).alias(SLOT)).agg(F.min("unit_id").alias("low"), F.max("unit_id").alias("high"))
    wanted = found.collect()
    if not wanted:
        return stored.drop(SLOT).limit(0)
    low, high = (f(r[c] for r in wanted if r[c] is not None) for f, c in ((min, "low"), (max, "high")))
    near = stored.where(F.col(SLOT).isin([r[SLOT] for r in wanted]) & F.col("unit_id").between(low, high))
    return near.join(named, "unit_id", "left_semi").drop(SLOT).select(*[c for c in stored.columns if c != SLOT])
