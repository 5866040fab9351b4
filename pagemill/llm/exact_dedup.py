"""Exact duplicates by content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import shuffle_partitions, stored

#: Code points of a text that the splitters of the range partitioning see before its hash.
HEAD_CHARS = 16


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts by sorting contents; built-in functions only.

    Sampled splitters over (head of the text, hash, piece) range-partition the rows; inside a partition
    rows are sorted by whole text, so that equal texts are neighbours, and the window compares neighbours in
    full. A text with more copies than half a partition's share of rows is cut into pieces by a hash
    of the identifier; there are at most ``2 * partitions`` such texts, which bounds what is broadcast. Pieces meet
    again as one row each, keyed by SHA-256 of the text.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. The row with the
    largest identifier stays. Null texts count as empty. Of rows with equal text and equal identifier one is
    kept; a null identifier is smaller than any other. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    docs = docs.withColumn("hash_", F.xxhash64("text_"))
    share = max(1, docs.count() // (2 * parts))
    hot = (
        docs.groupBy("hash_")
        .agg(F.count(F.lit(1)).alias("n_"))
        .filter(F.col("n_") > share)
        .select("hash_", F.ceil(F.col("n_") / share).alias("pieces_"))
    )
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces_")), F.lit(0))
    dealt = (
        docs.join(F.broadcast(hot), "hash_", "left")
        .withColumn("piece_", piece)
        .withColumn("head_", F.substring("text_", 1, HEAD_CHARS))
        .repartitionByRange(parts, "head_", "hash_", "piece_")
    )
    equal = Window.partitionBy("head_", "hash_", "piece_", "text_")
    down = equal.orderBy(F.col("doc_id").desc_nulls_last())
    rows = stored(
        dealt.select(
            "doc_id",
            F.sha2(F.col("text_").cast("binary"), 256).alias("text_sha256"),
            "piece_",
            F.col("pieces_").isNotNull().alias("cut_"),
            F.first("doc_id").over(down).alias("top_"),
            F.row_number().over(down).alias("place_"),
            F.count(F.lit(1)).over(equal).alias("n_"),
        )
    )
    whole = (
        rows.filter("cut_")
        .groupBy("text_sha256", "piece_")
        .agg(F.max("top_").alias("top_"), F.max("n_").alias("n_"))
        .groupBy("text_sha256")
        .agg(F.max("top_").alias("whole_top_"), F.sum("n_").alias("whole_n_"))
        .withColumn("cut_", F.lit(True))
    )
    keep = F.when(F.col("cut_"), F.col("whole_top_")).otherwise(F.col("top_"))
    return rows.join(F.broadcast(whole), ["text_sha256", "cut_"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("whole_n_", "n_").cast("bigint").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("place_") == 1)).alias("kept"),
        "text_sha256",
    )
