"""Shards along a Hilbert curve through the metadata of documents."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ranked, shuffle_partitions, stored

#: Bits per dimension: each is cut into 2 ** BITS cells at quantiles.
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of the rows of ``cells`` (n x dimensions, each in 0..2**bits-1).

    Gray-code form: undo the excess work of the inverse transform from the top bit down, Gray-encode
    over the dimensions, then interleave the bits.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def value_cuts(rows: DataFrame, column: str, cells: int) -> list[bytes]:
    """At most ``cells - 1`` values of a binary column, in order, that part its rows into runs as even as its values allow.

    Values are compared whole. They are counted, range-partitioned and summed up in order; a number per partition and the
    values at which a further share of the rows is full are all that reaches the driver.
    """
    spark = rows.sparkSession

    def sums(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = total + np.cumsum(b.column("n").to_numpy())
            total = int(upto[-1]) if len(upto) else total
            arrays = [b.column("value"), b.column("n"), pa.array(upto), pa.array(np.full(b.num_rows, part, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["value", "n", "upto", "part"])

    counted = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(shuffle_partitions(spark), "value").sortWithinPartitions("value")
    summed = stored(dealt.mapInArrow(sums, "value binary, n bigint, upto bigint, part int"))
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in summed.groupBy("part").agg(F.max("upto")).collect()):
        before.append((part, total))
        total += n
    if not total:
        return []
    shifted = summed.join(F.broadcast(spark.createDataFrame(before, "part int, before bigint")), "part")
    full = shifted.filter(F.expr(f"(before + upto) * {cells} div {total} > (before + upto - n) * {cells} div {total}"))
    return sorted(bytes(r.value) for r in full.select("value").collect())[: cells - 1]


def hilbert_shards(
    df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS
) -> DataFrame:
    """Order documents along a Hilbert curve over (lang, source, size) and cut the order into even runs.

    Each dimension is quantised at its quantiles over all rows (see :func:`value_cuts` for strings; approximate
    percentiles for sizes): ``2**bits - 1`` values each are all that reaches the driver. Rows of one cell follow each other by identifier, so a
    source with a third of all rows spreads over a third of the shards. Law ``rows``: with n documents, shard s holds
    ranks ``ceil(s*n/n_shards)`` to ``ceil((s+1)*n/n_shards) - 1``; counts differ by one at most.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``. Null texts count as empty, null
    metadata lies in the first cell, missing metadata columns count as null, ties go by identifier, checksum and size. Rows
    that are equal in all of these are interchangeable. With fewer documents than shards some shards stay empty, an empty table gives no rows; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    named = {c: (F.col(c) if c in df.columns else F.lit(None)).cast("string") for c in ("lang", "source")}
    rows = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        named["lang"].cast("binary").alias("d0_"),
        named["source"].cast("binary").alias("d1_"),
    )
    steps = [k / 2**bits for k in range(1, 2**bits)]
    sizes = np.unique(np.array(rows.agg(F.percentile_approx("size", steps, 1000)).first()[0] or [], dtype=np.int64))
    bounds = {d: value_cuts(rows, d, 2**bits) for d in ("d0_", "d1_")}

    def place(batches):
        for b in batches:
            cells = [np.searchsorted(sizes, b.column("size").to_numpy(), side="left")]
            for d, cuts in bounds.items():
                values = b.column(d).to_pylist()
                cell = {v: 0 if v is None else bisect_left(cuts, v) for v in set(values)}
                cells.append(np.array([cell[v] for v in values], np.int64))
            curve = hilbert_index(np.stack([cells[1], cells[2], cells[0]], axis=1), bits)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(curve)], names=["doc_id", "size", "text_crc32", "curve"])

    placed = rows.mapInArrow(place, "doc_id bigint, size bigint, text_crc32 bigint, curve bigint")
    numbered, total = ranked(placed, ["curve", "doc_id", "text_crc32", "size"])
    shard = F.expr(f"cast(rank_ * {n_shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}) div {n_shards}")
    return numbered.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank_") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents as one folder per shard, each sorted along the curve."""
    at = placed.select(F.col("doc_id").alias("shard_doc_"), "shard", "slot")
    joined = docs.join(at, docs[id_col] == at["shard_doc_"]).drop("shard_doc_")
    n = placed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    out = joined.repartitionByRange(int(n), "shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
