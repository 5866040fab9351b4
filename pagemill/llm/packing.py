"""Best-two-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bpe import Vocabulary, byte_symbols, encode_documents
from pagemill.llm.common import ranked, stored

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 0


def little_endian(v: Vocabulary):
    return lambda ids: struct.pack(f"<{len(ids)}I", *ids)


def library_merges(source: bytes):
    """Ids of one word by the tokenizers library; packing needs no lexicon of its own."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(source.decode()).model
    symbols = dict(enumerate(byte_symbols()))

    def merge(word: str) -> tuple[int, ...]:
        return tuple([t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(symbols))])

    return merge


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, length: int, separator: int) -> DataFrame:
    """Tokenise each document, end it with the separator and cut what is longer than ``length``."""
    end = int(separator).to_bytes(4, "little")
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))

    def emit(b, encoded):
        doc, piece, start, size, crc = [], [], [], [], []
        for i, chunks in zip(b.column("doc_id").to_pylist(), encoded):
            data = b"".join(chunks) + end
            for k, at in enumerate(range(0, len(data), 4 * length)):
                part = data[at : at + 4 * length]
                doc.append(i)
                piece.append(k)
                start.append(at // 4)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, piece, start, size, crc), kinds)], names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return encode_documents(docs, path, emit, little_endian, b"".join, schema, None, "text_", library_merges)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for ``counts[length]`` documents of each length: ``[([(length, times), ...], bins), ...]``.

    A bin is filled greedily with the longest document that fits. If it leaves a gap, its smallest document is
    taken out and the two documents still unpacked that fit the expanded gap most tightly go in, if they fill more.
    The same bin is then repeated as long as the counts allow, so the work depends on the lengths that
    occur (``capacity`` at most), not on the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    bins = []
    while left.any():
        used: dict[int, int] = {}
        gap = capacity
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            fits = fits[left[fits] > np.array([used.get(int(f), 0) for f in fits])]
            if not len(fits):
                break
            longest = int(fits[-1])
            times = min(gap // longest, int(left[longest]) - used.get(longest, 0))
            used[longest] = used.get(longest, 0) + times
            gap -= times * longest
        if gap and used:
            smallest = min(used)
            rest = left.copy()
            for length, n in used.items():
                rest[length] -= n
            room = gap + smallest
            pair = tightest_pair(rest, room)
            if pair and sum(pair) > smallest:
                used[smallest] -= 1
                if not used[smallest]:
                    del used[smallest]
                for length in pair:
                    used[length] = used.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        bins.append((sorted(used.items(), reverse=True), times))
    return bins


def tightest_pair(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two lengths with documents left whose sum comes closest to ``room`` from below; the larger first one on ties."""
    lengths = np.flatnonzero(left[: room + 1])
    if not len(lengths):
        return None
    last = np.zeros(room + 1, np.int64)  # the longest length up to each size
    last[lengths] = lengths
    last = np.maximum.accumulate(last)
    first = lengths[lengths < room]
    second = last[room - first]
    same = (second == first) & (left[first] < 2)
    second = np.where(same, last[np.maximum(first - 1, 0)], second)
    ok = second > 0
    if not ok.any():
        return None
    first, second = first[ok], second[ok]
    best = np.lexsort((first, first + second))[-1]
    return int(first[best]), int(second[best])


def pack(
    df: DataFrame,
    path: str,
    length: int = SEQUENCE_TOKENS,
    separator: int = SEPARATOR_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    Only the number of pieces of each length (``length`` numbers at most) reaches the driver, which plans bins from
    it; pieces then take their place by their rank within their length, found without a task that
    sees all of them. Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one separator long. Repeated rows are packed one by one; pieces equal in
    length, identifier, number and checksum are interchangeable. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    cut = stored(pieces(df, path, id_col, text_col, length, separator))
    counts = dict(sorted((r.length, r.n) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()))
    bins = best_two_fit(counts, length)
    begin, runs, sequence = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist())), [], 0
    for items, times in bins:
        at = 0
        for size, n in items:
            runs.append((begin[size], n, sequence, at, size))  # from this rank on: n pieces in each of the bins
            begin[size] += n * times
            at += n * size
        sequence += times
    runs.sort()
    plan = np.array(runs, np.int64).reshape(-1, 5)
    numbered, _ = ranked(cut, ["length", "doc_id", "piece", "ids_crc32"])
    shared = spark.sparkContext.broadcast(plan)

    def place(batches):
        p = shared.value
        for b in batches:
            rank = b.column("rank_").to_numpy()
            run = p[np.searchsorted(p[:, 0], rank, side="right") - 1]
            bin_, inside = np.divmod(rank - run[:, 0], run[:, 1])
            arrays = [pa.array(run[:, 2] + bin_), pa.array(run[:, 3] + inside * run[:, 4])]
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return numbered.mapInArrow(place, schema)
