"""Audit of how five filters interact in every order, by sums of packed integers.

A document fails some of the five filters; that and its labels are its mask, one of 128. What the document does at each
of the 600 steps (120 orders of five filters) follows from the mask alone, so every mask stands for one integer whose
64-bit fields hold all those outcomes. The integers of a part are added up; the fields of the sum are the counts.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
#: What a step counts, each in a field of its own.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a field. A field holds a number of documents, so 64 bits never run over into the next one.
WIDTH = 8
#: Bits of a mask above those of the filters.
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
#: Thresholds of the filters: words; distinct words and capitals in hundredths; characters that count as junk.
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 3
CAPITALS, JUNK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def text_mask(text: str) -> int:
    """Bits of the filters A to D that ``text`` fails. Words are what the bytes 9 to 13 and 32 separate."""
    raw = text.encode()
    words = raw.split()
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_SHARE * len(words),
        100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_SHARE * len(text),
        len(raw) != len(raw.translate(None, JUNK)),
    )
    return sum(f << k for k, f in enumerate(fails))


def outcomes(mask: int, order: str, step: int) -> tuple[int, ...]:
    """``OUTCOMES`` of a document with ``mask`` at one step of one order."""
    fails = [mask >> FILTERS.index(f) & 1 for f in order]
    before, here = any(fails[: step - 1]), fails[step - 1]
    removed = int(here and not before)
    return (
        int(not before and not here),
        removed,
        int(here and before),
        int(here and sum(fails) == 1),
        removed if mask & GOOD else 0,
        removed if mask & TOXIC else 0,
    )


@cache
def packed(mask: int) -> int:
    """The integer that stands for ``mask``: a field per step and outcome, the first one lowest."""
    fields = (n for order, step in STEPS for n in outcomes(mask, order, step))
    return int.from_bytes(b"".join(n.to_bytes(WIDTH, "little") for n in fields), "little")


def unpack(total: int) -> list[tuple[int, ...]]:
    """The outcomes of all steps from a sum of packed integers."""
    n = len(OUTCOMES)
    raw = total.to_bytes(len(STEPS) * n * WIDTH, "little")
    flat = [int.from_bytes(raw[k : k + WIDTH], "little") for k in range(0, len(raw), WIDTH)]
    return [tuple(flat[k : k + n]) for k in range(0, len(flat), n)]


def report(part: str, counted: dict[int, int]) -> pa.RecordBatch:
    """All steps of a part from the number of its documents with each mask."""
    found = unpack(sum(n * packed(mask) for mask, n in counted.items()))
    share = dict.fromkeys(FILTERS, 0)
    for (order, step), counts in zip(STEPS, found):
        share[order[step - 1]] += counts[OUTCOMES.index("removed")]
    columns = {
        "part": pa.array([part] * len(STEPS), pa.string()),
        "filter_order": pa.array([order for order, _ in STEPS], pa.string()),
        "step": pa.array([step for _, step in STEPS], pa.int32()),
    }
    for name, values in zip(OUTCOMES, zip(*found)):
        columns[name] = pa.array(values, pa.int64())
    columns["shapley"] = pa.array([share[order[step - 1]] for order, step in STEPS], pa.int64())
    return pa.RecordBatch.from_pydict(columns)


def flag(labels: DataFrame, name: str) -> Column:
    return F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)) if name in labels.columns else F.lit(0)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document, ``part, mask``. Texts are read once; only digests, identifiers and bits are shuffled.

    The first document of a text is found by its smallest identifier per digest, summed up per task, and joined back by
    digest and identifier, so that a text with very many copies does not meet in one task.
    """

    def judge(batches):
        for b in slices(batches, "text_"):
            texts = [t or "" for t in b.column("text_").to_pylist()]
            digests = [hashlib.sha256(t.encode()).digest() for t in texts]
            bits = pa.array([text_mask(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id_"), b.column("part"), pa.array(digests, pa.binary()), bits], names=["id_", "part", "digest_", "bits_"]
            )

    part = F.coalesce(F.col(part_col), F.lit("")) if part_col in docs.columns else F.lit("")
    picked = docs.select(F.col(id_col).cast("bigint").alias("id_"), part.alias("part"), F.col(text_col).alias("text_"))
    rows = stored(picked.mapInArrow(judge, "id_ bigint, part string, digest_ binary, bits_ int"))
    first = rows.groupBy("digest_").agg(F.min("id_").alias("id_")).filter(F.col("id_").isNotNull())
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id_"))
    known = known.agg(flag(labels, "quality").alias("good_"), flag(labels, "toxic").alias("toxic_"))
    joined = rows.join(first.withColumn("first_", F.lit(True)), ["digest_", "id_"], "left").join(known, "id_", "left")
    copy = F.col("first_").isNull() & F.col("id_").isNotNull()
    mask = F.col("bits_") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    mask += F.coalesce("good_", F.lit(0)) * GOOD + F.coalesce("toxic_", F.lit(0)) * TOXIC
    return joined.select("part", mask.alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts of the 600 steps of every part: ``part, filter_order, step, kept, ..., shapley``.

    Null texts count as empty, null parts as the part ``''``, which an empty value shares. Of equal texts the rows with
    the smallest identifier are no copies, also when several rows share it; a row without identifier is never a copy.
    Labels may repeat: a document is good or toxic if one row says so; null labels say nothing. A table without the
    part column is one part. Other columns are ignored. An empty table has no parts and gives no rows.

    Documents are counted by part and mask in each task first, so a part that holds most rows reaches its task as at
    most 128 rows, whatever their number.
    """
    counted = masks(docs, labels, id_col, text_col, part_col).groupBy("part", "mask").agg(F.count("*").alias("n"))

    def total(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        return pa.Table.from_batches([report(part, dict(zip(table.column("mask").to_pylist(), table.column("n").to_pylist())))])

    longs = ", ".join(f"{name} bigint" for name in (*OUTCOMES, "shapley"))
    return counted.groupBy("part").applyInArrow(total, f"part string, filter_order string, step int, {longs}")
