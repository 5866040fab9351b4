"""Document fingerprints by winnowing, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import shuffle_partitions, stored

#: Words of a gram, and grams of a window: a run of GRAM + WINDOW - 1 words shared by two texts is always noticed.
GRAM, WINDOW = 3, 6
#: Order of a null identifier: before any other.
NO_ID = -(2**63)


def with_fingerprint(df: DataFrame, text_col: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out``, an array of ints: the chosen gram hashes, then as many positions.

    Words are what single spaces separate; each is hashed once and a gram hash combines the hashes of its words. Of
    each window of grams the smallest hash is chosen, the rightmost one on ties. Chosen positions never
    fall, so dropping those equal to the one before leaves each once. A text of fewer than ``gram`` words has
    one gram, its whole text; with fewer grams than a window there is one window.
    """
    following = ", ".join(f"words_[i + {k}]" for k in range(1, gram))
    steps = {
        "words_": f"transform(split({text_col}, ' '), w -> xxhash64(w))",
        "grams_": f"""if(size(words_) < {gram}, array(named_struct('h', hash({text_col}), 'p', 0)),
            transform(slice(words_, 1, greatest(size(words_) - {gram - 1}, 1)), (w, i) -> named_struct('h', hash(w, {following}), 'p', -i)))""",
        "least_": f"transform(sequence(1, greatest(size(grams_) - {window - 1}, 1)), j -> array_min(slice(grams_, j, {window})))",
        "chosen_": "filter(least_, (x, i) -> i = 0 or x.p != least_[greatest(i - 1, 0)].p)",
    }
    for name, sql in steps.items():
        df = df.withColumn(name, F.expr(sql))
    both = "concat(transform(chosen_, x -> x.h), transform(chosen_, x -> -x.p))"
    return df.withColumn(out, F.expr(both)).drop(*steps)


def hashes(fingerprint: str) -> Column:
    return F.expr(f"slice({fingerprint}, 1, size({fingerprint}) div 2)")


def as_text(fingerprint: str) -> Column:
    """``hash@position`` of each chosen gram, in order; hashes in hexadecimal."""
    return F.expr(
        f"""array_join(transform(sequence(1, size({fingerprint}) div 2), k ->
            concat(hex({fingerprint}[k - 1] & 4294967295L), '@', {fingerprint}[size({fingerprint}) div 2 + k - 1])), ' ')"""
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes, taken as sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def previous_rows(keys: DataFrame) -> DataFrame:
    """For each distinct (``id_``, ``tie_``) the one before it in ascending order, the last one for the first.

    Range partitions are the chunks of the order: a window inside each chunk, and one over the last rows of the
    chunks, at most one per partition.
    """
    parts = shuffle_partitions(keys.sparkSession)
    dealt = keys.repartitionByRange(parts, "id_", "tie_").withColumn("chunk_", F.spark_partition_id())
    rows = stored(dealt)
    here = F.struct("id_", "tie_", "n_chars")
    ends = rows.groupBy("chunk_").agg(F.max(here).alias("end_"))
    across = Window.orderBy("chunk_")
    every = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("chunk_", F.coalesce(F.lag("end_").over(across), F.last("end_").over(every)).alias("before_"))
    inside = F.lag(here).over(Window.partitionBy("chunk_").orderBy("id_", "tie_"))
    found = rows.withColumn("inside_", inside).join(F.broadcast(ends), "chunk_")
    return found.select("id_", "tie_", F.coalesce("inside_", "before_").alias("to_"))


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text and compare them with each other and with the next document.

    The edited text has its last quarter of code points replaced by the first as many of the next document in
    ascending identifier (after the last: the first). A document sends that beginning and its hashes to the one
    before it; whole texts are shuffled once, by identifier.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts
    count as empty. Rows repeated with identifier and text stand at one place in the order; equal identifiers with
    different texts go by a hash of the text, a null identifier comes first. One document alone follows itself. An empty
    table gives no rows; other columns are ignored.
    """
    # an identifier and a hash of the text name a row in every branch of the plan
    docs = df.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text_"),
    ).withColumn("tie_", F.xxhash64("text_"))
    keys = docs.select("id_", "tie_", F.char_length("text_").alias("n_chars")).distinct()
    base = with_fingerprint(docs, "text_", "print_")
    sent = (
        base.join(previous_rows(keys), ["id_", "tie_"])
        .select(
            F.col("to_.id_").alias("id_"),
            F.col("to_.tie_").alias("tie_"),
            F.expr("left(text_, cast(floor(to_.n_chars / 4) as int))").alias("begin_"),
            hashes("print_").alias("next_"),
        )
        .groupBy("id_", "tie_")
        .agg(F.first("begin_").alias("begin_"), F.first("next_").alias("next_"))
    )
    n = F.char_length("text_")
    joined = base.join(sent, ["id_", "tie_"]).select(
        F.nullif("id_", F.lit(NO_ID)).alias("doc_id"),
        n.cast("bigint").alias("n_chars"),
        "print_",
        "next_",
        F.expr("concat(left(text_, char_length(text_) - cast(floor(char_length(text_) / 4) as int)), begin_)").alias("edited_"),
    )
    out = with_fingerprint(joined, "edited_", "edited_print_")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_").cast("binary"), 256).alias("edited_sha256"),
        as_text("print_").alias("fingerprint"),
        as_text("edited_print_").alias("edited_fingerprint"),
        likeness(hashes("print_"), hashes("edited_print_")).alias("near_edited"),
        likeness(hashes("print_"), F.col("next_")).alias("near_next"),
    )
