"""Near duplicates by BagMinHash over multisets of word runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import plain_names, slices, stored
from pagemill.llm.components import components
from pagemill.llm.rolling import BASE, WORDS, mix, weighted, word_shingles

SIMILARITY = 0.8
#: Registers and registers per band. Two texts of similarity 0.8 share a band with probability 1 - (1 - 0.8**5)**25 > 0.9999.
REGISTERS, BAND = 125, 5
#: Groups of a band up to this size compare all members of different classes; larger ones share runs first.
SMALL_GROUP = 16
#: Rounds in which members of large groups are compared with one more leader. They only join hot classes early; what is
#: compared in the end does not depend on them.
LEADERS = 2
#: Counters that order runs from rare to common.
COUNTERS = 1 << 20
#: Texts of a run that one task compares others with.
DEALT = 2048
NO_ID = -(2**63)


def signatures(texts: list[str], m: int = REGISTERS, k: int = WORDS) -> np.ndarray:
    """A BagMinHash signature per text: registers agree with the probability of the weighted Jaccard similarity.

    The weight of a run is its count. Levels of weight are cut into blocks (0,1], (1,2], (2,4], (4,8], ...; each run and
    block has a Poisson process with a point rate of the block's width. Points come in ascending order; the bits of a
    hash lead a point down the halves of its block to a single level, and it counts if the run is at least that heavy.
    A point falls on one register, which keeps its smallest point. Points beyond the time by which all
    registers of a text should be filled are not drawn; a text with a register still empty goes on to later points.
    Texts without words have all registers infinite.
    """
    doc, run, count = weighted(texts, k)
    n = len(texts)
    least = np.full(n * m, np.inf)
    weight = np.bincount(doc, weights=count, minlength=n)
    with np.errstate(divide="ignore"):
        limit = m / weight * (np.log(m) + 5)
    blocks = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    width = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0)).astype(np.int64)
    base = np.where(block == 0, 0, width)
    seed = mix(run[item] + block.astype(np.uint64) * BASE)
    while True:
        draw(least, m, seed, width, base, doc[item], count[item], limit)
        empty = np.isinf(least.reshape(n, m)).any(axis=1) & (weight > 0)
        if not empty.any():
            return least.reshape(n, m)
        limit = np.where(empty, limit * 2, 0)  # drawn again from the start; the others draw nothing


def draw(least, m, seed, width, base, doc, count, limit) -> None:
    """Points of all processes up to their text's limit, one step of all processes at a time."""
    at = np.zeros(len(seed))
    live = np.flatnonzero(limit[doc] > 0)
    step = 0
    while len(live):
        s = seed[live]
        gap = mix(s + np.uint64(2 * step + 1) * BASE)
        where = mix(s + np.uint64(2 * step + 2) * BASE)
        at[live] -= np.log1p(-(gap >> np.uint64(11)).astype(np.float64) / 2**53) / width[live]
        live_in = at[live] <= limit[doc[live]]
        live, where = live[live_in], where[live_in]
        level = base[live] + 1 + (where >> np.uint64(32)).astype(np.int64) % width[live]
        hit = level <= count[live]
        register = doc[live[hit]] * m + (where[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
        np.minimum.at(least, register, at[live[hit]])
        step += 1


def band_keys(least: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key per band of registers; the number of the band is part of it."""
    n, m = least.shape
    bits = least.view(np.uint64).reshape(n, m // band, band)
    key = np.arange(m // band, dtype=np.uint64)[None, :] * BASE
    key = np.repeat(key, n, axis=0)
    for j in range(band):
        key = mix(key + bits[:, :, j])
    return key.view(np.int64)


def overlap(a: list[str], b: list[str], k: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the pairs of texts: common runs over all runs, each as often as it occurs."""
    n = len(a)
    doc_a, run_a = word_shingles(a, k)
    doc_b, run_b = word_shingles(b, k)
    doc, run = np.concatenate([doc_a, doc_b]), np.concatenate([run_a, run_b])
    side = np.concatenate([np.zeros(len(doc_a), np.int64), np.ones(len(doc_b), np.int64)])
    order = np.lexsort((run, doc))
    doc, run, side = doc[order], run[order], side[order]
    if not len(doc):
        return np.ones(n)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])])
    group = np.cumsum(new) - 1
    in_b = np.bincount(group, weights=side)
    in_a = np.bincount(group) - in_b
    owner = doc[new]
    common = np.bincount(owner, weights=np.minimum(in_a, in_b), minlength=n)
    every = np.bincount(owner, weights=np.maximum(in_a, in_b), minlength=n)
    return np.where(every > 0, common / np.maximum(every, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts overlap enough; nothing above the joins needs the pairs of a text together."""
    one = texts.select(F.col("id_").alias("a"), F.col("text_").alias("text_a"))
    two = texts.select(F.col("id_").alias("b"), F.col("text_").alias("text_b"))

    def check(batches):
        for b in slices(batches, "text_a"):
            close = overlap(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()) >= similarity
            kept = b.filter(pa.array(close))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that chains of links of weighted Jaccard ``similarity`` or more connect.

    Equal texts are one class from the start and only the smallest identifier of each is compared further. Members of
    a band's group are compared with the smallest one of them; verified links give classes. Small groups that still hold
    several classes compare every two members of different classes. Members of large ones are compared if they share a run
    that any two texts of enough similarity must share (``prefix_pairs``), whatever other classes the group holds.
    No group is expanded into all its pairs, and none is cut.

    Returns one row per input row: ``doc_id, class_id, class_size, kept``; ``class_id`` is the smallest identifier of the
    class, whose row is kept. Null texts count as empty; texts without words are near only to equal texts. Rows that
    repeat an identifier are one document (all kept or none, counted each); a null identifier counts as smaller than others.
    An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")
    )

    def sign(batches):
        for b in slices(batches, "text_"):
            texts = b.column("text_").to_pylist()
            keys = band_keys(signatures(texts))
            digest = [hashlib.sha256(t.encode()).digest() for t in texts]
            words = [bool(t.split()) for t in texts]
            lists = [row if has else [] for row, has in zip(keys.tolist(), words)]
            arrays = [b.column("id_"), pa.array(digest, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id_", "digest_", "keys_"])

    signed = stored(base.mapInArrow(sign, "id_ bigint, digest_ binary, keys_ array<bigint>"))
    first = signed.groupBy("digest_").agg(F.min("id_").alias("first_"))
    member = stored(signed.select("id_", "digest_").join(first, "digest_").select("id_", "first_"))
    copies = member.filter("id_ <> first_").select(F.col("id_").alias("a"), F.col("first_").alias("b"))
    heads = signed.join(first.select(F.col("first_").alias("id_"), "digest_"), ["id_", "digest_"])
    rows = heads.select("id_", F.explode("keys_").alias("key_")).distinct()
    sizes = rows.groupBy("key_").agg(F.count(F.lit(1)).alias("n_"), F.min("id_").alias("lead_")).filter("n_ > 1")
    grouped = stored(rows.join(sizes, "key_"))
    pairs = grouped.filter("id_ <> lead_").select(F.col("id_").alias("a"), F.col("lead_").alias("b")).distinct()
    tested = stored(pairs)
    links = stored(verified(tested, base, similarity))
    # identifiers that repeat with several texts are joined by their copies
    classes = stored(components(links.union(copies)))
    for turn in range(1, LEADERS + 1):
        grouped, pairs = open_pairs(grouped, classes, tested, turn)
        if pairs.isEmpty():
            break
        new = stored(verified(pairs, base, similarity))
        classes, tested = joined_classes(classes, new), tested.union(pairs)
    large = open_large(grouped, classes)
    if not large.isEmpty():
        pairs = prefix_pairs(large.join(base, "id_"), similarity).join(tested, ["a", "b"], "left_anti")
        classes = joined_classes(classes, stored(verified(stored(pairs), base, similarity)))
    out = signed.select("id_").join(classes.select(F.col("node").alias("id_"), "class"), "id_", "left")
    out = out.select("id_", F.coalesce("class", "id_").alias("class_"))
    sizes = out.groupBy("class_").agg(F.count(F.lit(1)).alias("class_size"))
    return out.join(sizes, "class_").select(
        F.nullif("id_", F.lit(NO_ID)).alias("doc_id"),
        F.nullif("class_", F.lit(NO_ID)).alias("class_id"),
        "class_size",
        (F.col("id_") == F.col("class_")).alias("kept"),
    )


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after further links: only the classes that the links connect are looked at."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    fresh = ends.join(classes, "node", "left_anti").withColumn("class", F.col("node"))
    known = classes.unionByName(fresh)
    drawn = links
    for end in ("a", "b"):
        drawn = drawn.join(known.select(F.col("node").alias(end), F.col("class").alias(f"class_{end}")), end)
    step = components(drawn.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    step = step.select(F.col("node").alias("class"), F.col("class").alias("to"))
    return stored(known.join(step, "class", "left").select("node", F.coalesce("to", "class").alias("class")))


def open_pairs(grouped: DataFrame, classes: DataFrame, tested: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The groups that still hold several classes, and pairs of different classes that no round has compared yet.

    Pairs are all of small groups, and those of one more leader of large ones. Classes only ever grow together, so a group of one class needs no further look.
    """
    named = grouped.join(classes.select(F.col("node").alias("id_"), "class"), "id_", "left")
    named = named.select("key_", "n_", "id_", F.coalesce("class", "id_").alias("class_"))
    leader = F.min(F.struct(F.xxhash64("id_", F.lit(turn)).alias("h"), F.col("id_").alias("b"), F.col("class_").alias("class_b")))
    mixed = named.groupBy("key_").agg(F.min("class_").alias("lo"), F.max("class_").alias("hi"), leader.alias("lead"))
    mixed = mixed.filter("lo <> hi").select("key_", "lead")
    rows = stored(named.join(mixed, "key_"))
    large = rows.filter(F.col("n_") > SMALL_GROUP).filter("class_ <> lead.class_b").select("id_", F.col("lead.b").alias("b"))
    small = rows.filter(F.col("n_") <= SMALL_GROUP)
    other = small.select("key_", F.col("id_").alias("b"), F.col("class_").alias("class_b"))
    small = small.join(other, "key_").filter("class_ < class_b").select("id_", "b")
    pairs = large.union(small).select(F.greatest("id_", "b").alias("a"), F.least("id_", "b").alias("b")).distinct()
    return rows.select("key_", "n_", "id_"), stored(pairs.join(tested, ["a", "b"], "left_anti"))


def open_large(grouped: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (``id_, class_``) of the large groups that still hold several classes."""
    named = grouped.filter(F.col("n_") > SMALL_GROUP).join(classes.select(F.col("node").alias("id_"), "class"), "id_", "left")
    named = named.select("key_", "id_", F.coalesce("class", "id_").alias("class_"))
    mixed = named.groupBy("key_").agg(F.min("class_").alias("lo"), F.max("class_").alias("hi")).filter("lo <> hi").select("key_")
    return stored(named.join(mixed, "key_", "left_semi").select("id_", "class_").distinct())


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each run with its number among the equal runs of the text, so that multisets become sets."""
    doc, run, count = weighted(texts)
    item = np.repeat(np.arange(len(doc)), count)
    turn = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    return doc[item], mix(run[item] + turn.astype(np.uint64) * BASE)


def prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (``a``, ``b``) of ``id_, class_, text_`` of different classes, among them all of at least ``similarity``.

    The runs of all texts have one order, from rare to common by counters that runs share. Texts of sizes n and m and the
    similarity t have t / (1 + t) * (n + m) runs in common, so the first common run has at least as many runs of
    each text from it on. Rows are the runs that can be such; of a run's texts, those outside its commonest class are
    compared with all of other classes.
    """
    spark = texts.sparkSession

    def count(batches):
        for b in slices(batches, "text_"):
            _, element = elements(b.column("text_").to_pylist())
            slot, n = np.unique(element % np.uint64(COUNTERS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot_", "n_"])

    counted = texts.select("text_").mapInArrow(count, "slot_ int, n_ bigint").groupBy("slot_").agg(F.sum("n_").alias("n_")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[counted["slot_"].to_numpy()] = counted["n_"].to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def cut(batches):
        for b in slices(batches, "text_"):
            doc, element = elements(b.column("text_").to_pylist())
            order = np.lexsort((element, shared.value[element % np.uint64(COUNTERS)], doc))
            doc, element = doc[order], element[order]
            size = np.bincount(doc, minlength=b.num_rows)
            rest = size[doc] - (np.arange(len(doc)) - (np.cumsum(size) - size)[doc])
            first = rest >= similarity * size[doc] - 1e-6
            doc = doc[first]
            arrays = [b.column("id_").take(pa.array(doc)), b.column("class_").take(pa.array(doc))]
            arrays += [pa.array(element[first].view(np.int64)), pa.array(rest[first]), pa.array(size[doc])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id_", "class_", "run_", "rest_", "size_"])

    rows = stored(texts.select("id_", "class_", "text_").mapInArrow(cut, "id_ bigint, class_ bigint, run_ bigint, rest_ bigint, size_ bigint"))
    per = rows.groupBy("run_", "class_").agg(F.count(F.lit(1)).alias("n_")).groupBy("run_")
    per = per.agg(F.max(F.struct("n_", "class_")).alias("most"), F.sum("n_").alias("n_"), F.count(F.lit(1)).alias("classes_"))
    parts = F.ceil(F.col("n_") / DEALT).cast("int").alias("parts_")
    mixed = per.filter("classes_ > 1").select("run_", F.col("most.class_").alias("most_"), parts)
    rows = stored(rows.join(mixed, "run_"))
    one = rows.filter("class_ <> most_").select("run_", F.explode(F.expr("sequence(0, parts_ - 1)")).alias("part_"), *named_ends("x"))
    two = rows.select("run_", F.expr("cast(pmod(xxhash64(id_), parts_) as int)").alias("part_"), *named_ends("y"))
    need = similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - 1e-6
    near = (F.col("class_x") != F.col("class_y")) & (F.least("rest_x", "rest_y") >= need)
    pairs = one.join(two, ["run_", "part_"]).filter(near)
    return pairs.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()


def named_ends(end: str) -> list:
    return [F.col(f"{c}_").alias(f"{c}_{end}") for c in ("id", "class", "rest", "size")]


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose document is kept.

    Null texts count as empty ones and are near to each other only; a null identifier is smaller than others; rows that
    repeat an identifier are all kept or none. An empty table gives no rows.
    """
    own, (id_, text) = plain_names(docs, id_col, text_col)
    kept = near_duplicates(own, id_col=id_, text_col=text, **options).filter("kept").select(F.col("doc_id").alias("kept_id_")).distinct()
    return own.join(kept, own[id_].cast("bigint").eqNullSafe(F.col("kept_id_")), "left_semi").toDF(*docs.columns)
