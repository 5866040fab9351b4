"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored


def ordered(node: Column, turn: int) -> Column:
    """A node with its place in the order of a round: by identifier in even rounds, random in odd ones."""
    return F.struct((node if turn % 2 == 0 else F.xxhash64(node)).alias("h"), node.alias("n"))


def components(links: DataFrame) -> DataFrame:
    """``node, class``: the smallest node that links (``a``, ``b``) connect each node with.

    In each round a node merges with its first neighbour and links are redrawn between what has merged. Stars around
    their smallest node, the usual case, are done in one round; the random order of every other round shrinks chains
    of any length by a constant share. Each round is written to the shared folder; the driver sees only whether links
    are left. Minima are taken per task before any shuffle.
    """
    links = stored(links.filter("a <> b").select("a", "b").distinct())
    known = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("label", F.col("node"))
    rounds = 0
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        first = both.groupBy("a").agg(F.min(ordered(F.col("b"), rounds)).alias("m"))
        step = stored(first.select("a", F.least(F.col("m"), ordered(F.col("a"), rounds))["n"].alias("to")))
        moved = (
            links.join(step, "a")
            .select(F.col("to").alias("x"), F.col("b").alias("a"))
            .join(step, "a")
            .filter("x <> to")
            .select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b"))
            .distinct()
        )
        known = stored(
            known.join(step.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        )
        links = stored(moved)
        rounds += 1
    least = known.groupBy("label").agg(F.min("node").alias("class"))
    return known.join(least, "label").select("node", "class")
