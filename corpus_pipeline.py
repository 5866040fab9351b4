"""The training-data pipeline: quality, recurring lines, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bagminhash, line_templates, packing, quality, suffix_dedup
from pagemill.llm.catalog import TOKENIZER
from pagemill.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject as bad or toxic, all columns as they are.

    Null texts are judged as empty ones. Without labels of both classes of a target nothing is rejected for it (all, where
    all labels say bad). Repeated rows are judged alike; ties do not occur; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of templates that recur across documents; every row and column stays.

    Null and empty texts stay as they are; a text of recurring lines alone is not its own and stays whole. Repeated rows are
    cut alike and count once; an empty table stays empty.
    """
    return line_templates.cut_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest identifier; columns as they are.

    Null texts count as empty, and empty texts are one group; a null identifier is the smallest. Rows that repeat the
    identifier that stays are all kept; an empty table stays empty.
    """
    return bagminhash.drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller identifier has too; every row and column stays.

    Null texts stay null, empty and short ones as they are. All rows of an identifier count as one document; a null
    identifier is the smallest; an empty table stays empty.
    """
    return suffix_dedup.remove_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a training sequence; other columns than identifier and text are left out.

    Null and empty texts are a piece of one token. Repeated rows are packed one by one; pieces equal in length, identifier,
    number and checksum are interchangeable; an empty table gives no pieces.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]
#: The classifier, the signatures and the tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
