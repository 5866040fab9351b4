"""The pipeline against plain versions of its stages, each judged on its own input."""

from __future__ import annotations

from test_lines import brute as brute_lines
from test_near import brute_classes
from test_suffix import brute as brute_suffix
from test_tokens import check_packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from pagemill.llm.catalog import TOKENIZER

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def check_stages(spark, docs, sf_dir):
    library = Tokenizer.from_file(TOKENIZER)
    stages = dict(corpus_pipeline.STAGES)
    own = docs.columns
    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    rows = texts(good)
    assert good.columns == own and set(rows) <= set(texts(docs))
    lines = stages["line dedup"](spark, good, sf_dir).cache()
    report, gone = brute_lines(rows)
    expected = {
        (i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) if t and report[i][2] else t) for i, t in rows
    }
    assert lines.columns == own and set(texts(lines)) == expected
    near = stages["MinHash near-dedup"](spark, lines, sf_dir).cache()
    classes = brute_classes(texts(lines))
    assert near.columns == own and set(texts(near)) == {(i, t) for i, t in texts(lines) if classes[i] == i}
    cut = stages["suffix-array dedup"](spark, near, sf_dir).cache()
    digests, kept = brute_suffix(texts(near))
    assert cut.columns == own
    assert dict(texts(cut)) == {i: kept[i].decode("utf-8", "ignore") if digests[i][2] else t for i, t in texts(near)}
    check_packing(library, texts(cut), stages["best-fit packing"](spark, cut, sf_dir).collect())
    return cut.count()


def test_stages_whole_table(spark):
    assert 100 < check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF) < 200


def test_stages_odd_rows(spark, documents):
    rows = [(i, f"Plain words about topic {'abcdefghij'[i % 10]} and some more of it {i}.", "en", "s") for i in range(12)]
    rows += [(50, None, None, None), (51, "", "en", "s"), (52, "é" * 60_000, "fr", "s"), (53, rows[0][1], "en", "s")]
    check_stages(spark, documents(rows, "gone_lines_").withColumn("text_", F.lit(1)).withColumn("keys_", F.lit("k")), SF)
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_run_is_the_stages_one_after_the_other(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    where = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(docs.select(where).collect()) == sorted(corpus_pipeline.run(spark, SF).select(where).collect())
