"""Samples of a stated size against sorting all rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pagemill.operators import sampling


@pytest.mark.parametrize("n", [0, 1, 7, 500, 1999, 2000, 5000])
def test_sample_is_the_lowest_draws(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "SORTED", 3)  # several rounds of counting
    monkeypatch.setattr(sampling, "DIGITS", 1)
    ids = list(range(2000))
    df = spark.range(2000).repartition(7)
    got = sorted(r.id for r in sampling.sample_n(df, n, F.col("id"), seed=3).collect())
    assert got == sorted(sorted(ids, key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())[:n])


def test_equal_and_null_keys(spark):
    df = spark.createDataFrame([(None, k) for k in range(50)] + [(1, 50)], "key int, v int")
    for n in (1, 20, 50):
        assert sampling.sample_n(df, n, F.col("key")).count() == n
    assert sampling.sample_n(df.limit(0), 5, F.col("key")).count() == 0


def test_truncated_texts(spark):
    df = spark.createDataFrame([("  a b\tc\nd ",), ("a  b",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(sampling.truncate_tokens(F.col("t"), 3)).collect()] == ["a b c", "a  b", "", None]
