from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with nulls, empties, ties, copies and a clashing extra column."""

    def make(rows, extra="rank_"):
        data = [(i, t, lang, src, None if t is None else len(t), "x") for i, t, lang, src in rows]
        return spark.createDataFrame(data, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra} string")

    return make
