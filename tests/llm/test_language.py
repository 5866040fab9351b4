"""Language models against sums over listed segmentations, and by held-out accuracy."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pagemill.llm import catalog
from pagemill.llm.language_id import Lattice, Model, Pieces, Scorer, fit, identify, maximise, word_scores


@pytest.fixture(scope="module")
def pieces():
    with open(catalog.PIECES, "rb") as f:
        return Pieces(f.read())


def segmentations(word, number):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in number:
            for rest in segmentations(word[n:], number):
                yield [number[word[:n]], *rest]


WORDS = [" the".encode(), " Straße".encode(), b" x", b"ing", b" \xff\xfe", " 東京".encode(), b" 12345"]


def test_sums_over_all_segmentations(pieces):
    number = {p: k for k, p in enumerate(pieces.pieces)}
    rng = np.random.default_rng(1)
    p = rng.random((len(number), 3)) / len(number)
    got = word_scores(pieces, Model(["a", "b", "c"], np.ones(3) / 3, p), WORDS)
    lang, times = np.array([0, 1, 2, 0, 1, 2, 0]), np.arange(1.0, 8.0)
    use = Lattice(pieces, WORDS).expected(p, lang, times)
    expected = np.zeros_like(p)
    for k, w in enumerate(WORDS):
        cuts = list(segmentations(w, number))
        weights = np.array([np.prod(p[c], axis=0) for c in cuts])
        assert np.allclose(got[k], np.log(weights.sum(axis=0)))
        for c, share in zip(cuts, weights[:, lang[k]] / weights[:, lang[k]].sum()):
            np.add.at(expected, (c, lang[k]), share * times[k])
    assert np.allclose(use, expected)
    assert np.allclose(maximise(use).sum(axis=0), 1)


def test_long_words_are_scored_whole(pieces):
    p = np.full((len(pieces.pieces), 2), [1e-5, 2e-5])
    text = "ab" * 20_000
    names, sure = Scorer(pieces, Model(["a", "b"], np.ones(2) / 2, p)).predict([text, None, "12 + !", "z"])
    assert names[:3] == ["b", "und", "und"] and sure[0] == 1 and sure[1:3] == [0, 0] and names[3] == "b"
    one, two = word_scores(pieces, Model(["a", "b"], np.ones(2) / 2, p), [b"ab" * 500, b"ab" * 1000])
    assert np.isfinite(two).all() and np.allclose(two / one, 2, rtol=0.01)


def test_cases(spark, documents):
    rng = random.Random(1)
    prose = {"en": "the of and with house river", "de": "der und mit haus fluss nicht", "": "le la avec maison rivière"}
    rows = [(i, " ".join(rng.choices(prose[la].split(), k=12)), la, "s") for i, la in enumerate(list(prose) * 20)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "123 ...", "de", "s"), (103, "der fluss nicht", None, "s")]
    rows += [(104, "the river " * 20_000, None, "s"), (105, "a" * 50_000, None, "s"), (3, rows[3][1], rows[3][2], "s"), (None, "the house of", "en", "s")]
    got = identify(documents(rows, "held_out"), catalog.PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    found = {r.doc_id: r.lang_pred for r in got}
    assert all(found[i] == la for i, _, la, _ in rows[:60])
    assert [found[i] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "de", "en"] and found[105] in prose
    assert identify(documents([]), catalog.PIECES).count() == 0
    unknown = identify(documents([(1, "words", None, "s"), (2, "more", None, "s")]), catalog.PIECES).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


def test_a_sample_of_the_documents_is_enough(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = identify(docs, catalog.PIECES, model=fit(docs, catalog.PIECES, fit_docs=40)).select("doc_id", "held_out", "lang_pred")
    rows = scored.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = catalog.QUERIES["op11_segment_unigrams"](spark, sf)
    assert got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert rows and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
