"""Signatures, overlaps, components and near-duplicate classes against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import bagminhash, catalog
from pagemill.llm.bagminhash import drop_near_duplicates, near_duplicates, overlap, signatures
from pagemill.llm.components import components

SF = "/root/testdata/sf0.001"


def bag(text, k=5):
    words = text.encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


def brute_classes(rows, similarity=0.8):
    """Smallest identifier that links of enough similarity connect each document with."""
    texts = {i: t or "" for i, t in rows}
    ids, parent = sorted(texts), {i: i for i in texts}
    bags = {i: bag(texts[i]) for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if texts[i] != texts[j]:
                n, m = sum(bags[i].values()), sum(bags[j].values())
                if not n or not m or min(n, m) < similarity * max(n, m) or not bags[i].keys() & bags[j].keys():
                    continue
                if sum((bags[i] & bags[j]).values()) < similarity * sum((bags[i] | bags[j]).values()):
                    continue
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in ids}


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(6)]
    a = " ".join(rng.choices(vocabulary, k=900))
    b = a[: len(a) * 2 // 3] + " x " + " ".join(rng.choices(vocabulary, k=200))
    heavy = "a b c d e " * 60
    for one, two in ((a, b), (heavy, "a b c d e " * 40 + "q r s t u v w"), (a, a)):
        s = signatures([one, two], 4000)
        assert np.mean(s[0] == s[1]) == pytest.approx(jaccard(one, two), abs=0.03)
        assert overlap([one, two], [two, one]).tolist() == pytest.approx([jaccard(one, two)] * 2)
    assert not np.isinf(signatures(["one", "a b c d e f g"])).any()
    assert np.isinf(signatures(["", " \n "])).all()


def edits(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def sample():
    rng = random.Random(11)
    rows = []
    for g in range(12):
        words = [f"v{rng.randrange(500)}" for _ in range(rng.randint(40, 200))]
        rows += [(len(rows) * 2 + k, edits(rng, words, rng.choice((0, 0, 1, 2, 3)))) for k in range(rng.randint(1, 7))]
    # a chain: neighbours are near, ends are not
    words = [f"c{k}" for k in range(300)]
    rows += [(5000 + k, " ".join(words[k * 8 : k * 8 + 200])) for k in range(10)]
    rows += [(6000, None), (6001, ""), (6002, " "), (6003, "a b"), (6004, "a b"), (6005, "a  b"), (6006, "z " * 50_000), (6007, "z " * 49_000)]
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("small", [16, 2])
def test_classes_against_brute_force(documents, monkeypatch, small):
    monkeypatch.setattr(bagminhash, "SMALL_GROUP", small)
    rows = sample()
    df = documents([(i, t, "en", "s") for i, t in rows], "class_")
    got = near_duplicates(df).collect()
    expected = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == expected
    sizes = Counter(expected.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    if small == 16:
        kept = drop_near_duplicates(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(expected.values())


def test_empty_and_repeated_rows(documents):
    assert near_duplicates(documents([])).count() == 0
    rows = [(1, "a b c d e f", "en", "s")] * 2 + [(None, "x y z", "en", "s"), (3, "a b c d e f", "en", "s")]
    got = near_duplicates(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in got) == [
        ("1", "1", 3, True), ("1", "1", 3, True), ("3", "1", 3, False), ("None", "None", 1, True)
    ]
    assert drop_near_duplicates(documents(rows)).count() == 3


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (2000, 2001)]
    got = {r.node: r["class"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)} | {2000: 2000, 2001: 2000}


def test_query_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = catalog.QUERIES["op10_bagminhash"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs)


def test_small_classes_beside_a_hot_one(documents):
    """Links between texts whose band groups are full of texts of other classes."""
    common = [f"c{k}" for k in range(264)]

    def text(*own):
        return " ".join([*common, *(f"{name}{k}" for name, n in own for k in range(n))])

    rows = [(k, text(("hot", 44), (f"h{k}_", 1))) for k in range(20)]
    rows += [(100 + k, text((f"s{k}_", 44))) for k in range(200)]
    rows += [(1000 + k, text((f"u{k}_", 24))) for k in range(2)]
    expected = brute_classes(rows)
    assert len(set(expected.values())) == 1 + 200 + 1
    got = near_duplicates(documents([(i, t, "en", "s") for i, t in rows])).collect()
    assert {r.doc_id: r.class_id for r in got} == expected
