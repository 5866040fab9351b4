"""Removal of repeated strings against brute force over all strings."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from pagemill.llm import catalog, suffix_dedup
from pagemill.llm.suffix_dedup import Suffixes, anchors, kept_bytes, merge_spans, remove_repeats, suffix_digests

SF = "/root/testdata/sf0.001"


def brute(rows, length=50):
    """Digests and kept texts by looking at every string of every document."""
    texts = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(texts):
        t = texts[i]
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out, kept = {}, {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (i, len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest())
        kept[i] = rest
    return out, kept


def sample():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(12) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts += [p[cut : cut + rng.randint(30, 90)], text(rng.randint(0, 6))]
        rows.append((i * 2, "".join(parts)))
    rows += [(500 + k, rows[k][1]) for k in range(12)]
    rows += [(600, None), (601, ""), (602, "short"), (603, "ab" * 4_000), (604, "x" + "ab" * 3_000), (605, "c" * 49), (606, "c" * 50), (607, "c" * 51)]
    base = text(40)
    rows += [(700 + k, base[:k] + "#" + base[k + 1 :]) for k in range(0, len(base), 5)]
    return rows


@pytest.mark.parametrize("gathered", [500_000, 50])
def test_against_brute_force(documents, monkeypatch, gathered):
    monkeypatch.setattr(suffix_dedup, "GATHERED", gathered)
    monkeypatch.setattr(suffix_dedup, "SORTED", 3_000)
    rows = sample()
    df = documents([(i, t, "en", "s") for i, t in rows], "spans_").repartition(5)
    expected, kept = brute(rows)
    assert {r.doc_id: tuple(r) for r in suffix_digests(df).collect()} == expected
    if gathered == 50:
        cut = remove_repeats(df)
        assert cut.schema == df.schema
        got = {r.doc_id: r.text for r in cut.collect()}
        texts = dict(rows)
        assert got == {i: kept[i].decode("utf-8", "ignore") if expected[i][2] else texts[i] for i in texts}


def test_empty_and_repeated_rows(documents):
    assert suffix_digests(documents([])).count() == 0
    t = "some words that are repeated whole in every row of this table, and long"
    got = suffix_digests(documents([(1, t, "en", "s")] * 2 + [(None, t, "en", "s"), (2, t, "en", "s")])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", len(t)), ("1", len(t)), ("2", len(t)), ("None", 0)]


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(1)
    flat = rng.integers(97, 99, 4_000).astype(np.uint8)
    at = np.sort(rng.choice(3_900, 700, replace=False))
    segment = np.sort(rng.integers(0, 9, 700))
    for length in (60, 5):
        order, joined = Suffixes(flat, at, length).sort(segment)
        data = flat.tobytes()
        text = [(int(segment[k]), data[at[k] : at[k] + length]) for k in range(700)]
        assert [text[k] for k in order] == sorted(set(text))
        assert all(text[k] == text[j] for k, j in enumerate(joined)) and set(joined.tolist()) == set(order.tolist())


def test_anchors_depend_on_bytes_alone():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 100, 300).astype(np.uint8)
    found = []
    for before in (0, 13, 77):
        flat = np.concatenate([rng.integers(97, 123, before).astype(np.uint8), shared])
        at, _, _ = anchors(flat, np.array([len(flat)]), 50, 24)
        inside = at[(at >= before + 26) & (at < before + 250)] - before
        found.append(inside.tolist())
        assert np.diff(at).max() <= 27
    assert found[0] == found[1] == found[2]
    assert merge_spans(np.array([[1, 5, 9], [1, 0, 5], [1, 20, 30], [0, 1, 2]])).tolist() == [[0, 1, 2], [1, 0, 9], [1, 20, 30]]
    assert kept_bytes(b"abcdef", [np.array([1, 3, 5, 99], "<i8").tobytes()]) == (b"ade", 3, 2)


def test_query_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = catalog.QUERIES["op3_suffix_sort"](spark, SF).collect()
    assert {r.doc_id: tuple(r) for r in got} == brute(docs)[0]


def surroundings(n, seed=3):
    """One gram with ``n`` surroundings that differ, parts of which are shared."""
    rng = np.random.default_rng(seed)
    gram, length = 24, 50
    before, after = (rng.integers(97, 123, (n, 26), dtype=np.uint8) for _ in range(2))
    for k in range(0, n - 1, 7):  # the end of what is before it, and the start of what is after it
        cut = int(rng.integers(0, 27))
        before[k + 1, cut:], after[k + 1, : 27 - cut] = before[k, cut:], after[k, : 27 - cut]
    rows = np.hstack([before, np.full((n, gram), ord("#"), np.uint8), after])
    full = np.full(n, 26, np.int64)
    doc = rng.permutation(n).astype(np.int64)
    zero = np.zeros(n, np.uint64)
    return suffix_dedup.Contexts(zero, np.arange(n).astype(np.uint64), doc, np.full(n, 100), full, full + gram, rows)


def test_one_anchor_with_many_surroundings(monkeypatch):
    for n, at_once in ((400, 900), (400, 400_000), (60_000, 400_000)):
        monkeypatch.setattr(suffix_dedup, "SORTED", at_once)
        c = surroundings(n)
        found = [s for part in suffix_dedup.compare(c, 50, 24) for s in part.tolist()]
        first, expected = {}, set()
        order = np.argsort(c.doc)
        for k in order:
            raw = c.rows[k].tobytes()
            for offset in range(27):
                if first.setdefault((offset, raw[26 - offset : 76 - offset]), c.doc[k]) != c.doc[k]:
                    expected.add((int(c.doc[k]), 100 - offset, 150 - offset))
        assert set(map(tuple, found)) == expected and expected
    # one string that all of them have
    c.rows[:] = c.rows[0]
    monkeypatch.setattr(suffix_dedup, "SORTED", 4_000)
    found = np.concatenate(list(suffix_dedup.compare(c, 50, 24)))
    assert len(np.unique(found[:, 0])) == 59_999 and found[:, 0].min() == 1


def test_surroundings_are_held_once():
    n, width = 40_000, 76
    c = surroundings(n)
    blobs = [c.take(np.arange(k, k + 4_000)).pack() for k in range(0, n, 4_000)]
    suffix_dedup.PrefixHash(np.zeros(2_000_000, np.uint8))  # its powers are kept
    tracemalloc.start()
    try:
        got = suffix_dedup.Contexts.unpack(blobs, width, 24)
        tracemalloc.reset_peak()
        left, spans = suffix_dedup.settle(got)
        assert tracemalloc.get_traced_memory()[1] < 2.1 * n * (width + 48)  # 2.3 times with a copy of all rows that stay
    finally:
        tracemalloc.stop()
    first = {}
    for k in np.argsort(c.doc):
        first.setdefault(c.rows[k].tobytes(), k)
    stays = np.sort(list(first.values()))
    assert 0 < len(spans) == n - len(stays)
    for f in ("doc", "place", "left", "right", "rows"):
        assert np.array_equal(getattr(left, f), getattr(c, f)[stays])
