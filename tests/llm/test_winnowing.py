"""Winnowing against its rule, written out per text."""

from __future__ import annotations

import hashlib
import random

import pytest

from pagemill.llm import catalog
from pagemill.llm.winnowing import GRAM, WINDOW, as_text, edit_fingerprints, with_fingerprint

SF = "/root/testdata/sf0.001"


def edited(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out[i] = t[: len(t) - q] + following[:q]
    return out


def check(rows, got):
    texts = {i: t or "" for i, t in rows}
    new = edited(rows)
    assert len(got) == len(rows)
    prints = {r.doc_id: {e.split("@")[0] for e in r.fingerprint.split(" ")} for r in got}
    order = sorted(texts)
    for r in got:
        after = order[(order.index(r.doc_id) + 1) % len(order)]
        mine, changed = prints[r.doc_id], {e.split("@")[0] for e in r.edited_fingerprint.split(" ")}
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(new[r.doc_id].encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(mine & changed) / len(mine | changed))
        assert r.near_next == pytest.approx(len(mine & prints[after]) / len(mine | prints[after]))
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_cases(spark, documents):
    rng = random.Random(2)
    words = [f"w{k}é" for k in range(40)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "a"), (503, "a b c d"), (504, "z " * 20_000), (505, rows[3][1]), (506, "日本" * 50)]
    df = documents([(i, t, "en", "s") for i, t in rows], "print_")
    check(rows, edit_fingerprints(df).collect())
    check([(7, "one text alone of some words")], edit_fingerprints(documents([(7, "one text alone of some words", "en", "s")])).collect())
    assert edit_fingerprints(documents([])).count() == 0


def test_repeated_rows(documents):
    rows = [(1, "a b c d e f g h", "en", "s")] * 2 + [(2, "x y z", "en", "s"), (None, "q", "en", "s"), (2, "other", "en", "s")]
    got = edit_fingerprints(documents(rows)).collect()
    assert len(got) == 5 and len({tuple(r) for r in got if r.doc_id == 1}) == 1


def test_windows_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=n)) for n in (1, 2, 3, 4, 8, 9, 60, 200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    grams = {}
    for r in with_fingerprint(df, "t", "f", GRAM, 1).select("t", "f").collect():
        half = len(r.f) // 2
        grams[r.t] = r.f[:half]
        assert r.f[half:] == list(range(half)) and half == max(1, len(r.t.split(" ")) - GRAM + 1)
    for r in with_fingerprint(df, "t", "f").select("t", "f", as_text("f").alias("s")).collect():
        g, places = grams[r.t], []
        for j in range(max(1, len(g) - WINDOW + 1)):
            window = range(j, min(j + WINDOW, len(g)))
            place = min(window, key=lambda p: (g[p], -p))
            if place not in places:
                places.append(place)
        half = len(r.f) // 2
        assert r.f[half:] == places and r.f[:half] == [g[p] for p in places]
        assert [int(e.split("@")[1]) for e in r.s.split(" ")] == places


def test_query_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = catalog.QUERIES["op6_winnowing"](spark, SF)
    assert not any(word in got._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))
    check(docs, got.collect())
