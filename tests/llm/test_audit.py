"""The filter audit against a plain run of every order."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

from pagemill.llm.filter_audit import OUTCOMES, STEPS, audit, packed, unpack

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(rows):
    """Set of failed filters of each row, from the wording of the rule."""
    out = []
    for i, t, *_ in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows):
            fails.add("E")
        out.append(fails)
    return out


def brute(rows, labels):
    """Every order applied to every row, one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for (i, _, lang, _), fails in zip(rows, failing(rows)):
        parts[lang or ""].append((i, fails))
    out = {}
    for part, docs in parts.items():
        shares = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [(i, fails) for i, fails in left if f in fails]
                failed = [fails for _, fails in docs if f in fails]
                left = [d for d in left if f not in d[1]]
                counts = len(left), len(gone), len(failed) - len(gone), sum(len(x) == 1 for x in failed)
                out[part, order, step] = (*counts, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shares[f] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step] += (shares[f],)
    return out


def sample():
    long = " ".join(f"w{k}" for k in range(220))
    rows = [(1, long, "en", "s"), (2, long, "en", "s"), (3, long, "fr", "s"), (4, "AB " * 250, "en", "s"), (5, long + " #", None, "s")]
    rows += [(6, None, "", "s"), (7, "", "fr", "s"), (8, " ".join(["a"] * 300), "en", "s"), (9, "x" * 200_000, "en", "s")]
    rows += [(2, long, "en", "s"), (1, long, "de", "s"), (None, long, "en", "s"), (None, "SHORT", "en", "s"), (10, "\x0b\x1c\x85 É", "de", "s")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (6, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (9, 1, 0)]
    return rows, labels


def test_against_brute_force(spark, documents):
    rows, labels = sample()
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit(documents(rows, "mask"), known).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in got} == brute(rows, labels)
    assert len(got) == 600 * 4


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(documents([]), labels).count() == 0
    got = audit(documents([(1, "a", "en", "s")]), labels).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0}
    assert audit(documents([(1, "a", "en", "s")]).select("doc_id", "text"), labels).first().part == ""


def test_fields_do_not_run_over():
    n = 2**62
    total = n * packed(0b1111111) + n * packed(0b0000001)
    for (order, step), counts in zip(STEPS, unpack(total)):
        found = dict(zip(OUTCOMES, counts))
        assert found["removed"] == n * (step == 1) + n * (order[step - 1] == "A")
        assert found["kept"] == n * ("A" not in order[:step])
        assert found["unique_fails"] == n * (order[step - 1] == "A") and found["toxic_lost"] == n * (step == 1)
