"""Periodic runs against a plain scan of every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from pagemill.llm import catalog
from pagemill.llm.periodic_runs import Grammar, find_runs, periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    """(start, length, period) of all runs, by one scan of the words per period."""
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(i, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str("" if i is None else i).encode()), len(words)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    rest = " ".join(w for k, w in enumerate(words) if k not in gone)
    said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        *(i, len(runs)),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        *(hashlib.sha256(t.encode()).hexdigest() for t in (said, rest)),
    )


def random_words(rng):
    k, w = rng.choice([1, 2, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        w += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8)
        if rng.random() < 0.3:
            w = w * rng.randint(1, 5)
    return w[:300]


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(500):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        doc, *found = find_runs([np.array(w, np.int64) for w in docs])
        rows = list(zip(*(f.tolist() for f in found)))
        for k, w in enumerate(docs):
            assert [r for d, r in zip(doc.tolist(), rows) if d == k] == plain_runs(w)


def test_grammar_extensions():
    rng = random.Random(2)
    for _ in range(100):
        w = [-1, *(rng.choice("aab") for _ in range(rng.randint(2, 80))), -2]
        number = {c: k for k, c in enumerate(dict.fromkeys(w))}
        s = np.array([number[c] for c in w])
        pairs = [rng.sample(range(1, len(w) - 1), 2) for _ in range(20)]
        for step in (1, -1):
            got = Grammar(s).extend(*(np.array(p) for p in zip(*pairs)), step)
            for (a, b), n in zip(pairs, got):
                k = 0
                while w[a + step * k] == w[b + step * k]:
                    k += 1
                assert n == k


def test_against_brute_force(documents):
    rng = random.Random(3)
    rows = [(i, " ".join(map(str, random_words(rng))), "en", "s") for i in range(200)]
    rows += [(300, None, "en", "s"), (301, "", "en", "s"), (302, " \t\n ", "en", "s"), (303, "a" * 100_000, "en", "s"), (304, "é\x85x " * 9, "en", "s")]
    rows += [(305, "x " * 3000, "en", "s"), (5, rows[5][1], "en", "s"), (None, "b c " * 20, "en", "s")]
    got = [tuple(r) for r in periodic_runs(documents(rows, "start")).collect()]
    assert Counter(got) == Counter(brute(i, t) for i, t, *_ in rows)
    assert periodic_runs(documents([])).count() == 0


def test_query_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = catalog.QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(brute(r.doc_id, r.text) for r in docs)
