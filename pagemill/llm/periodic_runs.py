"""Periodic runs of words by recompression: a run-length grammar answers how far two places agree.

The words of many documents, a mark of its own after each, make one string. It is compressed in turns by blocks (equal
neighbours become one symbol with a count) and by pairs (symbols are split into left and right ones by a hash, every
left one followed by a right one becomes one symbol). Equal stretches are cut alike except at their ends, so the longest
common extension of two places climbs over equal symbols and comes down again at the first difference.
A run of period ``q`` and four periods holds a place of every grid of step ``3 q`` with its partner ``q`` words on: these
pairs are the candidates, n/(3 q) for each ``q``, and two extensions give the exact ends of their run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices
from pagemill.llm.rolling import BASE, mix

#: A run has at least this many words and this many periods. The grid of candidates rests on four periods.
MIN_WORDS, MIN_PERIODS = 6, 4
GRID = MIN_PERIODS - 1


class Grammar:
    """Levels of a recompressed string; level 0 is the string, a symbol of a level stands for a run of the one below."""

    def __init__(self, symbols: np.ndarray):
        self.symbol = [symbols.astype(np.int64)]
        self.size = [np.ones(len(symbols), np.int64)]
        self.up: list[np.ndarray] = []
        self.first: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.last: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.block: list[bool] = []
        distinct, salt = len(np.unique(symbols)), 0
        while distinct < len(self.symbol[-1]):
            distinct = self.blocks(distinct)
            if distinct < len(self.symbol[-1]):
                salt += 1
                distinct = self.pairs(distinct, salt)

    def add(self, start: np.ndarray, key: np.ndarray, block: bool) -> int:
        below = len(self.symbol[-1])
        codes, found = pd.factorize(key)
        owner = np.zeros(below, np.int64)
        owner[start[1:]] = 1
        self.up.append(np.cumsum(owner))
        self.block.append(block)
        self.symbol.append(codes.astype(np.int64))
        self.size.append(np.add.reduceat(self.size[-1], start))
        self.first.append(start)
        self.last.append(np.append(start[1:], below) - 1)
        return len(found)

    def blocks(self, distinct: int) -> int:
        s = self.symbol[-1]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        if len(start) == len(s):
            return distinct
        count = np.diff(np.append(start, len(s)))
        return self.add(start, s[start] * (int(count.max()) + 1) + count, True)

    def pairs(self, distinct: int, salt: int) -> int:
        s = self.symbol[-1]
        right = (mix(s.astype(np.uint64) + np.uint64(salt * int(BASE) % 2**64)) & np.uint64(1)).astype(bool)
        second = np.concatenate([[False], ~right[:-1] & right[1:]])
        if not second.any():
            return distinct
        start = np.flatnonzero(~second)
        paired = np.append(second[1:], False)[start]
        partner = np.where(paired, s[np.minimum(start + 1, len(s) - 1)] + 1, 0)
        return self.add(start, s[start] * (int(s.max()) + 2) + partner, False)

    def extend(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from places ``a`` and ``b`` on, to the right (``step`` 1) or to the left (-1).

        Places differ, and a symbol that occurs once stands between them and either end of the string.
        """
        n, x, y = np.zeros(len(a), np.int64), a.copy(), b.copy()
        near, far = (self.first, self.last) if step > 0 else (self.last, self.first)

        def advance(k, h):
            """Over the symbols that both have at level ``h``: one of a pair, or what is left of the shorter block."""
            if self.block[h]:
                end = far[h + 1]
                left = [np.abs(end[self.up[h][p[k]]] - p[k]) + 1 for p in (x, y)]
                many = np.minimum(*left)
            else:
                many = np.ones(len(k), np.int64)
            n[k] += many * self.size[h][x[k]]
            x[k] += step * many
            y[k] += step * many

        turned: list[np.ndarray] = []
        live = np.arange(len(a))
        for h, up in enumerate(self.up):
            edge = near[h + 1]

            def inside(k):
                return (edge[up[x[k]]] != x[k]) | (edge[up[y[k]]] != y[k])

            k = live[inside(live)]
            advance(k[self.symbol[h][x[k]] == self.symbol[h][y[k]]], h)
            out = inside(live) | (self.symbol[h][x[live]] != self.symbol[h][y[live]])
            turned.append(live[out])
            live = live[~out]
            x[live], y[live] = up[x[live]], up[y[live]]
            if not len(live):
                break
        else:
            turned.append(live)
        down = np.zeros(0, np.int64)
        for h in range(len(turned) - 1, 0, -1):
            down = np.concatenate([down, turned[h]])
            x[down], y[down] = near[h][x[down]], near[h][y[down]]
            advance(down[self.symbol[h - 1][x[down]] == self.symbol[h - 1][y[down]]], h - 1)
        return n


def find_runs(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents given as word numbers: document, start, length, period, sorted so."""
    order = sorted((d for d in range(len(docs)) if len(docs[d]) >= MIN_WORDS), key=lambda d: -len(docs[d]))
    if not order:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.array([len(docs[d]) for d in order], np.int64)
    begin = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    top = 1 + max(int(docs[d].max()) for d in order)
    parts = [np.array([top], np.int64)]
    for k, d in enumerate(order):
        parts += [docs[d], np.array([top + 1 + k], np.int64)]
    s = np.concatenate(parts)
    grammar = Grammar(s)
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)  # runs by the multiples of their period
    low, most = 1, int(sizes[0]) // MIN_PERIODS
    while low <= most:
        places, periods = [], []
        for q in range(low, min(2 * low - 1, most) + 1):
            held = int(np.searchsorted(-sizes, -max(MIN_WORDS, MIN_PERIODS * q), side="right"))  # documents long enough
            if not held:
                break
            stop = int(begin[held - 1] + sizes[held - 1]) - q
            same = s[: max(stop, 0) : GRID * q] == s[q : max(stop, 0) + q : GRID * q]
            for start, end in known.pop(q, ()):
                same[-(-start // (GRID * q)) : max(0, -(-(end - q) // (GRID * q)))] = False  # the same run again
            at = np.flatnonzero(same) * (GRID * q)
            if len(at):
                places.append(at)
                periods.append(np.full(len(at), q, np.int64))
        if places:
            x, q = np.concatenate(places), np.concatenate(periods)
            after, before = grammar.extend(x, x + q, 1), grammar.extend(x - 1, x + q - 1, -1)
            long = after + before + q >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
            for start, end, p in sorted(set(zip(*((v[long]).tolist() for v in (x - before, x + q + after, q))))):
                if (start, end) in found:
                    continue  # a multiple of its smallest period
                found[start, end] = p
                for multiple in range(2 * p, (end - start) // MIN_PERIODS + 1, p):
                    known[multiple].append((start, end))
        low *= 2
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    start, end = np.array(list(found), np.int64).T
    period = np.array(list(found.values()), np.int64)
    k = np.searchsorted(begin, start, side="right") - 1
    doc, start, length = np.array(order, np.int64)[k], start - begin[k], end - start
    by = np.lexsort((period, start, doc))
    return doc[by], start[by], length[by], period[by]


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document; in one of ten, chosen by a checksum of the identifier, the end becomes periodic."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def report(ids: list, texts: list) -> list[list]:
    """Columns of :func:`periodic_runs` for some documents."""
    number: dict[bytes, int] = {}
    words = [edited((t or "").encode().split(), i) for i, t in zip(ids, texts)]
    docs = [np.array([number.setdefault(w, len(number)) for w in doc], np.int64) for doc in words]
    doc, start, length, period = find_runs(docs)
    cut = np.searchsorted(doc, np.arange(len(docs) + 1))
    rows = []
    for k, own in enumerate(words):
        s, n, q = (v[cut[k] : cut[k + 1]] for v in (start, length, period))
        said = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist()))
        best = (None,) * 4
        if len(s):
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, s + q, 1)
            np.add.at(change, s + n, -1)
            own = [w for w, inside in zip(own, np.cumsum(change).tolist()) if not inside]
            j = int(np.lexsort((q, s, -n))[0])
            best = int(s[j]), int(n[j]), int(q[j]), int(1000 * n[j] // q[j])
        rows.append((len(s), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest()))
    return [list(column) for column in zip(*rows)]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    Null and empty texts, and texts of white space, have no words, no runs and four nulls. Rows without identifier take
    the checksum of no characters. Among runs of equal length the first start counts, then the smallest period.
    Repeated rows give repeated results, an empty table gives no rows, other columns are ignored. Texts are taken whole;
    memory grows with the longest one only. Nothing is shuffled.
    """
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches):
        for b in slices(batches, "text_"):
            columns = report(b.column("doc_id").to_pylist(), b.column("text_").to_pylist())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", *names])

    picked = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text_"))
    schema = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'bigint'}" for n in names)
    return picked.mapInArrow(run, f"doc_id bigint, {schema}")
