"""Removal of repeated byte strings by a hash-compared suffix sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import even_buckets, plain_names, shuffle_partitions, slices
from pagemill.llm.rolling import PrefixHash, mix

#: Bytes of a string that is removed when an earlier document has it too.
LENGTH = 50
#: Bytes of a gram. Each string of LENGTH bytes holds LENGTH - GRAM + 1 of them, and its smallest one is its anchor.
GRAM = 24
#: Anchors that a task gathers before it sends them on; bounds its memory.
GATHERED = 400_000
#: Bytes of text whose anchors are looked for at a time: the hashes and their minima are tens of times as large.
PART = 1 << 18
#: Rows of a matrix that are worked on at a time: the hashes of their prefixes are tens of times as large.
BLOCK = 4_000
#: Suffixes that are sorted at a time.
SORTED = 400_000
NO_ID = -(2**63)
TOP = np.uint64(2**64 - 1)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each run of ``width`` values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def anchors(flat: np.ndarray, stop: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, PrefixHash]:
    """Positions and gram hashes of the anchors of all strings of ``length`` bytes inside the texts that end at ``stop``.

    A string has the same anchors wherever it stands, since they depend on its bytes alone; all of equal hashes count.
    """
    sums = PrefixHash(flat)
    n, width = len(flat), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    at = np.arange(n - gram + 1)
    hashes = mix(sums.of(at, at + gram))
    end = np.repeat(stop, np.diff(np.concatenate([[0], stop])))
    hashes[at + gram > end[: len(at)]] = TOP
    least = sliding(hashes, width, np.minimum)
    least[np.arange(len(least)) + length > end[: len(least)]] = 0
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    chosen = np.flatnonzero((most == hashes) & (hashes != TOP))
    return chosen, hashes[chosen], sums


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns that are sorted together."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def by_group(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


class Contexts:
    """Anchors with the bytes around them, as rows of one matrix.

    A row has ``length - gram`` bytes before the anchor and ``length`` from it on, zero where the text ends;
    ``left`` and ``right`` say how many are there. All strings of ``length`` bytes around the anchor lie in its row.
    ``anchor`` and ``whole`` are hashes of the anchor and of the row with its limits.
    """

    FIELDS = ("anchor", "whole", "doc", "place", "left", "right", "rows")

    def __init__(self, *columns: np.ndarray):
        self.anchor, self.whole, self.doc, self.place, self.left, self.right, self.rows = columns

    @staticmethod
    def cut(flat, sums: PrefixHash, at, start, stop, doc, length: int, gram: int) -> Contexts:
        before = length - gram
        left, right = np.minimum(at - start, before), np.minimum(stop - at, length)
        rows = np.zeros((len(at), before + length), np.uint8)
        for k in range(0, len(at), BLOCK):
            where = at[k : k + BLOCK, None] + np.arange(-before, length)[None, :]
            there = (where >= (at - left)[k : k + BLOCK, None]) & (where < (at + right)[k : k + BLOCK, None])
            rows[k : k + BLOCK] = np.where(there, flat[np.clip(where, 0, len(flat) - 1)], 0)
        whole = mix(sums.of(at - left, at + right) + (left * 256 + right).astype(np.uint64))
        return Contexts(mix(sums.of(at, at + gram)), whole, doc, at - start, left, right, rows)

    @staticmethod
    def joined(parts: list[Contexts]) -> Contexts:
        """All rows of ``parts``, which lose their columns one after the other, so that two copies are never held."""
        return Contexts(*(np.concatenate([p.__dict__.pop(f) for p in parts]) for f in Contexts.FIELDS))

    def take(self, index) -> Contexts:
        return Contexts(*(getattr(self, f)[index] for f in self.FIELDS))

    def keep(self, index) -> Contexts:
        """Only these rows from now on, column by column."""
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f)[index])
        return self

    def pack(self) -> bytes:
        """All but the hashes, which the reader computes again, compressed."""
        kinds = zip(self.FIELDS[2:], ("<i8", "<i8", "u1", "u1", "u1"))
        return squeezed(len(self.doc), [getattr(self, f).astype(k) for f, k in kinds])

    @staticmethod
    def unpack(blobs: list[bytes], width: int, gram: int) -> Contexts:
        sizes = [int.from_bytes(blob[:8], "little") for blob in blobs]
        total, at_row = sum(sizes), 0
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
        c = Contexts(*(np.empty(total, k) for k in kinds), np.empty((total, width), np.uint8))
        for blob in blobs:
            n, columns = expanded(blob, ["<i8", "<i8", "u1", "u1", f"V{width}"])
            own = slice(at_row, at_row + n)
            c.doc[own], c.place[own], c.left[own], c.right[own] = columns[:4]
            c.rows[own] = columns[4].view(np.uint8).reshape(n, width)
            at_row += n
        for k in range(0, total, BLOCK):
            own = slice(k, min(k + BLOCK, total))
            sums = PrefixHash(c.rows[own].reshape(-1))
            at = np.arange(own.stop - k) * width + (width - gram) // 2
            c.anchor[own] = mix(sums.of(at, at + gram))
            le, ri = c.left[own], c.right[own]
            c.whole[own] = mix(sums.of(at - le, at + ri) + (le * 256 + ri).astype(np.uint64))
        return c


def squeezed(n: int, columns: list[np.ndarray]) -> bytes:
    """Columns of ``n`` values; numbers by place of their bytes, so that the high bytes, mostly equal, pack well."""
    parts = [c.tobytes() if c.ndim > 1 else np.ascontiguousarray(c.view(np.uint8).reshape(n, -1).T).tobytes() for c in columns]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expanded(blob: bytes, kinds: list[str]) -> tuple[int, list[np.ndarray]]:
    n, at, columns = int.from_bytes(blob[:8], "little"), 0, []
    data = zstandard.ZstdDecompressor().decompress(blob[8:])
    for kind in map(np.dtype, kinds):
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at)
        at += len(raw)
        columns.append(raw if kind.kind == "V" else np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind))
    return n, columns


def settle(c: Contexts) -> tuple[Contexts, np.ndarray]:
    """Take out of ``c`` the rows that an equal row of a smaller document covers whole.

    Returns the rows left and the spans (document, start, stop) covered. Hashes find equal rows and their bytes are
    compared before a span counts; a row that only has an equal hash is left in.
    """
    order = np.lexsort((c.place, c.doc, c.whole, c.anchor))
    starts = group_starts(c.anchor[order], c.whole[order])
    first = order[starts][by_group(starts, len(order))]
    later = c.doc[order] > c.doc[first]
    rows, models = order[later], first[later]
    same = (c.left[rows] == c.left[models]) & (c.right[rows] == c.right[models])
    for k in range(0, len(rows), BLOCK):
        same[k : k + BLOCK] &= (c.rows[rows[k : k + BLOCK]] == c.rows[models[k : k + BLOCK]]).all(axis=1)
    rows = rows[same]
    spans = np.stack([c.doc[rows], c.place[rows] - c.left[rows], c.place[rows] + c.right[rows]], axis=1)
    left = np.ones(len(order), bool)
    left[rows] = False
    return c if left.all() else c.keep(left), spans


class Suffixes:
    """Suffixes of one byte string, compared over their first ``length`` bytes by hashes of their prefixes."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, length: int):
        self.flat, self.at, self.length, self.sums = flat, at, length, PrefixHash(flat)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes suffixes ``a`` and ``b`` share at the front: a binary search over prefix hashes."""
        x, y = self.at[a], self.at[b]
        found = np.full(len(x), self.length, np.int64)
        open_ = np.flatnonzero(self.sums.of(x, x + self.length) != self.sums.of(y, y + self.length))
        x, y = x[open_], y[open_]
        sums, down = self.sums.sums, self.sums.down
        from_x, from_y, by_x, by_y = sums[x], sums[y], down[x], down[y]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length - 1, np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = (sums[x + middle] - from_x) * by_x == (sums[y + middle] - from_y) * by_y
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))
        found[open_] = low
        return found

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether ``a`` sorts before ``b`` (or with it): the first byte after what they share decides."""
        shared = self.common(a, b)
        k = np.minimum(shared, self.length - 1)
        return np.where(shared == self.length, or_equal, self.flat[self.at[a] + k] < self.flat[self.at[b] + k])

    def sort(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge sort inside each segment (numbers that do not fall), all runs of a pass together.

        A suffix that equals one of the run it is merged with joins it, so only different strings go on to the next
        pass. Returns the different ones in order, and for each suffix the one that it has joined (itself, if it stands).
        """
        n = len(segment)
        joined, items = np.arange(n), np.arange(n)
        run = items - np.repeat(group_starts(segment), np.diff(np.append(group_starts(segment), n))) if n else items
        while len(run) and run.max():
            seg = segment[items]
            starts = group_starts(seg, run)
            stops = np.append(starts[1:], len(items))
            number = by_group(starts, len(items))
            in_left = run % 2 == 0
            partner = np.where(in_left, number + 1, number - 1)
            there = np.minimum(partner, len(starts) - 1)
            has = (partner < len(starts)) & (seg[starts[there]] == seg) & (run[starts[there]] == run ^ 1)
            first, last = np.where(has, starts[there], 0), np.where(has, stops[there], 0)
            low, high = first.copy(), last.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                ahead = self.less(items[middle], items[open_], ~in_left[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            right = np.flatnonzero(~in_left & (low > first))
            right = right[self.common(items[low[right] - 1], items[right]) == self.length]
            joined[items[right]] = items[low[right] - 1]
            gone = np.zeros(len(items) + 1, np.int64)
            gone[right + 1] = 1
            before = np.cumsum(gone)
            own = np.arange(len(items)) - starts[number]
            place = own + low - first
            place -= np.where(in_left, before[low] - before[first], before[np.arange(len(items))] - before[starts[number]])
            stays = gone[1:] == 0
            items, place, run, seg = items[stays], place[stays], run[stays] >> 1, seg[stays]
            pair = group_starts(seg, run)
            moved = np.empty(len(items), np.int64)
            moved[pair[by_group(pair, len(items))] + place] = items
            items = moved
        while not np.array_equal(joined, joined[joined]):
            joined = joined[joined]
        return items, joined


def compare(c: Contexts, length: int, gram: int) -> Iterator[np.ndarray]:
    """Spans of strings of ``length`` bytes around equal anchors that a smaller document has too.

    Only anchors with several documents are looked at. For each offset of the anchor in the string, the strings whose
    hash several documents have are sorted as suffixes, and equal ones find each other; all but those of their smallest
    document are covered. Strings are dealt by their hash, so one anchor with very many surroundings is worked on in
    parts of bounded size. Bytes are compared before two strings count as equal.
    """
    order = np.argsort(c.anchor, kind="stable")
    starts = group_starts(c.anchor[order])
    if not len(starts):
        return
    low, high = np.minimum.reduceat(c.doc[order], starts), np.maximum.reduceat(c.doc[order], starts)
    group = by_group(starts, len(order))
    keep = (low != high)[group]
    order, group = order[keep], group[keep]
    offsets = length - gram + 1
    per = max(1, SORTED // offsets)
    done = 0
    while done < len(order):
        stop = min(done + per, len(order))
        if stop < len(order):  # a group stays together, a large one goes by few offsets at a time
            stop = int(np.searchsorted(group, group[stop - 1], side="right"))
        part, number = order[done:stop], group[done:stop]
        at_once = max(1, SORTED // len(part))
        for first in range(0, offsets, at_once):
            row, offset, key = repeated_strings(c, part, number, range(first, min(first + at_once, offsets)), length, gram)
            for piece in pieces(key, c.doc[part][row], SORTED // 16):
                yield from sorted_strings(c, part, number, row[piece], offset[piece], length, gram)
        done = stop


def repeated_strings(c: Contexts, part, number, offsets: range, length: int, gram: int):
    """Row, offset and key of the strings that occur in several documents by their hash; equal strings have equal keys."""
    before, width = length - gram, c.rows.shape[1]
    found = []
    for k in range(0, len(part), BLOCK):
        rows = part[k : k + BLOCK]
        sums = PrefixHash(c.rows[rows].reshape(-1))
        for offset in offsets:
            own = np.flatnonzero((offset <= c.left[rows]) & (length - offset <= c.right[rows]))
            at = own * width + before - offset
            salt = mix((number[k + own] * (before + 1) + offset).astype(np.uint64))
            found.append((k + own, np.full(len(own), offset), mix(sums.of(at, at + length) ^ salt)))
    row, offset, key = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(key, kind="stable")
    starts = group_starts(key[order])
    if not len(starts):
        return row, offset, key
    doc = c.doc[part][row[order]]
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    order = order[several[by_group(starts, len(order))]]
    return row[order], offset[order], key[order]


def pieces(key: np.ndarray, doc: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of sorted keys in pieces of about ``most`` that keep equal keys together.

    A key with more entries goes in several pieces, each with an entry of its smallest document in front.
    """
    starts = group_starts(key)
    stops = np.append(starts[1:], len(key))
    held, size = [], 0
    for a, b in zip(starts.tolist(), stops.tolist()):
        if b - a > most:
            head = a + int(np.argmin(doc[a:b]))
            for k in range(a, b, most):
                yield np.unique(np.append(np.arange(k, min(k + most, b)), head))
            continue
        if size + b - a > most and held:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(np.arange(a, b))
        size += b - a
    if held:
        yield np.concatenate(held)


def sorted_strings(c: Contexts, part, number, row, offset, length: int, gram: int) -> Iterator[np.ndarray]:
    """Spans that the suffix sort of some strings finds covered."""
    before = length - gram
    by = np.lexsort((row, offset, number[row]))
    row, offset = row[by], offset[by]
    flat = np.empty((len(row), length), np.uint8)
    for k in range(0, len(row), BLOCK):
        at = before - offset[k : k + BLOCK, None] + np.arange(length)
        flat[k : k + BLOCK] = c.rows[part[row[k : k + BLOCK], None], at]
    suffixes = Suffixes(flat.reshape(-1), np.arange(len(row)) * length, length)
    _, joined = suffixes.sort(number[row] * (before + 1) + offset)
    yield covered(c, part, suffixes, joined, row, offset, length)


def covered(c: Contexts, part, suffixes: Suffixes, joined, row, offset, length: int) -> np.ndarray:
    """Spans of the strings that have joined one of a smaller document, or been joined by one."""
    mine = np.flatnonzero(joined != np.arange(len(joined)))
    x, y = suffixes.at[mine], suffixes.at[joined[mine]]
    same = np.zeros(len(mine), bool)
    for k in range(0, len(mine), BLOCK):
        bytes_at = np.arange(length)
        same[k : k + BLOCK] = (suffixes.flat[x[k : k + BLOCK, None] + bytes_at] == suffixes.flat[y[k : k + BLOCK, None] + bytes_at]).all(axis=1)
    mine = mine[same]
    doc = c.doc[part][row]
    least = doc.copy()
    np.minimum.at(least, joined[mine], doc[mine])
    heads = np.unique(joined[mine])
    one = np.concatenate([mine, heads])
    hit = one[doc[one] > least[np.concatenate([joined[mine], heads])]]
    at = c.place[part][row[hit]] - offset[hit]
    return np.stack([doc[hit], at, at + length], axis=1)


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Spans (document, start, stop) joined where they overlap or touch, sorted."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = spans[:, 2].copy()
    starts = group_starts(spans[:, 0])
    for lo, hi in zip(starts, np.append(starts[1:], len(spans))):
        np.maximum.accumulate(reach[lo:hi], out=reach[lo:hi])
    new = np.ones(len(spans), bool)
    new[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(spans)) - 1
    return np.stack([spans[first, 0], spans[first, 1], reach[last]], axis=1)


def span_rows(spans: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One row per document: its spans as pairs of 64-bit numbers."""
    spans = merge_spans(spans)
    starts = group_starts(spans[:, 0]) if len(spans) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(spans))
    pairs = np.ascontiguousarray(spans[:, 1:]).astype("<i8") if len(spans) else spans
    return [int(spans[s, 0]) for s in starts], [pairs[s:e].tobytes() for s, e in zip(starts, ends)]


def batch(bucket, doc, kind, blob) -> pa.RecordBatch:
    arrays = [pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()), pa.array(kind, pa.int8()), pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket_", "id_", "kind_", "blob_"])


#: Kinds of rows between the steps: anchors of many documents, covered spans of one, shared anchors of one.
ANCHORS, SPANS, SHARED = 0, 1, 2
STEP_SCHEMA = "bucket_ int, id_ bigint, kind_ byte, blob_ binary"


def dealt(buckets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[order], np.arange(n), side="right")
    start = 0
    for k, stop in enumerate(ends.tolist()):
        if stop > start:
            yield k, order[start:stop]
        start = stop


def texts_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts of a slice, and where each begins and ends."""
    raw = b.column("text_").to_pylist()
    flat = np.frombuffer(b"".join(raw), np.uint8)
    stop = np.cumsum([len(r) for r in raw])
    return flat, stop - np.array([len(r) for r in raw]), stop


def find_anchors(length: int, gram: int, buckets: list[int]):
    """Step 1: the anchors of each document; those that an equal surrounding in the same task covers become spans."""
    parts = len(buckets)

    def run(batches):
        gathered: list[Contexts] = []

        def flush():
            if not gathered:
                return
            c = Contexts.joined(gathered)
            gathered.clear()
            c, spans = settle(c)
            ids, blobs = span_rows(spans)
            yield batch([buckets[i % parts] for i in ids], ids, [SPANS] * len(ids), blobs)
            rows = []
            for k, index in dealt((c.anchor % np.uint64(parts)).astype(np.int64), parts):
                index = index[np.lexsort((c.place[index], c.doc[index]))]
                # 48 bits of the hash: a chance agreement only sends a surrounding in vain
                columns = [c.anchor[index] >> np.uint64(16), c.doc[index].astype("<i8"), c.place[index].astype("<i4")]
                rows.append((buckets[k], None, ANCHORS, squeezed(len(index), columns)))
            yield batch(*zip(*rows)) if rows else batch([], [], [], [])

        for b in slices(batches, "text_", PART):
            flat, start, stop = texts_of(b)
            doc = b.column("id_").to_numpy()
            at, _, sums = anchors(flat, stop, length, gram)
            owner = np.searchsorted(stop, at, side="right")
            gathered.append(Contexts.cut(flat, sums, at, start[owner], stop[owner], doc[owner], length, gram))
            if sum(len(g.doc) for g in gathered) > GATHERED:
                yield from flush()
        yield from flush()

    return run


def find_shared(buckets: list[int]):
    """Step 2: of one bucket of anchors, those that several documents have, dealt out by document; spans go through."""
    parts = len(buckets)

    def run(batches):
        found = [[], [], []]
        for b in batches:
            through = []
            for kind, i, blob in zip(b.column("kind_").to_pylist(), b.column("id_").to_pylist(), b.column("blob_").to_pylist()):
                if kind == SPANS:
                    through.append((buckets[i % parts], i, SPANS, blob))
                    continue
                for k, column in enumerate(expanded(blob, ["<u8", "<i8", "<i4"])[1]):
                    found[k].append(column)
            if through:
                yield batch(*zip(*through))
        if not found[0]:
            return
        anchor, doc, place = (np.concatenate(x) for x in found)
        found.clear()
        order = np.argsort(anchor, kind="stable")
        starts = group_starts(anchor[order])
        several = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
        order = order[several[by_group(starts, len(order))]]
        order = order[np.lexsort((place[order], doc[order]))]
        doc, place = doc[order], place[order]
        rows = [(buckets[k], None, SHARED, squeezed(len(i), [doc[i], place[i]])) for k, i in dealt(doc % parts, parts)]
        if rows:
            yield batch(*zip(*rows))

    return run


def by_document(batches):
    """Between steps 2 and 3: one row per document with all its shared anchors; spans go through."""
    docs, places = [], []
    for b in batches:
        through = []
        for kind, i, blob in zip(b.column("kind_").to_pylist(), b.column("id_").to_pylist(), b.column("blob_").to_pylist()):
            if kind == SPANS:
                through.append((0, i, SPANS, blob))
                continue
            doc, place = expanded(blob, ["<i8", "<i4"])[1]
            docs.append(doc)
            places.append(place)
        if through:
            yield batch(*zip(*through))
    if not docs:
        return
    doc, place = np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order].astype("<i4")
    starts = group_starts(doc)
    ends = np.append(starts[1:], len(doc))
    for k in range(0, len(starts), 10_000):
        ids = doc[starts[k : k + 10_000]].tolist()
        blobs = [place[s:e].tobytes() for s, e in zip(starts[k : k + 10_000], ends[k : k + 10_000])]
        yield batch([0] * len(ids), ids, [SHARED] * len(ids), blobs)


def cut_contexts(length: int, gram: int, buckets: list[int]):
    """Step 3: the surroundings of shared anchors, dealt out by anchor; spans go through."""
    parts = len(buckets)

    def run(batches):
        gathered: list[Contexts] = []

        def flush():
            if not gathered:
                return
            c = Contexts.joined(gathered)
            gathered.clear()
            c, spans = settle(c)
            ids, blobs = span_rows(spans)
            yield batch([buckets[i % parts] for i in ids], ids, [SPANS] * len(ids), blobs)
            rows = [(buckets[k], None, ANCHORS, c.take(i).pack()) for k, i in dealt((c.anchor % np.uint64(parts)).astype(np.int64), parts)]
            yield batch(*zip(*rows)) if rows else batch([], [], [], [])

        for b in slices(batches, "text_", PART):
            flat, start, stop = texts_of(b)
            doc = b.column("id_").to_numpy()
            at, owner = [], []
            for k, blobs in enumerate(b.column("shared_").to_pylist()):
                for blob in blobs or ():
                    places = np.frombuffer(blob, "<i4").astype(np.int64) + start[k]
                    places = places[places + gram <= stop[k]]
                    at.append(places)
                    owner.append(np.full(len(places), k))
            spans = [(buckets[i % parts], i, SPANS, x) for i, blobs in zip(doc.tolist(), b.column("spans_").to_pylist()) for x in blobs or ()]
            if spans:
                yield batch(*zip(*spans))
            if at:
                at, owner = np.concatenate(at), np.concatenate(owner)
                gathered.append(Contexts.cut(flat, PrefixHash(flat), at, start[owner], stop[owner], doc[owner], length, gram))
            if sum(len(g.doc) for g in gathered) > GATHERED:
                yield from flush()
        yield from flush()

    return run


def find_spans(length: int, gram: int):
    """Step 4: the covered spans of one bucket of surroundings, by suffix sort."""
    width = 2 * length - gram

    def run(batches):
        blobs = []
        for b in batches:
            through = []
            for kind, i, blob in zip(b.column("kind_").to_pylist(), b.column("id_").to_pylist(), b.column("blob_").to_pylist()):
                if kind == SPANS:
                    through.append((0, i, SPANS, blob))
                else:
                    blobs.append(blob)
            if through:
                yield batch(*zip(*through))
        if not blobs:
            return
        c, spans = settle(Contexts.unpack(blobs, width, gram))
        blobs.clear()
        for more in chain([spans], compare(c, length, gram)):
            ids, out = span_rows(more)
            yield batch([0] * len(ids), ids, [SPANS] * len(ids), out)

    return run


def repeated_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"):
    """Texts with the spans that smaller documents have too: ``id_, text_ binary, spans_ array<binary>``.

    A string of ``length`` bytes has an anchor, a gram chosen by its bytes alone, so equal strings have equal anchors.
    (1) Each task finds the anchors of its documents and settles those with equal surroundings among them;
    (2) anchors that several documents have are told to these documents, one report per task and surrounding, so that
    no passage, however common, sends a row per copy; (3) documents send the surroundings of such anchors, equal ones
    once per task; (4) surroundings of one anchor meet in a suffix sort. Texts are shuffled once, by identifier.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    docs = df.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text_"),
    )
    buckets = even_buckets(spark, parts)
    first = docs.mapInArrow(find_anchors(length, gram, buckets), STEP_SCHEMA)
    shared = first.repartition(parts, "bucket_").mapInArrow(find_shared(buckets), STEP_SCHEMA)
    shared = shared.repartition(parts, "bucket_").mapInArrow(by_document, STEP_SCHEMA)
    told = shared.groupBy("id_").agg(
        F.collect_list(F.when(F.col("kind_") == SHARED, F.col("blob_"))).alias("shared_"),
        F.collect_list(F.when(F.col("kind_") == SPANS, F.col("blob_"))).alias("spans_"),
    )
    second = docs.join(told, "id_").mapInArrow(cut_contexts(length, gram, buckets), STEP_SCHEMA)
    found = second.repartition(parts, "bucket_").mapInArrow(find_spans(length, gram), STEP_SCHEMA)
    spans = found.groupBy("id_").agg(F.collect_list("blob_").alias("spans_"))
    return docs, spans


def kept_bytes(text: bytes, blobs: list[bytes] | None) -> tuple[bytes, int, int]:
    """What stays of a text, how many bytes go, and in how many runs."""
    if not blobs:
        return text, 0, 0
    spans = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in blobs])
    spans = np.clip(spans, 0, len(text))
    spans = merge_spans(np.hstack([np.zeros((len(spans), 1), np.int64), spans]))[:, 1:]
    spans = spans[spans[:, 1] > spans[:, 0]]
    parts, at = [], 0
    for start, stop in spans.tolist():
        parts.append(text[at:start])
        at = stop
    parts.append(text[at:])
    return b"".join(parts), int((spans[:, 1] - spans[:, 0]).sum()), len(spans)


def suffix_digests(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document without the bytes smaller documents have.

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller
    identifier, judged on the input. Null texts count as empty and texts shorter than ``length`` stay whole. Rows
    repeated with identifier and text get equal results; all rows of an identifier count as one document, whose spans
    apply to each of them. A null identifier is smaller than any other. An empty table gives no rows.
    """
    docs, spans = repeated_spans(df, length, gram, id_col, text_col)

    def digest(batches):
        for b in slices(batches, "text_"):
            n, removed, runs, sha = [], [], [], []
            for text, blobs in zip(b.column("text_").to_pylist(), b.column("spans_").to_pylist()):
                kept, gone, k = kept_bytes(text, blobs)
                n.append(len(text))
                removed.append(gone)
                runs.append(k)
                sha.append(hashlib.sha256(kept).hexdigest())
            numbers = [pa.array(x, pa.int64()) for x in (n, removed, runs)]
            arrays = [b.column("id_"), *numbers, pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id_", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "id_ bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    rows = docs.join(spans, "id_", "left").select("id_", "text_", "spans_").mapInArrow(digest, schema)
    return rows.select(F.nullif("id_", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with repeated bytes cut out of the text.

    What a cut leaves of a character that it goes through goes too. Texts without repeats stay as they are, null too.
    """
    own, (id_, text_) = plain_names(df, id_col, text_col)
    _, spans = repeated_spans(own, length, gram, id_, text_)
    names = own.columns

    def cut(batches):
        for b in slices(batches, text_):
            texts = []
            for text, blobs in zip(b.column(text_).to_pylist(), b.column("span_list_").to_pylist()):
                texts.append(kept_bytes(text.encode(), blobs)[0].decode("utf-8", "ignore") if blobs and text else text)
            arrays = [pa.array(texts, pa.string()) if c == text_ else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    at = spans.select(F.col("id_").alias("span_id_"), F.col("spans_").alias("span_list_"))
    key = F.coalesce(own[id_].cast("bigint"), F.lit(NO_ID))
    rows = own.join(at, key == at["span_id_"], "left").select(*names, "span_list_")
    return rows.mapInArrow(cut, own.schema).toDF(*df.columns)
