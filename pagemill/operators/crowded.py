"""Box rules that run over sorted or grouped rows inside a task, a part of a page at a time.

Both are given rows in an order that Spark has sorted, read them batch by batch, and hold what the rule needs only:
suppression the boxes that were kept so far, containment the boxes of one grid cell.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil, floor, log2

import numpy as np
import pandas as pd

SIDES = ["x1", "y1", "x2", "y2"]
#: Pairs that are compared at a time: bounds the memory of a task.
PAIRS = 1 << 20


class KeptBoxes:
    """Kept boxes of one part of a page, filed by their size and the cells they cover."""

    def __init__(self, same: float, other: float, reach: int, top: int):
        self.same, self.other, self.reach, self.top = same, other, reach, top
        self.cells: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        self.rows: list[tuple[int, float, float, float, float]] = []

    def covered(self, level: int, x1: float, y1: float, x2: float, y2: float) -> Iterator[tuple[int, int, int]]:
        side = 2.0**level
        for cx in range(floor(x1 / side), floor((x2 + 1) / side) + 1):
            for cy in range(floor(y1 / side), floor((y2 + 1) / side) + 1):
                yield level, cx, cy

    def beaten(self, near: list[int], cls: int, x1: float, y1: float, x2: float, y2: float) -> bool:
        k = np.array([self.rows[i] for i in near])
        width = np.minimum(k[:, 3], x2) - np.maximum(k[:, 1], x1) + 1
        height = np.minimum(k[:, 4], y2) - np.maximum(k[:, 2], y1) + 1
        inter = np.maximum(0.0, width) * np.maximum(0.0, height)
        union = (k[:, 3] - k[:, 1] + 1) * (k[:, 4] - k[:, 2] + 1) + (x2 - x1 + 1) * (y2 - y1 + 1) - inter
        ratio = np.divide(inter, union, out=np.zeros(len(k)), where=union != 0)
        return bool((ratio >= np.where(k[:, 0] == cls, self.same, self.other)).any())

    def add(self, cls: int, x1: float, y1: float, x2: float, y2: float) -> bool:
        """Keep the box unless a kept one overlaps it too much."""
        longer = max(x2 - x1, y2 - y1, 0.0) + 1
        own = min(ceil(log2(longer)), self.top)
        near: set[int] = set()
        for level in range(max(0, own - self.reach), min(self.top, own + self.reach) + 1):
            for cell in self.covered(level, x1, y1, x2, y2):
                near.update(self.cells.get(cell, ()))
        if near and self.beaten(list(near), cls, x1, y1, x2, y2):
            return False
        for cell in self.covered(own, x1, y1, x2, y2):
            self.cells[cell].append(len(self.rows))
        self.rows.append((cls, x1, y1, x2, y2))
        return True


def suppress(keys: list[str], same: float, other: float, reach: int, top: int):
    """A step over rows sorted by ``keys`` and falling rank: the rows of each key that greedy suppression keeps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, None
        for frame in frames:
            flags = []
            part = zip(*(frame[c].tolist() for c in keys))
            boxes = zip(*(frame[c].tolist() for c in ("cls_id", *SIDES)))
            for key, box in zip(part, boxes):
                if key != current:
                    current, kept = key, KeptBoxes(same, other, reach, top)
                flags.append(kept.add(*box))
            yield frame.loc[np.array(flags, bool), [*keys[:2], "det_id"]]

    return run


def contained(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """Whether ``b`` holds the share ``ratio`` of ``a``, for arrays of sides in their last axis."""
    width = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    height = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    inter = np.maximum(0.0, width) * np.maximum(0.0, height)
    area = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1])
    share = np.divide(inter, area, out=np.zeros(inter.shape), where=area > 0)
    return (share >= ratio) & (area > 0)


class Boxes:
    """Columns of some boxes; ``inner`` and ``outer`` have a bit for each condition that a box may take part in."""

    def __init__(self, frame: pd.DataFrame):
        self.sides = frame[SIDES].to_numpy(float)
        self.id, self.cls, self.n = (frame[c].to_numpy() for c in ("det_id", "cls_id", "n"))
        self.inner, self.outer = frame["inner_bits"].to_numpy(np.int64), frame["outer_bits"].to_numpy(np.int64)

    def pick(self, k) -> Boxes:
        some = object.__new__(Boxes)
        some.__dict__ = {name: v[k] for name, v in self.__dict__.items()}
        return some


def shared_bits(a: Boxes, b: Boxes, ratio: float, relation: list[str]) -> np.ndarray:
    """Bits of the conditions that hold for ``a`` inside ``b``, pair by pair (arrays that broadcast)."""
    bits = a.inner & b.outer
    # a box is inside another one, or inside a copy of itself
    bits = np.where(contained(a.sides, b.sides, ratio) & ((a.id != b.id) | (a.n > 1)), bits, 0)
    same = a.cls == b.cls
    for k, wanted in enumerate(relation):
        if wanted != "any":
            bits = np.where(same == (wanted == "same"), bits, bits & ~(1 << k))
    return bits


def find(asking: Boxes, others: Boxes, as_inner: bool, wanted: int, ratio: float, relation: list[str]) -> np.ndarray:
    """Bits found for each asking box, against as few others as it takes: a box that has all its bits asks no more."""
    mine, theirs = (asking.inner, others.outer) if as_inner else (asking.outer, others.inner)
    mine = mine & wanted & (np.bitwise_or.reduce(theirs) if len(theirs) else 0)
    found = np.zeros(len(mine), np.int64)
    size = (asking.sides[:, 2] - asking.sides[:, 0]) * (asking.sides[:, 3] - asking.sides[:, 1])
    area = (others.sides[:, 2] - others.sides[:, 0]) * (others.sides[:, 3] - others.sides[:, 1])
    order = np.argsort(-area if as_inner else area, kind="stable")  # likely witnesses first
    open_, start, step = np.flatnonzero(mine), 0, 16
    while len(open_) and start < len(order):
        other = others.pick(order[start : start + step])
        rows = max(1, PAIRS // len(other.id))
        for k in range(0, len(open_), rows):
            own = asking.pick(open_[k : k + rows, None])
            pair = (own, other) if as_inner else (other, own)
            found[open_[k : k + rows]] |= np.bitwise_or.reduce(shared_bits(*pair, ratio, relation), axis=1)
        if as_inner:  # from here on the others are too small for the larger ones
            left = area[order[min(start + step, len(order) - 1)]]
            open_ = open_[((found[open_] & mine[open_]) != mine[open_]) & (size[open_] * ratio <= left * (1 + 1e-9))]
        else:
            open_ = open_[(found[open_] & mine[open_]) != mine[open_]]
        start, step = start + step, min(step * 2, 4096)
    return found & wanted


def witnesses(keys: list[str], ratio: float, relation: list[str], inner_wanted: int, outer_wanted: int):
    """A step over rows sorted by ``keys`` (a grid cell) and ``probe``: bits of the conditions found for each box."""

    def judge(cells: pd.DataFrame) -> pd.DataFrame:
        number = cells.groupby(keys, sort=False).ngroup().to_numpy()
        probe = cells["probe"].to_numpy(bool)
        n = int(number[-1]) + 1
        n_a, n_b = np.bincount(number[probe], minlength=n), np.bincount(number[~probe], minlength=n)
        place = cells[[*keys[:2], "det_id"]]
        out = []

        def say(rows: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> None:
            hit = (inner | outer) != 0
            out.append(place.iloc[rows[hit]].assign(inner_bits=inner[hit], outer_bits=outer[hit]))

        boxes = Boxes(cells)
        rows_a, rows_b = np.flatnonzero(probe), np.flatnonzero(~probe)
        begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        pairs = n_a * n_b
        small = np.flatnonzero((pairs > 0) & (pairs <= PAIRS // 16))
        ends = np.cumsum(pairs[small])
        for lot in np.split(small, np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) if len(ends) else 0, PAIRS))):
            if not len(lot):
                continue
            cell = np.repeat(lot, pairs[lot])
            k = np.arange(len(cell)) - np.repeat(np.cumsum(pairs[lot]) - pairs[lot], pairs[lot])
            a, b = rows_a[begin_a[cell] + k // n_b[cell]], rows_b[begin_b[cell] + k % n_b[cell]]
            bits = shared_bits(boxes.pick(a), boxes.pick(b), ratio, relation)
            for rows, wanted, as_inner in ((a, inner_wanted, True), (b, outer_wanted, False)):
                total = np.zeros(len(cells), np.int64)
                np.bitwise_or.at(total, rows, bits & wanted)
                some = np.flatnonzero(total)
                nothing = np.zeros(len(some), np.int64)
                say(some, *((total[some], nothing) if as_inner else (nothing, total[some])))
        for c in np.flatnonzero(pairs > PAIRS // 16):
            a, b = rows_a[begin_a[c] : begin_a[c] + n_a[c]], rows_b[begin_b[c] : begin_b[c] + n_b[c]]
            inner = find(boxes.pick(a), boxes.pick(b), True, inner_wanted, ratio, relation)
            outer = find(boxes.pick(b), boxes.pick(a), False, outer_wanted, ratio, relation)
            say(a, inner, np.zeros(len(a), np.int64))
            say(b, np.zeros(len(b), np.int64), outer)
        empty = place.iloc[:0].assign(inner_bits=np.zeros(0, np.int64), outer_bits=np.zeros(0, np.int64))
        return pd.concat([empty, *out])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            key = frame[keys].to_numpy()
            last = (key != key[-1]).any(axis=1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last cell may go on in the next batch
            if held and (cut or (held[-1][keys].iloc[-1].to_numpy() != key[0]).any()):
                whole = pd.concat([*held, frame.iloc[:cut]])
                held = [frame.iloc[cut:]]
                yield judge(whole)
            elif cut:
                yield judge(frame.iloc[:cut])
                held = [frame.iloc[cut:]]
            else:
                held.append(frame)
        if held:
            yield judge(pd.concat(held))

    return run
