"""Hamming distances of many fingerprints at once, on vertical bit planes.

Plane p holds bit p of 64 fingerprints in one word. Xor of a plane with the
same plane moved by `lag` places compares 64 pairs (i, i + lag); carry-save
counters, themselves bit planes, add the differing bits up. Words in which
every pair has passed the radius are left out of all later planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHECK_EVERY = 8
#: Runs up to this length are compared together.
SHORT_RUN = 512
WORDS_AT_ONCE = 8192


class Counter:
    """Vertical counters that hold a waiting word per weight, so that two words and the sum go through one full adder."""

    def __init__(self, width: int, radius: int):
        self.radius = radius
        self.sums = [np.zeros(width, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.waiting: list[np.ndarray | None] = [None] * len(self.sums)
        self.over = np.zeros(width, np.uint64)

    def add(self, x: np.ndarray, weight: int = 0) -> None:
        while weight < len(self.sums):
            y = self.waiting[weight]
            if y is None:
                self.waiting[weight] = x
                return
            self.waiting[weight] = None
            both, either, held = x & y, x ^ y, self.sums[weight]
            self.sums[weight] = held ^ either
            x, weight = both | (held & either), weight + 1
        self.over |= x

    def exceeded(self) -> np.ndarray:
        """A set bit where a count is over the radius."""
        for weight in range(len(self.waiting)):
            if (x := self.waiting[weight]) is not None:
                self.waiting[weight] = None
                carry = self.sums[weight] & x
                self.sums[weight] = self.sums[weight] ^ x
                self.add(carry, weight + 1)
        more, equal = self.over.copy(), ~np.zeros_like(self.over)
        for weight in reversed(range(len(self.sums))):
            if self.radius >> weight & 1:
                equal &= self.sums[weight]
            else:
                more |= equal & self.sums[weight]
                equal &= ~self.sums[weight]
        return more

    def keep(self, which: np.ndarray) -> None:
        self.sums = [x[which] for x in self.sums]
        self.waiting = [x if x is None else x[which] for x in self.waiting]
        self.over = self.over[which]


def planes_of(prints: np.ndarray, room: int) -> np.ndarray:
    """(n, k) unsigned 64-bit words -> (64 k, words) planes, with `room` spare words at the end."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(len(prints), -1), axis=1)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((bits.shape[1], (-(-len(prints) // 64) + room) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def _pairs(planes: np.ndarray, ends: np.ndarray, lags: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, i + lag) of one run (i + lag < ends[i]) within the radius."""
    n = len(ends)
    words = -(-n // 64)
    at = np.arange(n)
    mask = np.zeros((len(lags), words * 8), np.uint8)
    for row, lag in enumerate(lags):
        packed = np.packbits(at + lag < ends, bitorder="little")
        mask[row, : len(packed)] = packed
    alive = mask.view("<u8").ravel()
    here = np.flatnonzero(alive)
    alive = alive[here]
    lag, word = lags[here // words], here % words
    other, shift = word + lag // 64, (lag % 64).astype(np.uint64)
    rest = np.uint64(63) - shift
    count = Counter(len(word), radius)
    for p, plane in enumerate(planes):
        moved = (plane[other] >> shift) | ((plane[other + 1] << np.uint64(1)) << rest)
        count.add(plane[word] ^ moved)
        if p % CHECK_EVERY == CHECK_EVERY - 1 or p == len(planes) - 1:
            alive = alive & ~count.exceeded()
            which = np.flatnonzero(alive)
            if len(which) < len(alive):
                alive, word, lag, other, shift, rest = alive[which], word[which], lag[which], other[which], shift[which], rest[which]
                count.keep(which)
            if not len(alive):
                break
    lanes = np.unpackbits(np.ascontiguousarray(alive).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(alive) else np.zeros((0, 64), np.uint8)
    row, lane = np.nonzero(lanes)
    i = word[row] * 64 + lane
    return i, i + lag[row]


def _near(prints: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices within the radius, several lags at a time."""
    longest = int((ends - np.arange(len(ends))).max())
    planes = planes_of(prints, longest // 64 + 2)
    step = max(1, WORDS_AT_ONCE // max(1, len(ends) // 64))
    for first in range(1, longest, step):
        yield _pairs(planes, ends, np.arange(first, min(longest, first + step)), radius)


def _shared_before(x: np.ndarray, y: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether two fingerprints agree on all bits of one of some masks (each as wide as a fingerprint)."""
    out, differ = np.zeros(len(x), bool), x ^ y
    for mask in masks:
        out |= ~(differ & mask).any(axis=1)
    return out


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the roots of pairs, in place. Those of the pairs that did it."""
    links = [(np.zeros(0, np.int64),) * 2]
    while len(i):
        ri, rj = root[i], root[j]
        differ = ri != rj
        i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
        low, high = np.minimum(ri, rj), np.maximum(ri, rj)
        order = np.lexsort((low, high))
        chosen = order[np.diff(high[order], prepend=-1) > 0]
        root[high[chosen]] = low[chosen]
        links.append((i[chosen], j[chosen]))
        while not np.array_equal(up := root[root], root):
            root[:] = up
    return tuple(np.concatenate(x) for x in zip(*links, strict=True))


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of rows of words."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _runs_at_once(run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, end of each row's run): all short runs together, then each long one."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lengths = np.diff(np.r_[starts, len(run)])
    short = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths))
    chosen = [short] if len(short) else []
    chosen += [np.arange(s, s + n) for s, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN], strict=True)]
    for rows in chosen:
        own = run[rows]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[begin, len(own)])
        yield rows, np.repeat(begin + size, size)


def link_runs(run: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """run: sorted group number of each row. Pairs (row, smaller row) within the radius that span what lies within it in a group."""
    a, b, _ = link_runs_twice(run, prints, radius, -1)
    return a, b


def link_runs_twice(run: np.ndarray, prints: np.ndarray, radius: int, closer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `link_runs`, and beside it pairs that span what lies within a smaller radius: (row, smaller row, whether of the latter)."""
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for rows, ends in _runs_at_once(run):
        wide, close = np.arange(len(ends)), np.arange(len(ends))
        for i, j in _near(prints[rows], ends, radius):
            near = distance(prints[rows[i]], prints[rows[j]]) <= closer
            for root, x, y, which in ((close, i[near], j[near], True), (wide, i, j, False)):
                x, y = _hook(root, x, y)
                links.append((rows[np.maximum(x, y)], rows[np.minimum(x, y)], np.full(len(x), which)))
    return tuple(np.concatenate(x) for x in zip(*links, strict=True))


def pairs_across(run: np.ndarray, prints: np.ndarray, radius: int, label: np.ndarray, earlier: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group within the radius whose labels differ, some lags at a time, so that few wait in memory.

    earlier: for each row, the masks of the keys before its own (one array per
    key, the same for all rows of a group): pairs that share one are left out,
    since the group of that key has them.
    """
    for rows, ends in _runs_at_once(run):
        for i, j in _near(prints[rows], ends, radius):
            differ = label[rows[i]] != label[rows[j]]
            i, j = rows[i[differ]], rows[j[differ]]
            if earlier is not None and len(i):
                which = np.array([len(earlier[r]) for r in i])
                seen = np.zeros(len(i), bool)
                for n in np.unique(which):
                    own = np.flatnonzero(which == n)
                    seen[own] = _shared_before(prints[i[own]], prints[j[own]], earlier[i[own[0]]])
                i, j = i[~seen], j[~seen]
            if len(i):
                yield i, j
