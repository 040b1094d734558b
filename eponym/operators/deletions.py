"""Pairs of short names within an edit distance, by the letters that deletions leave.

Names of the letters a to z are packed into 64 bits, five for a letter. If at most k edits part
a name from a longer one (length n), deleting k letters from the longer one and k - (n - m)
from the other (length m) can leave the same letters. Every such rest is a key under which both
names meet, and an array calculation over all pairs that met decides.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np

LONGEST = 12


def edits(least: float, longer: int) -> int:
    """The most edits between names alike, of which the longer has ``longer`` letters."""
    return math.floor((1 - least) * longer + 1e-9)


def fewest_edits(upper: float, longer: int) -> int:
    """The fewest edits between names no more alike than ``upper``, of which the longer has ``longer`` letters."""
    return next(d for d in range(longer + 1) if 1 - d / longer <= upper + 1e-12)


def lengths(least: float, most: int = 220) -> list[int]:
    """Lengths of a longer name for which no name has more than ``most`` rests."""
    return [n for n in range(1, LONGEST + 1) if 0 < (k := edits(least, n)) < n and max(math.comb(m, k - n + m) for m in range(max(1, n - k), n + 1)) <= most]


@functools.lru_cache(maxsize=8)
def roles(least: float) -> dict[int, list[tuple[int, int, int]]]:
    """By a name's own length: (length of the longer one, letters to delete, 0 for the longer one or 1)."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for n in lengths(least):
        k = edits(least, n)
        for m in range(math.ceil(least * n - 1e-9), n + 1):
            if 0 <= k - (n - m) < m:
                out.setdefault(m, []).append((n, k - (n - m), int(m < n)))
    return out


def rests_of(length: int, least: float) -> int:
    return sum(math.comb(length, gone) for _, gone, _ in roles(least).get(length, []))


def packed(names: list[str]) -> dict[int, np.ndarray]:
    """Names by length, as integers that order like the names of one length."""
    by: dict[int, list[bytes]] = {}
    for x in names:
        by.setdefault(len(x), []).append(x.encode("ascii"))
    out = {}
    for n, some in by.items():
        cells = np.frombuffer(b"".join(some), dtype=np.uint8).reshape(len(some), n).astype(np.uint64) - np.uint64(96)
        v = np.zeros(len(some), dtype=np.uint64)
        for i in range(LONGEST):
            v = (v << np.uint64(5)) | (cells[:, i] if i < n else np.uint64(0))
        out[n] = v
    return out


def letters(v: np.ndarray) -> np.ndarray:
    """Codes of letters (rows: places)."""
    return np.stack([((v >> np.uint64(5 * (LONGEST - 1 - i))) & np.uint64(31)).astype(np.uint8) for i in range(LONGEST)])


def text(v: np.ndarray, more: np.ndarray | None = None):
    """The names again, as an Arrow array of strings; ``more`` has letters 13 to 24."""
    import pyarrow as pa

    cells = np.ascontiguousarray((letters(v) if more is None else np.concatenate([letters(v), letters(more)])).T)
    there = cells > 0
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(v), pa.py_buffer(ends), pa.py_buffer((cells[there] + np.uint8(96)).tobytes()))


def words(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters 1 to 12 and 13 to 24 of names (rows of codes), packed like those of ``packed``."""
    out = []
    for first in (0, LONGEST):
        v = np.zeros(len(cells), dtype=np.uint64)
        for i in range(first, first + LONGEST):
            v = (v << np.uint64(5)) | cells[:, i].astype(np.uint64)
        out.append(v)
    return out[0], out[1]


class Chosen:
    """Per name the ``k`` first partners by the MD5 of "name,partner", of pairs added both ways.

    Pairs of ``without`` (four sorted words a row: name, its rest, partner, its rest) do not count.
    """

    def __init__(self, k: int, without: np.ndarray, room: int = 1 << 20):
        self.k, self.without, self.room = k, without, room
        self.keys, self.new, self.n, self.held = self.key(without.T), [], 0, None

    @staticmethod
    def key(four) -> np.ndarray:
        h = np.zeros(len(four[0]), dtype=np.uint64)
        for x in four:
            h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def table(rows: np.ndarray) -> np.ndarray:
        """``rows`` of four words in the order in which they are looked up."""
        return rows[np.argsort(Chosen.key(rows.T), kind="stable")]

    def excluded(self, four) -> np.ndarray:
        out = np.zeros(len(four[0]), dtype=bool)
        if len(self.keys):
            h = self.key(four)
            at = np.searchsorted(self.keys, h)
            left = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h))
            at = at[left]
            while len(left):  # rows of one key stand side by side
                same = np.logical_and.reduce([self.without[at, c] == four[c][left] for c in range(4)])
                out[left[same]] = True
                left, at = left[~same], at[~same] + 1
                more = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h[left])
                left, at = left[more], at[more]
        return out

    def add(self, a, a_more, b, b_more, similarity) -> None:
        four = [np.concatenate(x) for x in ((a, b), (a_more, b_more), (b, a), (b_more, a_more))]
        there = ~self.excluded(four)
        self.new.append([*(x[there] for x in four), np.concatenate([similarity, similarity])[there]])
        self.n += int(there.sum())
        if self.n > self.room:
            self.cut()

    def cut(self) -> None:
        """Keeps the first of every name."""
        from hashlib import md5

        import pyarrow.compute as pc

        if self.new:
            some = [np.concatenate(x) for x in zip(*self.new)]
            both = pc.binary_join_element_wise(text(some[0], some[1]).cast("binary"), text(some[2], some[3]).cast("binary"), b",").to_pylist()
            digests = np.frombuffer(b"".join([md5(x).digest() for x in both]), dtype=">u8").reshape(-1, 2)
            some += [digests[:, 0].astype(np.uint64), digests[:, 1].astype(np.uint64)]
            self.held = some if self.held is None else [np.concatenate(x) for x in zip(self.held, some)]
        if self.held is None:
            return
        name, more, _, _, _, high, low = self.held
        order = np.lexsort((low, high, more, name) if more.any() else (high, name))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (more[order][1:] != more[order][:-1])])
        if (~new[1:] & (high[order][1:] == high[order][:-1])).any():
            order = np.lexsort((low, high, more, name))
        first = np.flatnonzero(new)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.held, self.new = [x[order[place < self.k]] for x in self.held], []
        # where most names have no more than k, cutting again soon would cost only
        self.n = 0

    def rows(self):
        """(name, partner, similarity) as Arrow arrays, in chunks."""
        import pyarrow as pa

        self.cut()
        if self.held is not None:
            for at in range(0, len(self.held[0]), 50_000):
                name, more, other, rest, similarity = (x[at : at + 50_000] for x in self.held[:5])
                yield text(name, more), text(other, rest), pa.array(similarity, pa.float64())


def dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """A part for every key, the same for both roles."""
    h = (keys >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % parts


def rests(names: dict[int, np.ndarray], least: float):
    """(keys, names) of all rests; a key holds the longer one's length, the letters and, in its lowest bit, the role."""
    for m, v in names.items():
        cells = letters(v).astype(np.uint64)
        for n, gone, short in roles(least).get(m, []):
            for kept in itertools.combinations(range(m), m - gone):
                key = np.zeros(len(v), dtype=np.uint64)
                for i in kept:
                    key = (key << np.uint64(5)) | cells[i]
                yield (np.uint64(n) << np.uint64(57)) | (key << np.uint64(1)) | np.uint64(short), v


def distance(a: np.ndarray, b: np.ndarray, m: int, n: int, k: int) -> np.ndarray:
    """Edit distances of names of m and of n letters, exact up to ``k`` and more than that otherwise."""
    return distance_of(letters(a), letters(b), m, n, k)


def distance_of(x: np.ndarray, y: np.ndarray, m: int, n: int, k: int) -> np.ndarray:
    """The same from codes of letters (rows: places)."""
    a, far = x[0], np.uint8(60)
    before = [np.full(len(a), j if j <= k else far, dtype=np.uint8) for j in range(n + 1)]
    for i in range(1, m + 1):
        row: list = [np.full(len(a), i if i <= k else far, dtype=np.uint8)] + [None] * n
        for j in range(1, n + 1):
            if abs(i - j) > k:
                row[j] = np.full(len(a), far, dtype=np.uint8)
                continue
            d = before[j - 1] + (x[i - 1] != y[j - 1])
            np.minimum(d, before[j] + np.uint8(1), out=d)
            np.minimum(d, row[j - 1] + np.uint8(1), out=d)
            row[j] = d
        before = row
    return before[n]


def first_rest(a: np.ndarray, b: np.ndarray, m: int, n: int, k: int) -> np.ndarray:
    """The largest of the rests that names of m (``a``) and n letters have in common; 0 without one."""
    x, y = letters(a).astype(np.uint64), letters(b).astype(np.uint64)
    none = np.uint64(0)
    gone_a, gone_b = k - (n - m), k
    # best[p, q] at place i of a: p letters of a and q of b are gone, so b is at place i - p + q; one is added to a rest, so 0 is none
    best: dict[tuple[int, int], np.ndarray] = {}
    for i in range(m, -1, -1):
        row: dict[tuple[int, int], np.ndarray] = {}
        for p in range(min(gone_a, i), -1, -1):
            for q in range(gone_b, -1, -1):
                j = i - p + q
                if j > n or m - i < gone_a - p or n - j < gone_b - q:
                    continue
                if i == m and j == n:
                    if p == gone_a and q == gone_b:
                        row[p, q] = np.ones(len(a), dtype=np.uint64)
                    continue
                found = []
                if i < m and j < n and (p, q) in best:
                    after, left = best[p, q], m - gone_a - (i - p) - 1
                    found.append(np.where((x[i] == y[j]) & (after != none), after + (x[i] << np.uint64(5 * left)), none))
                if i < m and (p + 1, q) in best:
                    found.append(best[p + 1, q])
                if j < n and (p, q + 1) in row:
                    found.append(row[p, q + 1])
                if found:
                    row[p, q] = functools.reduce(np.maximum, found)
        best = row
    got = best.get((0, 0))
    return np.zeros(len(a), dtype=np.uint64) if got is None else np.where(got != none, got - np.uint64(1), none)


def meet(keys: np.ndarray, names: np.ndarray, least: float, most: int = 1 << 16, upper: float = 1.0):
    """(smaller, larger, distance, letters of the longer one) in chunks, of alike names that meet under a key.

    A pair that meets under several keys is returned under the largest rest only, so once in all.
    Pairs more alike than ``upper`` are left out.
    """
    if not len(keys):
        return
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])])
    keys, names = keys[once], names[once]
    sizes = np.full(len(names), LONGEST, dtype=np.int64)
    for i in range(1, LONGEST):
        sizes[(names & ((np.uint64(1) << np.uint64(5 * (LONGEST - i))) - np.uint64(1))) == 0] -= 1
    group = keys >> np.uint64(1)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.repeat(np.append(new[1:], len(keys)), np.diff(np.append(new, len(keys))))
    first = np.flatnonzero((keys & np.uint64(1)) == 0)  # the longer ones stand before the others
    partners = end[first] - first - 1
    first, partners = first[partners > 0], partners[partners > 0]
    kind = (keys[first] >> np.uint64(57)).astype(np.int64)
    for longer in np.unique(kind).tolist():
        own = kind == longer
        at, cut, k = first[own], np.concatenate([[0], np.cumsum(partners[own])]), edits(least, longer)
        fewest = fewest_edits(upper, longer)
        if fewest > k:
            continue
        for low in range(0, int(cut[-1]), most):
            place = np.arange(low, min(int(cut[-1]), low + most))
            row = np.searchsorted(cut, place, side="right") - 1
            i = at[row]
            j = i + 1 + (place - cut[row])
            for shorter in np.unique(sizes[j]).tolist():
                of = sizes[j] == shorter
                b, a, key = names[i[of]], names[j[of]], keys[i[of]]
                d = distance(a, b, shorter, longer, k)
                good = np.flatnonzero((d <= k) & (d >= fewest))
                a, b, d = a[good], b[good], d[good]
                here = first_rest(a, b, shorter, longer, k) == ((key[good] & ((np.uint64(1) << np.uint64(57)) - np.uint64(1))) >> np.uint64(1))
                a, b, d = a[here], b[here], d[here]
                yield np.minimum(a, b), np.maximum(a, b), d, np.full(len(d), longer)


#: Names of up to so many letters are compared by all pairs where they have too many rests.
WIDEST = 24


def cells_of(names: list[str]) -> np.ndarray:
    """Codes of letters, a row for a name, padded with 0."""
    raw = np.array([x.encode("ascii") for x in names], dtype=f"S{WIDEST}").view(np.uint8).reshape(len(names), WIDEST)
    return np.where(raw > 0, raw - np.uint8(96), np.uint8(0)).astype(np.uint8)


def bags(cells: np.ndarray) -> np.ndarray:
    """64 bits: letters there once, twice, and some of them three times."""
    out = np.zeros(len(cells), dtype=np.uint64)
    for c in range(26):
        n = (cells == c + 1).sum(axis=1)
        out |= (n >= 1).astype(np.uint64) << np.uint64(c)
        out |= (n >= 2).astype(np.uint64) << np.uint64(26 + c)
    for bit, c in enumerate("aehinorstlud"):
        out |= ((cells == ord(c) - 96).sum(axis=1) >= 3).astype(np.uint64) << np.uint64(52 + bit)
    return out


def text_of(cells: np.ndarray) -> list[str]:
    raw = np.where(cells > 0, cells + np.uint8(96), 0).astype(np.uint8)
    return [x.decode("ascii") for x in np.ascontiguousarray(raw).view(f"S{WIDEST}").ravel().tolist()]


@functools.lru_cache(maxsize=256)
def read(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of letters and bags of a block, which meets many others."""
    cells = np.frombuffer(raw, dtype=np.uint8).reshape(-1, WIDEST)
    return cells, bags(cells)


def all_pairs(longer: np.ndarray, shorter: np.ndarray, n: int, m: int, least: float, upper: float = 1.0, rows: int = 1 << 16, known: tuple | None = None):
    """(cells, cells, distance) of the alike among all names of n and of m letters; one order only where n is m.

    Letters that one bag has and the other lacks bound the edits from below; the distance of what is left decides.
    Bags (``known``, where they are) meet a few at a time, so that what is counted stays in a processor's cache.
    """
    k, fewest = edits(least, n), fewest_edits(upper, n)
    if k - (n - m) < 0 or not k or fewest > k or not len(longer) or not len(shorter):
        return
    own, other = known or (bags(longer), bags(shorter))
    lacks, step = ~other, max(1, rows // len(other))
    both, gone, near = np.empty((step, len(other)), np.uint64), np.empty((step, len(other)), np.uint8), np.empty((step, len(other)), bool)
    found, met = [], 0
    for low in range(0, len(own), step):
        some = own[low : low + step, None]
        r = len(some)
        np.bitwise_and(some, lacks, out=both[:r])
        np.bitwise_count(both[:r], out=gone[:r])
        np.less_equal(gone[:r], k, out=near[:r])
        flat = np.flatnonzero(near[:r])
        if len(flat):
            i, j = flat // len(other) + low, flat % len(other)
            good = np.bitwise_count(other[j] & ~own[i]) <= k - (n - m)
            found.append((i[good], j[good]))
            met += len(found[-1][0])
        if met >= rows or (met and low + step >= len(own)):
            i, j = (np.concatenate(x) for x in zip(*found))
            found, met = [], 0
            for at in range(0, len(i), rows):
                p, q = longer[i[at : at + rows]], shorter[j[at : at + rows]]
                d = distance_of(np.ascontiguousarray(q.T), np.ascontiguousarray(p.T), m, n, k)
                good = (d <= k) & (d >= fewest)
                p, q, d = p[good], q[good], d[good]
                if len(d):
                    yield p, q, d
