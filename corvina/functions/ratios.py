"""Ratcliff-Obershelp ratios of texts as difflib has them, with exact upper bounds that spare most of the work."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np

#: From so many characters on difflib begins no match at characters that make up more than a hundredth of the second text.
LONG = 200
#: Runs of so many characters that may begin a match are looked for box by box, shorter ones by an index of the whole texts.
RUN = 32


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel; what matches in blocks can't be more."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & masks.get(c, 0)
        rest = (rest + hit) | (rest - hit)
    return len(a) - (rest & full).bit_count()


def codes(text: str, size: int) -> bytes:
    """The first ``size`` code points plus one, for ``subsequences``; zeros behind a shorter text."""
    return (np.frombuffer(text[:size].encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)).tobytes().ljust(4 * size, b"\0")


def subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``subsequence`` of each row of two arrays of up to 62 ``codes``."""
    size = a.shape[1]
    width, kind = (32, np.uint32) if size < 31 else (64, np.uint64)
    wide = np.zeros((len(a), width), np.uint32)
    wide[:, :size] = a
    full = kind((1 << size) - 1)
    rest = np.full(len(a), full)
    for k in np.flatnonzero(b.any(axis=0)):
        own = np.packbits(wide == b[:, k, None], axis=1, bitorder="little").view(f"<u{width // 8}")[:, 0] * (b[:, k] != 0)
        hit = rest & own.astype(kind)
        rest = ((rest + hit) | (rest - hit)) & full
    return size - np.bitwise_count(rest).astype(np.int64)


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters each row of an array of ``codes`` has in common with each row of another, whatever their order: a
    product of matrices whose columns say that a text has a letter k times at least."""
    codes_ = np.concatenate((a, b))
    letters, place = np.unique(codes_, return_inverse=True)
    n = np.bincount((np.arange(len(codes_))[:, None] * len(letters) + place.reshape(codes_.shape)).ravel(), minlength=len(codes_) * len(letters)).reshape(-1, len(letters))
    n = n[:, letters != 0]
    has = np.concatenate([(n[:, n.max(axis=0) >= k] >= k).astype(np.float32) for k in range(1, int(n.max(initial=1)) + 1)], axis=1)
    return has[: len(a)] @ has[len(a) :].T


def letter_counts(text: str, size: int) -> bytes:
    """Numbers of a text's characters, dealt out over ``size`` bins: the sum of two texts' lesser ones is no less than what can match."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(points % size, minlength=size).astype("<u4").tobytes()


def _longest(a: str, b: str, at: list[int], places: dict[str, list[int]], box: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """difflib's longest match inside a box: of runs of characters that may begin one, widened by any equal ones."""
    alo, ahi, blo, bhi = box
    best_i, best_j, size, before, last = alo, blo, 0, {}, -2
    for n in range(bisect_left(at, alo), bisect_left(at, ahi)):
        i = at[n]
        if i != last + 1:
            before = {}
        found, own = {}, places[a[i]]
        for m in range(bisect_left(own, blo), bisect_left(own, bhi)):
            j = own[m]
            found[j] = k = before.get(j - 1, 0) + 1
            if k > size:
                best_i, best_j, size = i - k + 1, j - k + 1, k
        before, last = found, i
    return _widened(a, b, box, best_i, best_j, size)


class _Runs:
    """Where two texts share runs of ``size`` characters that may begin a match, of all sizes below RUN."""

    def __init__(self, a: str, b: str, may_begin: tuple[np.ndarray, np.ndarray]):
        self.texts, self.known = (a, b), {}
        self.starts, self.lengths = zip(*map(_run_lengths, may_begin), strict=True)
        self.most = min(int(n.max(initial=0)) for n in self.lengths)

    def _at(self, size: int) -> tuple[list[int], dict[str, list[int]]]:
        if size not in self.known:
            (a, b), (in_a, in_b) = self.texts, (at[n >= size].tolist() for at, n in zip(self.starts, self.lengths, strict=True))
            own: dict[str, list[int]] = {}
            for j in in_b:
                own.setdefault(b[j : j + size], []).append(j)
            self.known[size] = [i for i in in_a if a[i : i + size] in own], own
        return self.known[size]

    def first(self, size: int, box: tuple[int, int, int, int]) -> tuple[int, int] | None:
        """The first place in a, and of those in b, of a shared run inside a box."""
        alo, ahi, blo, bhi = box
        at, own = self._at(size)
        for n in range(bisect_left(at, alo), bisect_left(at, ahi - size + 1)):
            places = own[self.texts[0][at[n] : at[n] + size]]
            k = bisect_left(places, blo)
            if k < len(places) and places[k] + size <= bhi:
                return at[n], places[k]
        return None

    def places(self) -> tuple[list[int], dict[str, list[int]]]:
        """The places in a and b of single characters."""
        if 0 not in self.known:
            own: dict[str, list[int]] = {}
            for j in self.starts[1].tolist():
                own.setdefault(self.texts[1][j], []).append(j)
            self.known[0] = self.starts[0].tolist(), own
        return self.known[0]


def _run_lengths(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that are marked, and how many from each on are marked without a gap."""
    at = np.flatnonzero(marked)
    last = np.flatnonzero(np.append(np.diff(at) != 1, True)) if len(at) else at
    return at, at[last[np.searchsorted(last, np.arange(len(at)))]] - at + 1


def _widened(a: str, b: str, box: tuple[int, int, int, int], i: int, j: int, size: int) -> tuple[int, int, int]:
    alo, ahi, blo, bhi = box
    while i > alo and j > blo and a[i - 1] == b[j - 1]:
        i, j, size = i - 1, j - 1, size + 1
    while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
        size += 1
    return i, j, size


def ratio_from(a: str, b: str, least: float) -> float | None:
    """``SequenceMatcher(None, a, b).ratio()`` if it is ``least`` or more. What is left over can't match more than its
    shorter side, so most pairs that stay below are given up early.

    The longest match of a box is the first of its longest shared runs of characters that may begin one. A part of a box has
    none longer than the box, so each size is looked for about once at each place, and long texts cost little more than
    their length."""
    total = len(a) + len(b)
    if not total:
        return 1.0 if least <= 1.0 else None
    if 2.0 * min(len(a), len(b)) / total < least:
        return None
    if total < 4 * LONG and 2.0 * subsequence(a, b) / total < least:
        return None
    if len(b) < LONG:
        places: dict[str, list[int]] = {}
        for j, c in enumerate(b):
            places.setdefault(c, []).append(j)
        at = [i for i, c in enumerate(a) if c in places]
        return _matched(a, b, least, lambda box, most: (*_longest(a, b, at, places, box), most), 1)
    points = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), "<u4")
    if points.max() >= 1 << 12:
        points = np.unique(points, return_inverse=True)[1]
    points = points[: len(a)], points[len(a) :]
    counts = [np.bincount(p, minlength=1 + int(max(p.max(initial=0) for p in points))) for p in points]
    if 2.0 * int(np.minimum(*counts).sum()) / total < least:
        return None
    may_begin = (counts[1] > 0) & (counts[1] <= len(b) // 100 + 1)
    runs = _Runs(a, b, tuple(may_begin[p] for p in points))

    def longest(box: tuple[int, int, int, int], most: int) -> tuple[int, int, int, int]:
        found = None
        while most and (found := runs.first(most, box)) is None:
            most -= 1
        if most == RUN:
            return *_longest(a, b, *runs.places(), box), most
        return *_widened(a, b, box, *(found or (box[0], box[2])), most), most

    return _matched(a, b, least, longest, min(runs.most, RUN))


def _matched(a: str, b: str, least: float, longest: Callable, most: int) -> float | None:
    """The ratio by the ``longest`` match of a box, given what bounds it, and then those of what is left of it on both sides."""
    total = len(a) + len(b)
    boxes, matched, possible = [(0, len(a), 0, len(b), most)], 0, min(len(a), len(b))
    while boxes:
        if 2.0 * possible / total < least:
            return None
        alo, ahi, blo, bhi, most = boxes.pop()
        possible -= min(ahi - alo, bhi - blo)
        i, j, size, most = longest((alo, ahi, blo, bhi), most)
        if size:
            matched, possible = matched + size, possible + size
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    boxes.append((*part, most))
                    possible += min(part[1] - part[0], part[3] - part[2])
    found = 2.0 * matched / total
    return found if found >= least else None
