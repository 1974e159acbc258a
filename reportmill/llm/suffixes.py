"""Suffix sorting by hash comparison, over numpy arrays of bytes.

Prefix polynomial hashes modulo 2**64 give the hash of any substring in one step, so the common extension of two suffixes is found
by binary search: a comparison takes a logarithmic number of hash tests. Sorting starts from numpy's stable merge of the first
eight bytes; suffixes that share them are merged bottom-up by hash comparison, all pairs of runs of a round at once. Common
extensions of neighbours are then verified byte by byte; a false one, which takes a hash collision, sends the whole set to a
plain sort.
"""

from __future__ import annotations

import numpy as np

# An odd base, its inverse modulo 2**64, and the multipliers of the final mix.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_HEAD = 8
_CHECKED = 1 << 20  # bytes that are verified together
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, count: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < count:
        held = np.full(max(count, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if count <= 1 << 23:
            _powers[base] = held
    return held[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits."""
    out = values ^ (values >> np.uint64(33))
    out *= _MIX[0]
    out ^= out >> np.uint64(33)
    out *= _MIX[1]
    out ^= out >> np.uint64(33)
    return out


class Hashed:
    """Bytes with their prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.add(data, np.uint64(1), out=self.prefix[1:], dtype=np.uint64, casting="unsafe")
        self.prefix[1:] *= _power_table(_BASE, n)
        np.cumsum(self.prefix, out=self.prefix)
        self.shift = _power_table(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        """Hashes of substrings, unmixed."""
        return (self.prefix[starts + lengths] - self.prefix[starts]) * self.shift[starts]

    def windows(self, size: int) -> np.ndarray:
        """Mixed hashes of all substrings of one size."""
        return mix((self.prefix[size:] - self.prefix[:-size]) * self.shift[: len(self.prefix) - size])

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes at ``a`` and ``b``, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) >> 1
            same = self.of(a[open_], middle) == self.of(b[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of many intervals, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _heads(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first bytes of each suffix as one number; places beyond its end are zero."""
    padded = np.concatenate([data, np.zeros(_HEAD, np.uint8)])
    out = np.zeros(len(starts), np.uint64)
    for i in range(_HEAD):
        out = (out << np.uint64(8)) | np.where(lengths > i, padded[starts + i], 0).astype(np.uint64)
    return out


def _merge_ties(text: Hashed, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sorts within segments [first, first + size) of ``order``, bottom-up."""
    whole = text.of(starts, lengths)

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        at = np.flatnonzero((whole[a] != whole[b]) | (lengths[a] != lengths[b]))
        a, b = a[at], b[at]
        shortest = np.minimum(lengths[a], lengths[b])
        same = text.common(starts[a], starts[b], shortest)
        ended = same == shortest
        safe = np.where(ended, 0, same)
        out[at] = np.where(ended, lengths[a] < lengths[b], text.data[starts[a] + safe] < text.data[starts[b] + safe])
        return out

    width = 1
    first, size = first[size > 1], size[size > 1]
    while len(first):
        place = spread(first, size)
        begin, total = np.repeat(first, size), np.repeat(size, size)
        local = place - begin
        block = local // width * width
        other = np.where((local // width) & 1 == 1, block - width, block + width)
        moving = np.flatnonzero(other < total)
        low, high = other[moving], np.minimum(other[moving] + width, total[moving])
        right = other[moving] < block[moving]
        start, mine, origin = low.copy(), order[place[moving]], begin[moving]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            theirs, own, late = order[origin[open_] + middle], mine[open_], right[open_]
            # An element of the right run comes after its equals of the left run.
            swapped = less(np.where(late, own, theirs), np.where(late, theirs, own))
            up = np.where(late, ~swapped, swapped)
            low[open_] = np.where(up, middle + 1, low[open_])
            high[open_] = np.where(up, high[open_], middle)
        to = origin + np.minimum(block[moving], other[moving]) + (local[moving] - block[moving]) + (low - start)
        order = order.copy()
        order[to] = mine
        width *= 2
        first, size = first[size > width], size[size > width]
    return order


def suffix_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted order of the given substrings, and how much each has in common with the one before it."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, heads = Hashed(data), _heads(data, starts, lengths)
    order = np.argsort(heads, kind="stable")
    ranked = heads[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    order = _merge_ties(text, order, starts, lengths, first, np.diff(np.append(first, len(order))))
    a, b = order[:-1], order[1:]
    common = np.concatenate([[0], text.common(starts[a], starts[b], np.minimum(lengths[a], lengths[b]))])
    if not _equal(data, starts[a], starts[b], common[1:]):
        return _plain_sort(data, starts, lengths)
    return order, common


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether substrings that start at ``a`` and ``b`` are equal, byte by byte; a bounded number of bytes is looked at together."""
    step = np.cumsum(lengths) // _CHECKED
    for part in np.split(np.arange(len(a)), np.flatnonzero(step[1:] != step[:-1]) + 1) if len(a) else ():
        if (data[spread(a[part], lengths[part])] != data[spread(b[part], lengths[part])]).any():
            return False
    return True


def _plain_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    texts = [data[s : s + n].tobytes() for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    order = sorted(range(len(texts)), key=texts.__getitem__)
    common = [0]
    for i, j in zip(order, order[1:], strict=False):
        a, b = np.frombuffer(texts[i], np.uint8), np.frombuffer(texts[j], np.uint8)
        most = min(len(a), len(b))
        differ = np.flatnonzero(a[:most] != b[:most])
        common.append(int(differ[0]) if len(differ) else most)
    return np.array(order, np.int64), np.array(common, np.int64)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least value of each window, by doubling."""
    if len(values) < size:
        return values[:0]
    out, width = values, 1
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out
