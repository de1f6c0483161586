"""Elias-Fano sequences: sorted 64-bit numbers in little more than log2(universe / n) bits each.

A number's low bits are packed one after another; its high bits are written in unary, as a bit at place
``high + index``. Look-ups are vectorised: a search halves the bounds that it is given, all look-ups at a time, and
reads the sequence by random access; when many numbers are looked up at once, decoding it first is the cheaper way.
"""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(64)
#: A sequence is decoded as a whole for at least one look-up in so many numbers.
_DENSE = 24


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, one after another, in words of 64 bits and one word more."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, np.uint64)
    if not bits or not n:
        return out
    low = values & np.uint64((1 << bits) - 1)
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at // _WORD).astype(np.int64), at % _WORD
    head = low << shift
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(head, first)
    over = np.flatnonzero(shift + np.uint64(bits) > _WORD)  # what a word has no room for begins the next one
    out[word[over] + 1] |= low[over] >> (_WORD - shift[over])
    return out


class EliasFano:
    """Over arrays that may be memory-mapped: ``low`` bits, ``high`` words, ``ones`` before each word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        """Header and arrays of a sorted array of uint64."""
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros(-(-(n + (most >> bits) + 1) // 64) * 64, np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        counts = np.bitwise_count(high).astype(np.uint64)
        return {"n": n, "bits": bits}, {"low": _packed(values, bits), "high": high, "ones": np.concatenate([[np.uint64(0)], counts.cumsum(dtype=np.uint64)])}

    def lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits at places ``i``."""
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at // _WORD).astype(np.int64), at % _WORD
        # a shift by 64 is undefined, so the next word is moved in two steps
        both = (self.low[word] >> shift) | (self.low[word + 1] << np.uint64(1) << (np.uint64(63) - shift))
        return both & np.uint64((1 << self.bits) - 1)

    def decode(self) -> np.ndarray:
        flags = np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little")
        place = np.arange(self.n)
        return ((np.flatnonzero(flags) - place).astype(np.uint64) << np.uint64(self.bits)) | self.lows(place)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th one or zero, from 0."""
        before = self.ones if one else np.arange(len(self.ones), dtype=np.uint64) * _WORD - self.ones
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), 1 << 13):
            part = k[at : at + (1 << 13)]
            word = np.searchsorted(before, part.astype(np.uint64), "right") - 1
            bits = self.high[word]
            flags = np.unpackbits(np.ascontiguousarray(bits if one else ~bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = part - before[word].astype(np.int64)
            out[at : at + (1 << 13)] = word * 64 + (flags.cumsum(1, dtype=np.uint8) == (inside + 1)[:, None]).argmax(1)
        return out

    def dense(self, look_ups: int) -> bool:
        """Whether so many look-ups are worth decoding the sequence."""
        return look_ups * _DENSE >= self.n

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        if self.dense(len(i)):
            return self.decode()[i]
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self.lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, the first of equal ones; -1 where it isn't there."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        if self.dense(len(values)):
            all_ = self.decode()
            at = np.minimum(np.searchsorted(all_, values), self.n - 1)
            return np.where(all_[at] == values, at, -1)
        out = np.full(len(values), -1, np.int64)
        zeros = len(self.high) * 64 - self.n  # of which the last ones may be padding
        top = values >> np.uint64(self.bits)
        k = np.flatnonzero(top < np.uint64(zeros))
        h = top[k].astype(np.int64)
        start = np.zeros(len(k), np.int64)
        inner = h > 0
        start[inner] = self._select(h[inner] - 1, False) - (h[inner] - 1)
        # numbers of equal high bits lie between two zeros and are told apart by their low bits
        out[k] = _halve(self.lows, values[k] & np.uint64((1 << self.bits) - 1), start, self._select(h, False) - h)
        return out

    def within(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each value among the places from ``lo`` on and before ``hi``; -1 where it isn't there."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        if self.dense(len(values)):
            all_ = self.decode()
            return _halve(all_.__getitem__, values, lo, hi)
        return _halve(self.get, values, lo, hi)


def _halve(read, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first place from ``lo`` on and before ``hi`` where ``read`` gives the value, by halving all bounds at a time."""
    out = np.full(len(values), -1, np.int64)
    low, high = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = read(middle) < values[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    k = np.flatnonzero(low < hi)
    k = k[read(low[k]) == values[k]]
    out[k] = low[k]
    return out
