"""Words, shingles and MinHash signatures shared by the near-duplicate operators.

A text is lower-cased in A-Z only and split at ASCII white space; both are done on its UTF-8 bytes, so no text
is decoded. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1


#: Bytes that part words, the fold of A-Z and a random 64-bit value for each byte value.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD]
_BASE = 0x5851F42D4C957F2D
#: Words of more bytes are hashed one by one, since sums of powers modulo 2**64 are weak over long runs.
_LONG = 64


class _Powers:
    """Powers of the base and of its inverse, grown to the longest text seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x))]).cumprod(dtype=np.uint64)
                    for x in (_BASE, pow(_BASE, -1, 1 << 64))
                )


_powers = _Powers()


def word_hashes(text: bytes | None) -> np.ndarray:
    """64 bits for each word of the text, in order, from sums of byte values times powers of an odd base."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    np.take(_BLANK, raw, out=blank[1:-1])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    _powers.reach(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _powers.up[: len(raw)], out=total[1:])
        h = mix((total[end] - total[start]) * _powers.down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]].lower())
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """64-bit hashes of the text's word shingles, in order, repeats kept.

    A text of fewer than ``width`` words gives one shingle, the whole sequence; one without words gives none.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    step = np.uint64(0x9E3779B97F4A7C15)
    n = max(1, len(h) - width + 1)
    last = min(width, len(h))
    with np.errstate(over="ignore"):
        s = np.full(n, np.uint64(last))
        for i in range(last):
            s = s * step + h[i : i + n]
        return mix(s)


class Permutations:
    """``count`` hashes ``a * x + b`` modulo 2**64 with odd ``a``, each a permutation of the 64-bit values."""

    def __init__(self, count: int, seed: int = 20240229):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 63, count, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, count, dtype=np.uint64)[:, None]
        self.step = max(64, 49152 // max(1, count))
        self.room = np.empty((count, self.step), np.uint64)

    def lowest(self, x: np.ndarray) -> np.ndarray:
        """The minimum under each permutation; all ones for an empty set."""
        low = np.full(len(self.a), MASK, np.uint64)
        for hashed in self._blocks(x):
            np.minimum(low, hashed.min(1), out=low)
        return low

    def extremes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The minimum and the maximum under each permutation."""
        low, high = np.full(len(self.a), MASK, np.uint64), np.zeros(len(self.a), np.uint64)
        for hashed in self._blocks(x):
            np.minimum(low, hashed.min(1), out=low)
            np.maximum(high, hashed.max(1), out=high)
        return low, high

    def _blocks(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            for i in range(0, len(x), self.step):
                part = x[None, i : i + self.step]
                room = self.room[:, : part.shape[1]]
                np.multiply(self.a, part, out=room)
                np.add(room, self.b, out=room)
                yield room


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key a band; the band's number is part of the key."""
    rows = signature.reshape(bands, -1)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(rows.shape[1]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        return key.view(np.int64)


def set_key(distinct: np.ndarray) -> bytes:
    """128 bits that name a sorted set of shingles."""
    return xxhash.xxh3_128_digest(distinct.tobytes())


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
