"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

The pairs of parts that can merge wait in a bucket for each merge rank, which holds their positions in a linked list
of parts. A hierarchy of 256-bit words marks the buckets that are not empty; finding the first set bit from the top
gives the next rank. A merge changes at most two neighbours, whose old entries stay in their buckets and are skipped
when they come up. So a pre-token of n bytes takes about n log n steps, however long it is. The pre-tokens that the
cache lacks wait in one queue together, parted by walls, and a rank's bucket is taken at once for all of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOM, _LONG = 600_000, 128
#: Pre-tokens looked up at once, bytes of pre-tokens in one queue.
_SHARE, _QUEUED = 1 << 18, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines "base64-token rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class RankQueue:
    """Positions by rank; the lowest rank comes first, within a rank the lowest position."""

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        size = max(1, ranks)
        while True:
            size = -(-size // 256)
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            word, bit = rank >> 8, 1 << (rank & 255)
            if level[word]:
                level[word] |= bit
                break
            level[word] = bit
            rank = word

    def fill(self, rank: int, positions: list[int]) -> None:
        """Ascending positions of a rank that has none."""
        self.push(rank, positions[0])
        self.buckets[rank] = positions

    def first(self) -> int:
        """The lowest rank that has positions, -1 if none has."""
        if not self.levels[-1][0]:
            return -1
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = (rank << 8) | ((word & -word).bit_length() - 1)
        return rank

    def take(self, rank: int) -> list[int]:
        """The positions of a rank that has some, ascending; none of them stays."""
        at = rank
        for level in self.levels:
            word = at >> 8
            level[word] ^= 1 << (at & 255)
            if level[word]:
                break
            at = word
        return sorted(self.buckets.pop(rank))

    def pop(self) -> tuple[int, int] | None:
        if (rank := self.first()) < 0:
            return None
        bucket = self.buckets[rank]
        if len(bucket) == 1:
            return rank, self.take(rank)[0]
        return rank, heappop(bucket)


class Encoder:
    """Encodes texts by a vocabulary's ranks, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.unknown = max(ranks.values(), default=0) + 1  # a byte that is no token has an id from here on
        self.queue = RankQueue(self.unknown)
        self.cache: dict[str, bytes] = {}
        ids = {bytes([b]): self.unknown + b for b in range(256)} | ranks
        self.bytes = np.array([*(ids[bytes([b])] for b in range(256)), -1])
        self.start = np.full((257, 257), -1, np.int32)
        #: By a part's id, the ranks at which it merges with a part on its right, on its left.
        self.right: dict[int, dict[int, int]] = {}
        self.left: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) == 2:
                self.start[token[0], token[1]] = rank
            for i in range(1, len(token)):
                if (a := ids.get(token[:i])) is not None and (b := ids.get(token[i:])) is not None:
                    self.right.setdefault(a, {})[b] = rank
                    self.left.setdefault(b, {})[a] = rank

    def merged(self, raw: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token, merged in one queue; KeyError if the vocabulary lacks a byte that is left."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size + 1)  # walls stand at 0 and at these places
        byte = np.full(ends[-1] + 1, 256, np.uint16)
        known = np.ones(len(byte), bool)
        known[0], known[ends] = False, False
        byte[known] = np.frombuffer(b"".join(raw), np.uint8)
        rank = self.start[byte[:-1], byte[1:]]
        parts, waits = self.bytes[byte].tolist(), [*rank.tolist(), -1]
        self._fill(rank)
        self._merge(parts, waits)
        ids = np.array(parts)
        if ids.max() >= self.unknown:
            raise KeyError(bytes([int(ids.max()) - self.unknown]))
        left = ids >= 0
        cut = (4 * np.cumsum(left)[ends]).tolist()
        packed = ids[left].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *cut], cut)]

    def _fill(self, rank: np.ndarray) -> None:
        """The pairs of bytes that can merge."""
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[at], prepend=-1, append=-1)).tolist()
        for a, b in zip(cut, cut[1:]):
            self.queue.fill(int(rank[at[a]]), at[a:b].tolist())

    def _merge(self, parts: list[int], waits: list[int | None]) -> None:
        """Merges until no pair is left; a wall is -1 among ``parts``, what a part has taken in becomes -2.

        ``waits`` is the rank at which a part merges with the next. The merged part's id is the rank.
        """
        queue = self.queue
        buckets, push = queue.buckets, queue.push
        places = list(range(len(parts) + 1))
        after, before = places[1:], [-1, *places[:-2]]
        while (rank := queue.first()) >= 0:
            right, left = self.right.get(rank, {}).get, self.left.get(rank, {}).get
            positions = queue.take(rank)
            lowest = rank
            for n, i in enumerate(positions):
                if waits[i] != rank:
                    continue  # stale
                j = after[i]
                after[i] = k = after[j]
                before[k] = i
                parts[i], parts[j], waits[j] = rank, -2, None
                waits[i] = r = right(parts[k])
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        push(r, i)
                        lowest = min(r, lowest)
                i = before[i]
                waits[i] = r = left(parts[i])
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        push(r, i)
                        lowest = min(r, lowest)
                if lowest < rank:  # in such a vocabulary it goes first
                    if n + 1 < len(positions):
                        queue.fill(rank, positions[n + 1 :])
                    break

    def learn(self, pieces: set[str]) -> list[str]:
        """Puts the pieces into the cache, which is emptied first if they don't fit; those too long to stay."""
        fresh = pieces.difference(self.cache)
        if len(self.cache) + len(fresh) > _ROOM:
            self.cache.clear()
            fresh = pieces
        held, raw, size = [], [], 0
        for piece in fresh:
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
                continue
            held.append(piece)
            raw.append(data)
            size += len(data)
            if size >= _QUEUED:
                self.cache.update(zip(held, self.merged(raw)))
                held, raw, size = [], [], 0
        if held:
            self.cache.update(zip(held, self.merged(raw)))
        return [p for p in fresh if len(p) > _LONG]

    def packed(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids: list[list[bytes]] = []
        held: list[tuple[int, list[str]]] = []
        count = 0

        def look_up() -> None:
            long = self.learn(set().union(*(p for _, p in held)))
            for i, p in held:
                ids[i].append(b"".join(map(self.cache.__getitem__, p)))
            for p in long:
                del self.cache[p]
            held.clear()

        for text in texts:
            pieces = self.pieces(text)
            ids.append([])
            for at in range(0, len(pieces), _SHARE):
                held.append((len(ids) - 1, pieces[at : at + _SHARE]))
                count += len(held[-1][1])
                if count >= _SHARE:
                    look_up()
                    count = 0
        look_up()
        return [b"".join(i) for i in ids]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def _encoder(packed: bytes, pattern: str) -> Encoder:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}
    return Encoder(ranks, pattern)


def _packed(path: str) -> bytes:
    """The vocabulary as it goes to the tasks, of the size of the file."""
    return b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in read_ranks(path).items())


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", *, decoded: bool = False) -> DataFrame:
    """``(id, n_tokens, ids)``; ``ids`` holds little-endian unsigned 32-bit integers. Null texts count as empty.

    ``decoded`` adds the bytes that the ids stand for, decoded from them in the same pass.
    """
    packed = docs.sparkSession.sparkContext.broadcast(_packed(path))
    names = ["id", "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(packed.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = encoder.packed(t.as_py() or "" for t in batch.column(1))
                columns = [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([encoder.decode(np.frombuffer(i, "<u4").tolist()) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes its ids stand for; a null stays null. An unknown id is an error."""
    packed = encoded.sparkSession.sparkContext.broadcast(_packed(path))
    names = [c for c in encoded.columns if c != "decoded"]
    place = names.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _encoder(packed.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [None if v.as_py() is None else decoder.decode(np.frombuffer(v.as_py(), "<u4").tolist()) for v in batch.column(place)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*names, "decoded"])

    kept = encoded.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))
