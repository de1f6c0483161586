"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosines.

Each of ``tables`` hashes a normalised vector by ``width`` random projections, shifted and cut into cells; vectors
in the same cells share a bucket. With 12 projections, cells of 2 and 48 tables, a pair at cosine 0.9 (distance
0.447) meets in at least one table with probability 0.991, one at 0.95 with 0.9999.

Equal vectors are one node with a number of copies. Buckets are compared in blocks, by matrix products in double
precision; a block tells for each vector how many it links to and its component there, never pairs, and counts a
pair only in the first table in which both share a bucket. A large bucket is split in blocks over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import components, settle, whole_groups
from .words import mix

THRESHOLD, TABLES, WIDTH, CELL, BLOCK = 0.9, 48, 12, 2.0, 512
#: Groups of at most so many vectors are compared many at a time.
_SMALL = 64


class Hashes:
    """Bucket keys of unit vectors, by dimension; the same in every task."""

    def __init__(self, tables: int, width: int, cell: float, seed: int = 17):
        self.tables, self.width, self.cell, self.seed = tables, width, cell, seed
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One signed 64-bit key a vector and table; the table and the dimension are part of the key."""
        size = unit.shape[1]
        if size not in self.planes:
            r = np.random.default_rng([self.seed, size])
            n = self.tables * self.width
            self.planes[size] = r.normal(size=(size, n)), r.uniform(0, self.cell, n)
        a, b = self.planes[size]
        cells = np.floor((unit @ a + b) / self.cell).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.width)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size), cells.shape[:2]).copy()
            for i in range(self.width):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return key.view(np.int64)


def _vectors(column, dtype) -> list[np.ndarray | None]:
    """The usable vectors: not null, no null or non-finite component, not zero."""
    out = []
    for v in column:
        v = v.values if v.is_valid else None
        if v is None or not len(v) or v.null_count:
            out.append(None)
            continue
        v = v.to_numpy(zero_copy_only=False).astype(dtype)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def _unit(raw: list[bytes], dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linked(unit: np.ndarray, cuts: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with at least the threshold's cosine, in each group between two cuts.

    Groups of one small size are one stack of matrix products; a larger one, or one of two blocks, is a product by itself.
    """
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    start, size = cuts[:-1], np.diff(cuts)
    small = (low[start] == high[start]) & (size <= _SMALL)
    for n in np.unique(size[small & (size > 1)]):
        at = start[small & (size == n)][:, None] + np.arange(n)
        x = unit[at]
        g, i, j = np.nonzero((x @ x.transpose(0, 2, 1) >= threshold) & np.tri(n, k=-1, dtype=bool))
        first.append(at[g, i])
        second.append(at[g, j])
    for a, n in zip(start[~small], size[~small]):
        mine = block[a : a + n]
        left, right = a + np.flatnonzero(mine == low[a]), a + np.flatnonzero(mine == high[a])
        near = unit[left] @ unit[right].T >= threshold
        if low[a] == high[a]:
            near &= np.tri(len(left), k=-1, dtype=bool)
        i, j = np.nonzero(near)
        first.append(left[i])
        second.append(right[j])
    return np.concatenate(first), np.concatenate(second)


def _first_met(hashes: Hashes, unit: np.ndarray, bucket: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share no bucket of a table before that of the bucket in which they were found."""
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys = hashes.keys(unit[used])
    p, q = place[: len(i)], place[len(i) :]
    new = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        s = slice(at, at + (1 << 15))
        mine = keys[p[s]]
        new[s] = (mine == keys[q[s]]).argmax(1) == (mine == bucket[i[s], None]).argmax(1)
    return new


def _blocks(dtype, hashes: Hashes, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches, ["bucket", "low", "high"]):
            node, copies, block, low, high, bucket = (t[c].to_numpy() for c in ("node", "copies", "block", "low", "high", "bucket"))
            raw = t["vector"].to_pylist()
            lengths = np.array([len(r) for r in raw])
            first, second = [], []
            for length in np.unique(lengths):  # a bucket holds vectors of one dimension
                k = np.flatnonzero(lengths == length)
                unit = _unit([raw[x] for x in k], dtype)
                i, j = _linked(unit, np.unique(np.searchsorted(k, cuts)), block[k], low[k], high[k], threshold)
                if len(i):
                    new = _first_met(hashes, unit, bucket[k], i, j)
                    first.append(k[i[new]])
                    second.append(k[j[new]])
            if not first:
                continue
            i, j = np.concatenate(first), np.concatenate(second)
            n = np.zeros(t.num_rows, np.int64)
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            label = node.copy()
            while True:  # the smallest node of each component of these blocks
                before = label.copy()
                low_ = np.minimum(label[i], label[j])
                np.minimum.at(label, i, low_)
                np.minimum.at(label, j, low_)
                if (label == before).all():
                    break
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(n[k]), pa.array(label[k])], ["node", "n", "low"])

    return run


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, threshold: float = THRESHOLD, tables: int = TABLES, width: int = WIDTH, cell: float = CELL, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row.

    Vectors of at least the threshold's cosine in double precision are linked if they meet in a table; none below
    it are. ``n_links`` counts the other rows linked directly, copies included. Vectors that are null, empty or
    zero, hold a null or a value that is not finite, and rows with a null id link with nothing: no links, their
    own component, kept. Vectors of different dimensions never link. Repeated ids are
    separate rows, each linked by its own vector. Columns other than the two named are not read.
    """
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    dtype = np.dtype("<f4" if single else "<f8")
    hashes = Hashes(tables, width, cell)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if v is None else v.tobytes() for v in _vectors(batch.column(1), dtype)]
            keys = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "vector"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                raw = batch.column(1).to_pylist()
                for size in sorted({len(r) for r in raw}):
                    k = [i for i, r in enumerate(raw) if len(r) == size]
                    keys = hashes.keys(_unit([raw[i] for i in k], dtype))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), flat], ["node", "buckets"])

    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>" if single else "array<double>").alias("vector"))
    packed = settle(rows.mapInArrow(pack, "id long, key binary, vector binary"))
    usable = packed.where("key IS NOT NULL AND id IS NOT NULL")
    nodes = usable.groupBy("key", "vector").agg(F.min("id").alias("smallest"), F.count("*").alias("copies"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    met = settle(nodes.select("node", "vector").mapInArrow(sketch, "node long, buckets array<long>").select("node", F.explode("buckets").alias("bucket")))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = met.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    dealt = shared.select("bucket", "node", "block", F.explode(pairs).alias("p")).select("bucket", "p.low", "p.high", "block", "node").join(nodes.select("node", "vector", "copies"), "node")
    dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = settle(dealt.mapInArrow(_blocks(dtype, hashes, threshold), "node long, n long, low long").groupBy("node", "low").agg(F.sum("n").alias("n")))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    ends = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    told = nodes.select("key", "node", "copies", "smallest").join(links, "node", "left").join(ends, "node", "left")
    told = settle(told.select("key", "smallest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    names = told.groupBy("component").agg(F.min("smallest").alias("component_id"))
    told = told.join(names, "component").select("key", "n_links", "component_id")
    out = packed.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(told, "key", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
