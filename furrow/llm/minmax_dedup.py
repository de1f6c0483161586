"""Near-duplicate documents by min-max hashing: bands find candidates, full shingle sets confirm every link.

Both the minimum and the maximum under each permutation are kept, so a signature of 252 values takes 126 hash
evaluations of each shingle. 36 bands of 7 values miss a pair at similarity 0.85 with probability 1e-6 and one
at 0.8 with 2e-4.

1. Documents of equal shingle sets are one node (the smallest id), whatever their number.
2. In each bucket every node is compared with the bucket's smallest node: a number of pairs linear in the bucket.
3. Where a bucket still holds several components, its nodes are compared in blocks, by their whole signatures and
   only across components; pairs whose estimate lies over four standard errors below the threshold are left out,
   the others are confirmed on the full sets. A large bucket is split in blocks over many tasks.
4. Components of all confirmed links, by repeated minima; no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .fingerprints import shingle_sets, verified
from .spark import components, groups, settle

WIDTH, BANDS, ROWS, BLOCK = 5, 36, 7, 256


def sketches(docs: DataFrame, id_column: str, text_column: str, *, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, n_shingles, set_key binary, bands array<long>, short binary)``; ``short`` has 16 bits of each value."""
    if bands * rows % 2:
        raise ValueError("a min-max signature has an even number of values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = words.Permutations(bands * rows // 2)
        for batch in batches:
            sizes, keys, banded, short = [], [], [], []
            for text in batch.column(1):
                s = words.distinct(words.shingles(text.as_py(), width))
                sizes.append(len(s))
                keys.append(words.set_key(s))
                signature = np.stack(perms.extremes(s), 1).ravel()
                banded.append(words.band_keys(signature, bands) if len(s) else np.empty(0, np.int64))
                short.append((words.mix(signature) >> np.uint64(48)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                ["id", "n_shingles", "set_key", "bands", "short"],
            )

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return texts.mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>, short binary")


def _across(threshold: float, bands: int, rows: int):
    """Pairs of a block pair, in different components, that are alike enough by their signatures; each pair is
    told only in the first band that both share."""
    n_values = bands * rows
    least = threshold - 4 * (threshold * (1 - threshold) / n_values) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["bucket", "low", "high"]):
            low, high = t["low"][0].as_py(), t["high"][0].as_py()
            ids, component, block = (t[c].to_numpy() for c in ("node", "component", "block"))
            short = np.frombuffer(b"".join(t["short"].to_pylist()), np.uint16).reshape(len(ids), -1)
            banded = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            band = int(np.flatnonzero(banded[0] == t["bucket"][0].as_py())[0])
            a, b = short[left], short[right]
            if len(left) * len(right) <= 2048:
                same = (a[:, None, :] == b[None, :, :]).sum(2)
            else:
                same = np.zeros((len(left), len(right)), np.uint16)
                for k in range(n_values):
                    same += a[:, k, None] == b[None, :, k]
            hit = (same >= least * n_values) & (component[left][:, None] != component[right][None, :])
            if low == high:
                hit &= np.tri(len(left), k=-1, dtype=bool)
            i, j = np.nonzero(hit)
            i, j = left[i], right[j]
            new = ~(banded[i, :band] == banded[j, :band]).any(1)
            i, j = ids[i[new]], ids[j[new]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    return run


def near_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, percent: int = 80, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Links are pairs with ``100 * intersection >= percent * union`` of the distinct shingles; ``component_id`` is
    the smallest id that links reach, ``kept`` marks the row that carries it. A text with fewer words than
    ``width`` is one shingle; null and wordless texts have none and link with nothing. Rows that repeat an id
    are linked by their own texts, and sets with the same smallest id count as one node. A row with a null id links with nothing, has a null component
    and is kept. Columns other than the two named are not read.
    """
    shaped = settle(sketches(docs, id_column, text_column, width=width, bands=bands, rows=rows))
    sets = shaped.where("n_shingles > 0 AND id IS NOT NULL")
    node = sets.groupBy("set_key").agg(F.min("id").alias("node"))
    member = settle(sets.select("id", "set_key", F.explode("bands").alias("bucket")).groupBy("bucket", "set_key").agg(F.min("id").alias("node")).drop("set_key"))
    leader = settle(member.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"))
    shared = settle(member.join(leader, "bucket").select("bucket", "a", "n", "node"))
    stars = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()

    # all that can be in a pair of either step; so texts move once
    full = settle(shingle_sets(docs, shared.select("node").distinct(), id_column, text_column, width).distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        return verified(pairs, full).where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")

    links = settle(linked(settle(stars)))
    found = settle(components(links))
    marked = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = marked.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    rest = settle(marked.join(mixed, "bucket").select("bucket", "node", "component", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dressed = rest.join(sets.select(F.col("id").alias("node"), "bands", "short"), "node").where("array_contains(bands, bucket)")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    blocked = dressed.withColumn("block", mine).select("bucket", "node", "component", "block", "bands", "short", F.explode(pairs).alias("p")).select("bucket", "p.low", "p.high", "block", "node", "component", "bands", "short")
    blocked = blocked.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    more = settle(blocked.mapInArrow(_across(percent / 100, bands, rows), "a long, b long").distinct())
    more = settle(linked(more))
    ends = components(links.union(more))
    named = node.join(ends, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = shaped.join(named, "set_key", "left").select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
