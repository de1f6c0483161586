"""Document fingerprints: MinHash over word shingles, bands joined in Spark, Jaccard verified on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .spark import settle

WIDTH, HASHES = 5, 128


def _text(signature: np.ndarray) -> str:
    """The upper 32 bits of each minimum, as lowercase hex; an empty set gives all ``f``."""
    return (signature >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """The share of equal values, an unbiased estimate of the Jaccard index of the two shingle sets."""
    return float((left == right).mean())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, width: int = WIDTH, hashes: int = HASHES) -> DataFrame:
    """``(id, n_shingles, set_key binary, signature array<long>)`` for each row; the key names the set of shingles.

    Null texts count as empty; an empty set has a signature of all ones (-1 as a signed value) and no shingle.
    Repeated rows give repeated rows, null ids stay null. Other columns are not read, so their names don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = words.Permutations(hashes)
        for batch in batches:
            sizes, set_keys, rows = [], [], []
            for text in batch.column(1):
                s = words.distinct(words.shingles(text.as_py(), width))
                sizes.append(len(s))
                set_keys.append(words.set_key(s))
                rows.append(perms.lowest(s).view(np.int64))
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            signatures = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * hashes), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(set_keys, pa.binary()), signatures], ["id", "n_shingles", "set_key", "signature"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, set_key binary, signature array<long>")


def near_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, threshold: float = 0.8, bands: int = 21, width: int = WIDTH, hashes: int = 126, block: int = 512) -> DataFrame:
    """``(a, b, jaccard)`` with a < b: all pairs of distinct texts' representatives whose bands meet, verified on full sets.

    The representative of equal shingle sets is the smallest id (:func:`membership` gives every document's), so
    copies are not expanded. All members of a bucket are paired, in blocks, so that a large bucket is spread over
    many tasks; only pairs whose sizes alone rule the threshold out are not verified. Rows without words or with a
    null id pair with nothing; an id that stands for several sets has its best pair told.
    """
    prints = settle(fingerprints(docs, id_column, text_column, width=width, hashes=hashes).where("n_shingles > 0 AND id IS NOT NULL"))
    step = hashes // bands
    keys = F.array(*(F.xxhash64(F.lit(i), F.slice("signature", i * step + 1, step)) for i in range(bands)))
    named = settle(prints.groupBy("set_key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    member = named.select("set_key", "n", F.explode(keys).alias("bucket"))
    blocks = member.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1").select("bucket", F.ceil(F.col("many") / block).cast("int").alias("blocks"))
    shared = settle(member.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")))
    left = shared.select("bucket", F.col("mine").alias("low"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("high"), F.col("set_key").alias("x"), F.col("n").alias("n_x"))
    right = shared.select("bucket", F.explode(F.sequence(F.lit(0), F.col("mine"))).alias("low"), F.col("mine").alias("high"), F.col("set_key").alias("y"), F.col("n").alias("n_y"))
    met = left.join(right, ["bucket", "low", "high"]).where("low < high OR x < y").where(F.least("n_x", "n_y") >= (threshold - 1e-9) * F.greatest("n_x", "n_y"))
    pairs = settle(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    used = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct()
    ids = named.join(used, "set_key", "left_semi").select(F.col("id").alias("node")).distinct()
    sets = shingle_sets(docs, ids, id_column, text_column, width)
    key = F.pandas_udf(lambda sets: sets.map(lambda s: words.set_key(s)), "binary")
    sets = settle(sets.withColumn("node", key("shingles")).dropDuplicates(["node"]).join(used.withColumnRenamed("set_key", "node"), "node", "left_semi"))
    near = verified(pairs, sets).where(F.col("jaccard") >= threshold)
    low, high = (named.select(F.col("set_key").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    told = near.join(low, "a").join(high, "b").where("id_a <> id_b")
    best = F.max(F.struct("jaccard", "both", "either")).alias("best")
    told = told.groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(best)
    return told.select("a", "b", "best.both", "best.either", "best.jaccard")


def membership(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, representative)``: the smallest id among rows with the same shingle set."""
    prints = settle(fingerprints(docs, id_column, text_column).select("id", "set_key"))
    low = prints.groupBy("set_key").agg(F.min("id").alias("representative"))
    return prints.join(low, "set_key").select("id", "representative")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_column: str, text_column: str, width: int = WIDTH) -> DataFrame:
    """``(node, shingles array<long>)``, the sorted distinct shingles of the rows whose id is in ``ids(node)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [words.distinct(words.shingles(t.as_py(), width)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    rows = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).cast("binary").alias("text"))
    return rows.join(ids, "node", "left_semi").mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the sizes of intersection and union of their ``sets(node, shingles)`` and their exact Jaccard
    index. Sets are joined to pairs by id; a node in very many pairs is split by the adaptive skew join."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sizes"))
        .select("a", "b", "both", (F.col("sizes") - F.col("both")).alias("either"))
        .withColumn("jaccard", F.col("both") / F.col("either"))
    )


def _ranges(rows: DataFrame, known: int, parts: int, seed: int = 23) -> np.ndarray:
    """The smallest ids of about ``parts`` ranges of ids that hold about as many bytes of text each, by a bounded sample;
    the sample only evens out the ranges."""
    rate = min(1.0, min(128 * parts, 1 << 20) / max(1, known))
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    told = rows.where("id IS NOT NULL").where(share < rate).select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("double").alias("size")).toArrow()
    ids, sizes = (told[c].to_numpy() for c in ("id", "size"))
    order = np.argsort(ids, kind="stable")
    ids, before = ids[order], np.cumsum(sizes[order])
    at = np.searchsorted(before, np.arange(1, parts) * (before[-1] / parts if len(before) else 0))
    bounds = np.unique(ids[np.minimum(at, len(ids) - 1)]) if len(ids) else ids

    @F.pandas_udf("long")
    def range_of(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, i.to_numpy(np.int64), "right"))

    lows = rows.select("id").where("id IS NOT NULL").groupBy(range_of("id").alias("range")).agg(F.min("id").alias("low")).toArrow()
    return np.sort(lows["low"].to_numpy())


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, per_part: int = 200_000, part_bytes: int = 32 << 20, width: int = WIDTH, hashes: int = HASHES) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document.

    The next document is the one with the next larger id, after the last the one with the smallest; the edited
    text has the last floor(n / 2) code points replaced by the first as many of the next document's (all, if it
    has fewer). Rows are dealt by ranges of ids of about equal bytes, one range a task, each with a copy of the first
    document of the next range, so texts are shuffled once, and each task streams its range from the largest id down,
    holding one document. Each of the rows that repeat an id is returned, and the smallest text counts as the
    document's; a row with a null id takes the smallest id's document as its next, or itself if no row has an id; so
    does the only document. Null texts count as empty, an empty table gives no rows. Only the two columns named are read,
    so other columns' names don't matter.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    total, known, size = rows.agg(F.count("*"), F.count("id"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, min(known, max(-(-size // part_bytes), -(-known // per_part), min(rows.sparkSession.sparkContext.defaultParallelism * 2, known // 64))))
    low = _ranges(rows, known, parts) if known else np.empty(0, np.int64)
    loose = max(1, -(-(total - known) // per_part)) if total > known else 0  # parts of rows without an id
    ranges = len(low)

    @F.pandas_udf("array<long>")
    def places(i: pd.Series, salt: pd.Series) -> pd.Series:
        """Twice the part, plus one for the copy that a range before it needs; rows without an id come last."""
        out = []
        for x, s in zip(i, salt):
            if pd.isna(x):
                out.append([2 * (ranges + int(s) % loose)])
                continue
            at = int(np.searchsorted(low, x, "right")) - 1
            out.append([2 * at])
            if low[at] == x:
                out[-1].append(2 * ((at - 1) % ranges) + 1)
                if at == 0:
                    out[-1].extend(2 * (ranges + j) + 1 for j in range(loose))
        return pd.Series(out)

    dealt = rows.withColumn("place", F.explode(places("id", F.xxhash64("text"))))
    dealt = dealt.select(F.floor(F.col("place") / 2).cast("int").alias("part"), (F.pmod("place", F.lit(2)) == 1).alias("peek"), "id", "text")
    dealt = dealt.repartitionById(max(1, ranges + loose), "part").sortWithinPartitions("part", F.desc("peek"), F.desc("id"), F.asc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = words.Permutations(hashes)
        part = current = None
        ahead = mine = None  # (text, signature) of the next document and of the current one

        def sign(raw: bytes) -> np.ndarray:
            return perms.lowest(words.distinct(words.shingles(raw, width)))

        for batch in batches:
            out: list[tuple] = []
            for p, peek, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py() or ""
                if p != part:
                    part, current, ahead, mine = p, None, None, None
                if peek:
                    ahead = ahead or (text, sign(text.encode()))  # the first has the smallest text
                    continue
                signature = sign(text.encode())
                if i is not None and i != current:
                    ahead, mine, current = mine or ahead, (text, signature), i
                after = ahead or (text, signature)
                half = len(text) // 2
                raw = (text[: len(text) - half] + after[0][:half]).encode()
                other = sign(raw)
                out.append((i, len(text), hashlib.sha256(raw).hexdigest(), _text(signature), _text(other), likeness(signature, other), likeness(signature, after[1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, _EDITED.values())], list(_EDITED))

    return dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_column)


_EDITED = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
