"""Folds, holdouts and hash-chained logs."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEED, FOLDS = 20260822, 10


def grouped_folds(fields: DataFrame, n_folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """``(field_id, fold)``: fields in the order of SHA-256(seed, unit separator, field), dealt to folds in turn.

    The rank of a field counts those in earlier slices of the digest first, so no window spans all fields.
    """
    ids = fields.select("field_id").distinct().withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}\x1f"), F.col("field_id")), 256))
    ids = ids.withColumn("slice", F.substring("digest", 1, 3))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("digest", "field_id"))
    sizes = ids.groupBy("slice").agg(F.count("*").alias("n"))  # 4096 slices at most
    before = sizes.select("slice", (F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = ids.withColumn("inside", inside).join(F.broadcast(before), "slice")
    return ranked.select("field_id", ((F.col("before") + F.col("inside") - 1) % n_folds + 1).alias("fold"))


def hash_fold(field: Column, n_folds: int = FOLDS) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number, modulo the folds, plus one."""
    number = F.conv(F.substring(F.sha2(field, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % n_folds + 1).cast("long")


def field_holdout(field_ids: Iterable[str], fraction: float, seed: int) -> list[str]:
    """A sorted sample of max(1, round(n * fraction)) fields by numpy's default generator; an error if none is left."""
    ids = sorted(set(field_ids))
    count = max(1, round(len(ids) * fraction))
    if count >= len(ids):
        raise ValueError("the holdout would take all fields")
    picked = np.random.default_rng(seed).choice(len(ids), size=count, replace=False)
    return sorted(ids[i] for i in picked)


def content_hash(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, no blanks, UTF-8 as it is, no NaN."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def log_entry(index: int, payload, previous: str | None) -> dict:
    body = {"index": index, "payload": payload, "prev_hash": previous}
    return {**body, "entry_hash": content_hash(body)}


def chain(payloads: Iterable) -> list[dict]:
    out: list[dict] = []
    for payload in payloads:
        out.append(log_entry(len(out), payload, out[-1]["entry_hash"] if out else None))
    return out


def verify_chain(log: DataFrame) -> DataFrame:
    """For ``log(index, payload json, prev_hash, entry_hash)``: one row counting entries, entries whose own hash is
    wrong and links to the predecessor that don't hold. Each entry is hashed by itself; a link joins index - 1."""

    @F.pandas_udf("string")
    def rehash(index: pd.Series, payload: pd.Series, previous: pd.Series) -> pd.Series:
        return pd.Series([log_entry(int(i), json.loads(p), None if q is None or q != q else q)["entry_hash"] for i, p, q in zip(index, payload, previous)])

    checked = log.withColumn("right", rehash("index", "payload", "prev_hash") == F.col("entry_hash"))
    before = log.select((F.col("index") + 1).alias("index"), F.col("entry_hash").alias("before"))
    linked = checked.join(before, "index", "left").withColumn("linked", F.col("prev_hash").eqNullSafe(F.col("before")))
    return linked.agg(F.count("*").alias("n_entries"), F.sum((~F.col("right")).cast("long")).alias("n_altered"), F.sum((~F.col("linked")).cast("long")).alias("n_broken"))


def anytime_curve(records: DataFrame) -> DataFrame:
    """``(run, evaluations, best)``: the best score so far of each run, by its counter of evaluations."""
    w = Window.partitionBy("run").orderBy("evaluations").rowsBetween(Window.unboundedPreceding, 0)
    return records.select("run", "evaluations", F.max("score").over(w).alias("best"))


def sign_flip_p(values: Iterable[float], draws: int = 10_000, seed: int = SEED) -> float:
    """One-sided sign-flip test that the mean is below 0: the share of draws at most the observed mean, plus one."""
    d = np.asarray(list(values), float)
    flips = np.random.default_rng(seed).choice((-1.0, 1.0), size=(draws, len(d)))
    return float((int(((flips * d).mean(1) <= d.mean()).sum()) + 1) / (draws + 1))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chains(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows(key, order, payload json)`` as hash-chained logs, one for each key: ``(key, index, payload, prev_hash, entry_hash)``.

    An entry needs its predecessor's hash, so a log is one group; logs are chained side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        log = chain(json.loads(p) for p in pdf.sort_values(order)["payload"])
        return pd.DataFrame({key: pdf[key].iloc[0], "index": [e["index"] for e in log], "payload": [json.dumps(e["payload"]) for e in log], "prev_hash": [e["prev_hash"] for e in log], "entry_hash": [e["entry_hash"] for e in log]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, order, "payload").groupBy(key).applyInPandas(run, f"`{key}` {kind}, index long, payload string, prev_hash string, entry_hash string")


def verify_chains(logs: DataFrame, key: str) -> DataFrame:
    """:func:`verify_chain` for each of several logs: ``(key, n_entries, n_altered, n_broken)``."""
    checked = logs.withColumn("right", _rehashed(F.col("index"), F.col("payload"), F.col("prev_hash")) == F.col("entry_hash"))
    before = F.lag("entry_hash").over(Window.partitionBy(key).orderBy("index"))
    in_turn = F.col("index") == F.row_number().over(Window.partitionBy(key).orderBy("index")) - 1
    linked = checked.withColumn("linked", in_turn & F.col("prev_hash").eqNullSafe(before))
    return linked.groupBy(key).agg(F.count("*").alias("n_entries"), F.sum((~F.col("right")).cast("long")).alias("n_altered"), F.sum((~F.col("linked")).cast("long")).alias("n_broken"))


@F.pandas_udf(T.StringType())
def _rehashed(index: pd.Series, payload: pd.Series, previous: pd.Series) -> pd.Series:
    return pd.Series([log_entry(int(i), json.loads(p), None if q is None or q != q else q)["entry_hash"] for i, p, q in zip(index, payload, previous)], dtype=object)


def fold_evidence(folds: DataFrame) -> DataFrame:
    """One row on ``folds(field_id, fold)``: fields, folds, how much their sizes differ (more than 1 is an error, as is a
    field that is there twice), and the hash of the assignments in order of fields.

    The hash is over one text of all assignments, a few bytes a field."""
    entry = F.concat(F.lit('{"field_id":'), F.to_json(F.array("field_id")).substr(F.lit(2), F.length(F.to_json(F.array("field_id"))) - 2), F.lit(',"fold":'), F.col("fold").cast("string"), F.lit("}"))
    sizes = folds.groupBy("fold").agg(F.count("*").alias("n"))
    spread = sizes.agg(F.count("*").alias("n_folds"), (F.max("n") - F.min("n")).alias("spread"))
    told = F.sort_array(F.collect_list(F.struct("field_id", entry.alias("entry"))))
    whole = folds.agg(F.count("*").alias("n_fields"), F.count_distinct("field_id").alias("n_distinct"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform(told, lambda x: x["entry"]), ","), F.lit("]")), 256).alias("assignment_hash"))
    sound = (F.col("spread") <= 1) & (F.col("n_fields") == F.col("n_distinct"))
    checked = F.when(sound, F.col("spread")).otherwise(F.raise_error(F.lit("not a round-robin assignment")).cast("long"))
    return whole.crossJoin(spread).select("n_fields", "n_folds", checked.alias("spread"), "assignment_hash")  # one row each


def requests(fields: DataFrame) -> DataFrame:
    """``(request_id, field_id)`` of a comparison's fields, numbered in order of their ids; a comparison has few fields."""
    place = F.row_number().over(Window.orderBy("field_id")) - 1
    return fields.select("field_id").distinct().select(F.format_string("f2b_%03d_%s", place, F.col("field_id")).alias("request_id"), "field_id")
