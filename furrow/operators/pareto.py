"""Pareto fronts, exact three-dimensional hypervolume and their summaries. All objectives are minimised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import dominates
from ..functions.status import derived_status
from ..sources.runs import OBJECTIVES


def with_status(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", derived_status(F.col("runstatus"), F.col("failure_reason")))


def points(runs: DataFrame) -> DataFrame:
    """Runs that are ok and have all objectives."""
    rows = with_status(runs).where("status = 'ok'")
    return rows.dropna(subset=list(OBJECTIVES))


def front(rows: DataFrame, key: str = "instance_id", rtol: float = 1e-12) -> DataFrame:
    """The rows that no row of their instance dominates; equal rows all stay.

    An instance has a row for each configuration, so the join's fan-out is bounded by the number of those.
    """
    left, right = rows.alias("l"), rows.select(key, *OBJECTIVES).alias("r")
    beaten = dominates([F.col(f"r.{o}") for o in OBJECTIVES], [F.col(f"l.{o}") for o in OBJECTIVES], rtol)
    return left.join(right, (F.col(f"l.{key}") == F.col(f"r.{key}")) & beaten, "left_anti")


def completeness(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """For each instance: rows, distinct configurations, missing and foreign ones against ``configs(config_id)``."""
    nominal = configs.select("config_id").distinct().withColumn("nominal", F.lit(1))
    total = nominal.agg(F.count("*").alias("size"))
    seen = runs.select("instance_id", "config_id").join(nominal, "config_id", "left")
    by = seen.groupBy("instance_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("config_id").alias("n_configs"),
        F.count_distinct(F.when(F.col("nominal").isNull(), F.col("config_id"))).alias("n_foreign"),
    )
    by = by.join(F.broadcast(total))  # one row
    missing = F.col("size") - (F.col("n_configs") - F.col("n_foreign"))
    return by.select("instance_id", "n_rows", "n_configs", "n_foreign", missing.alias("n_missing"), ((F.col("n_rows") == F.col("size")) & (F.col("n_configs") == F.col("size")) & (F.col("n_foreign") == 0)).alias("complete"))


def front_sizes(runs: DataFrame) -> DataFrame:
    """``(field_id, instance_id, vehicle_index, effective_pool, front_size)``; a null front where no run is ok."""
    status = with_status(runs)
    ok = F.col("status") == "ok"
    bad = ok & (sum((F.col(o).isNull() | F.isnan(o) | (F.abs(o) == float("inf"))).cast("int") for o in OBJECTIVES) > 0)
    by = status.groupBy("field_id", "instance_id", "vehicle_index").agg(F.sum(ok.cast("long")).alias("effective_pool"), F.max(bad).alias("bad"))
    by = by.withColumn("effective_pool", F.when(F.col("bad"), F.raise_error(F.lit("an ok run lacks a finite objective")).cast("long")).otherwise(F.col("effective_pool"))).drop("bad")
    size = front(points(runs)).groupBy("instance_id").agg(F.count("*").alias("front_size"))
    return by.join(size, "instance_id", "left").select("field_id", "instance_id", "vehicle_index", "effective_pool", "front_size")


def field_estimates(sizes: DataFrame) -> DataFrame:
    """For each field: the median over defined fronts, and with undefined ones as 0."""
    return sizes.groupBy("field_id").agg(
        F.count("*").alias("n_instances"), F.count("front_size").alias("n_front_instances"),
        F.median("front_size").alias("median_front_size"), F.median(F.coalesce("front_size", F.lit(0))).alias("median_zero_as_zero"),
    )


def beyond_reference(rows: DataFrame) -> DataFrame:
    """``beyond``: whether any objective is at its reference or above."""
    return rows.withColumn("beyond", sum((F.col(o) >= F.col(f"ref_{o}")).cast("int") for o in OBJECTIVES) > 0)


def volume(box: np.ndarray, reference: np.ndarray) -> float:
    """Volume of the union of the boxes from each row of ``box`` to the reference.

    The cells between neighbouring coordinates are marked as covered or not; points at the reference or beyond
    cover nothing.
    """
    box = box[(box < reference).all(1)]
    if not len(box):
        return 0.0
    edges = [np.append(np.unique(box[:, k]), reference[k]) for k in range(3)]
    low = [e[:-1] for e in edges]
    total = 0.0
    for i, x in enumerate(low[0]):  # a slab at a time bounds the memory by its two other sides
        part = box[box[:, 0] <= x]
        covered = ((part[:, 1, None, None] <= low[1][None, :, None]) & (part[:, 2, None, None] <= low[2][None, None, :])).any(0)
        area = float(np.diff(edges[1]) @ covered.astype(float) @ np.diff(edges[2]))
        total += float(edges[0][i + 1] - x) * area
    return total


@F.pandas_udf(T.DoubleType())
def _volumes(points: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([volume(np.stack(p), np.asarray(r, float)) for p, r in zip(points, reference)], dtype=float)


def single(column: str) -> Column:
    """The one value of a group's column; an error if there are several, null if there is none."""
    several = F.raise_error(F.concat(F.lit(f"several values of {column}: "), F.min(column).cast("string"), F.lit(", "), F.max(column).cast("string")))
    return F.when(F.min(column) == F.max(column), F.min(column)).when(F.count(column) > 0, several.cast("double"))


def references(runs: DataFrame, fallback: dict[str, float] | None = None) -> DataFrame:
    """``(instance_id, ref_..., scope)``: an instance's own reference, or the ``fallback`` for all where it has none.

    An instance's rows must agree; one without a reference is an error where there is no fallback. ``scope`` is
    "instance" or "global".
    """
    own = [f"ref_{o}" for o in OBJECTIVES]
    by = runs.groupBy("instance_id").agg(*(single(c).alias(c) for c in own))
    whole = sum(F.col(c).isNotNull().cast("int") for c in own) == len(own)
    missing = F.raise_error(F.concat(F.lit("no reference for "), "instance_id")).cast("double")
    other = {f"ref_{o}": F.lit(float(fallback[o])) if fallback else missing for o in OBJECTIVES}
    scope = F.when(whole, "instance").otherwise("global")
    return by.select("instance_id", *(F.when(whole, F.col(c)).otherwise(other[c]).alias(c) for c in own), scope.alias("scope"))


def hypervolumes(rows: DataFrame) -> DataFrame:
    """``(instance_id, hypervolume, normalized)`` against each instance's own reference columns, which must agree.

    An instance's points, at most one a configuration, are gathered in an array; volumes are found a batch of instances at
    a time.
    """
    by = rows.groupBy("instance_id").agg(F.collect_list(F.array(*OBJECTIVES)).alias("points"), *(single(f"ref_{o}").alias(f"ref_{o}") for o in OBJECTIVES))
    reference = F.array(*(f"ref_{o}" for o in OBJECTIVES))
    found = by.select("instance_id", _volumes("points", reference).alias("hypervolume"), reference.alias("r"))
    return found.select("instance_id", "hypervolume", (F.col("hypervolume") / (F.col("r")[0] * F.col("r")[1] * F.col("r")[2])).alias("normalized"))


def front_evaluation(runs: DataFrame) -> DataFrame:
    """For each instance with a point inside its reference: points beyond it, size of the front of the others, and
    the front's hypervolume."""
    rows = beyond_reference(points(runs))
    counted = rows.groupBy("instance_id").agg(F.sum(F.col("beyond").cast("long")).alias("n_beyond"), F.count("*").alias("n_points"))
    kept = front(rows.where("NOT beyond"))
    size = kept.groupBy("instance_id").agg(F.count("*").alias("front_size"))
    return counted.join(size, "instance_id").join(hypervolumes(kept), "instance_id")


def pareto_summary(runs: DataFrame) -> DataFrame:
    """One row for the corpus. The front takes in points beyond the reference, which add no volume."""
    sizes = front_sizes(runs)
    volumes = hypervolumes(front(points(runs)))
    rows = sizes.join(volumes, "instance_id", "left")
    pool, size = F.col("effective_pool"), F.col("front_size")
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    return rows.agg(
        F.count("front_size").alias("n_instances"), F.count("*").alias("n_instances_in_corpus"), count(pool == 0).alias("n_zero_ok"),
        count(pool <= 1).alias("n_degenerate"), count((pool >= 2) & (size == 1)).alias("n_singleton"), count((pool <= 1) & (size == 1)).alias("n_singleton_excluded"),
        F.median("front_size").alias("front_size_median"), F.round(F.avg(size / pool), 6).alias("mean_ratio"),
        F.round(F.avg("hypervolume") / 1e6, 6).alias("mean_hypervolume_m"), F.round(F.avg("normalized"), 9).alias("mean_normalized"),
    )


def ecdf(values: DataFrame, column: str) -> DataFrame:
    """``(value, share)``: a row for each row that has a value, the i-th in order with (i + 1) / n, ties apart.

    Values are counted first, and each count is spread again, so no window spans all rows.
    """
    by = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    up = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole))
    steps = by.select("value", "total", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, "upto")).alias("step"))
    return steps.select("value", (F.col("step") / F.col("total")).alias("share"))
