"""Rank statistics and confirmatory summaries.

Ranks are found from the counts of distinct values, so what a window spans grows with those, not with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .splits import normal_tail


def distribution(values: DataFrame, column: str) -> DataFrame:
    """One row: count, extremes, mean, and quartiles by linear interpolation."""
    v = F.col(column).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return values.agg(F.count(v).alias("n"), F.min(v).alias("least"), q.alias("q"), F.max(v).alias("most"), F.avg(v).alias("mean")).select(
        "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most", F.round("mean", 6).alias("mean"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")
    )


def average_ranks(values: DataFrame, by: str, value: str, rank: str) -> DataFrame:
    """Adds ``rank`` within ``by``: equal values share the mean of their places."""
    w = Window.partitionBy(by)
    tied = F.count("*").over(Window.partitionBy(by, value))
    return values.withColumn(rank, F.rank().over(w.orderBy(value)) + (tied - 1) / 2)


def spearman(values: DataFrame, by: str, x: str, y: str, least: int = 3) -> DataFrame:
    """``(by, n, constant, rho)``: the rank correlation of each group with at least that many rows; 0 where y is
    constant, null for fewer."""
    ranked = average_ranks(average_ranks(values.where(F.col(y).isNotNull()), by, x, "rx"), by, y, "ry")
    out = ranked.groupBy(by).agg(F.count("*").alias("n"), (F.min(y) == F.max(y)).alias("constant"), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("r"))
    bounded = F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0))
    rho = F.when(F.col("n") < least, None).when(F.col("constant"), F.lit(0.0)).otherwise(F.round(bounded, 9))
    return out.select(by, "n", F.when(F.col("n") >= least, F.col("constant")).alias("constant"), rho.alias("rho"))


def wilcoxon_greater(values: DataFrame, column: str, null_value: float, pratt: bool = False) -> DataFrame:
    """One row: n, zero differences, the sum of positive ranks and its normal score, greater than ``null_value``.

    Zero differences are dropped, or with ``pratt`` ranked with the others and left out of the sums. Ties correct
    the variance; there is no continuity correction. With zero differences only, the score is null (p is 1). Sums are
    of whole numbers, exact up to 38 digits.
    """
    d = values.select((F.col(column).cast("double") - F.lit(null_value)).alias("d")).where("d IS NOT NULL AND NOT isnan(d)")
    by = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    zeros = F.sum(F.when(F.col("size") == 0, F.col("t")).otherwise(0)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("n0", zeros)
    if not pratt:
        by = by.withColumn("t", F.when(F.col("size") > 0, F.col("t")).otherwise(0))
    upto = F.sum("t").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    whole = lambda c: c.cast("decimal(20,0)")  # noqa: E731  cubes of counts outgrow a long
    t = whole(F.col("t"))
    by = by.withColumn("twice", whole(2 * upto - (F.col("t") - 1)))  # twice the rank
    live = F.col("size") > 0
    one = by.agg(
        F.sum(F.when(live, F.col("t")).otherwise(0)).alias("n"), F.max("n0").alias("n_zero"),
        (F.sum(F.when(live, whole(F.col("up")) * F.col("twice")).otherwise(0)).cast("double") / 2).alias("statistic"),
        F.sum(F.when(live, t * t * t - t).otherwise(0)).alias("ties"),
    )
    z0 = whole(F.col("n_zero") if pratt else F.lit(0))
    m = whole(F.col("n")) + z0
    mean = (m * (m + 1) - z0 * (z0 + 1)).cast("double") / 4
    variance = (m * (m + 1) * (2 * m + 1) - z0 * (z0 + 1) * (2 * z0 + 1)).cast("double") / 24 - F.col("ties").cast("double") / 48
    z = F.when((F.col("n") > 0) & (variance > 0), (F.col("statistic") - mean) / F.sqrt(variance))
    return one.select((F.col("n") + F.col("n_zero")).alias("n"), "n_zero", "statistic", F.round(z, 9).alias("z"))


def p_value(z: float | None) -> float:
    return 1.0 if z is None else normal_tail(z)


def compare(ours: DataFrame, golden: DataFrame, key: str, metrics: list[str], tolerance: float = 1e-6) -> DataFrame:
    """For each metric: rows, largest absolute and relative and median relative difference, and how many disagree.

    The relative difference is over the golden value: 0 where both are 0, infinite where only the golden one is.
    Both sides must hold the same keys.
    """
    a, b = (df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select(key, "m.metric", "m.value") for df in (ours, golden))
    both = a.withColumnRenamed("value", "ours").join(b.withColumnRenamed("value", "golden"), [key, "metric"], "full_outer")
    alone = F.col("ours").isNull() | F.col("golden").isNull()
    off = F.abs(F.col("ours") - F.col("golden"))
    relative = F.when(alone, F.raise_error(F.lit("the two results hold different keys")).cast("double")).when(F.col("golden") != 0, off / F.abs("golden")).when(off == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    both = both.withColumn("off", off).withColumn("relative", relative)
    return both.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.max("off"), 9).alias("max_abs"), F.round(F.max("relative"), 9).alias("max_rel"), F.round(F.median("relative"), 9).alias("median_rel"), F.sum((F.col("relative") > tolerance).cast("long")).alias("n_disagree"))


def agreement(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: keys, keys that one side lacks, and keys whose columns differ; nulls are equal to nulls."""
    a, b = left.select(key, F.struct(*columns).alias("a")), right.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    alone = F.col("a").isNull() | F.col("b").isNull()
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.agg(F.count("*").alias("n_fields"), F.sum(alone.cast("long")).alias("n_alone"), F.sum((~alone & ~same).cast("long")).alias("n_differ"))
