"""Nominal, applicable and observed pools, the status crosstab and pool sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pareto import with_status


def status_counts(runs: DataFrame) -> DataFrame:
    return with_status(runs).groupBy("runstatus", "status").agg(F.count("*").alias("n"))


def status_differences(runs: DataFrame) -> DataFrame:
    """How often the derived status differs from the runtime's, by "raw->derived"."""
    rows = with_status(runs).where("status <> runstatus")
    return rows.groupBy(F.concat_ws("->", "runstatus", "status").alias("change")).agg(F.count("*").alias("n"))


def static_applicable(configs: DataFrame, vehicles: DataFrame, cards: DataFrame) -> DataFrame:
    """``(config_id, vehicle_index)`` that go together: every slot's algorithm is in the catalogue ``cards(stage,
    algorithm)``, and a path with reverse gear needs a vehicle that has one. All three are small tables of settings."""
    known = configs
    for stage in ("decomposition", "headland", "swath", "route", "path"):
        known = known.join(cards.where(F.col("stage") == stage).select(F.col("algorithm").alias(stage)), stage, "left_semi")
    return known.join(vehicles, ~F.col("path").contains("reeds_shepp") | F.col("can_reverse")).select("config_id", "vehicle_index")


def census(runs: DataFrame, applicable: DataFrame) -> DataFrame:
    """For each instance the sizes of its nominal, applicable and observed-ok pools, and whether they are nested."""
    rows = with_status(runs).join(applicable.select("config_id", "vehicle_index").distinct().withColumn("fits", F.lit(True)), ["config_id", "vehicle_index"], "left")
    ok, fits = F.col("status") == "ok", F.coalesce("fits", F.lit(False))
    return rows.groupBy("field_id", "instance_id", "vehicle_index").agg(
        F.count_distinct("config_id").alias("nominal"), F.sum(fits.cast("long")).alias("applicable"), F.sum(ok.cast("long")).alias("observed"),
        F.max(ok & ~fits).alias("violated"),
    )


def field_census(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("field_id").agg(
        F.count("*").alias("n_instances"), F.round(F.avg("observed"), 4).alias("mean_ok"),
        F.round(F.avg(F.col("applicable") - F.col("observed")), 4).alias("mean_lost"), F.sum((F.col("observed") == 0).cast("long")).alias("zero_ok"),
    )


def crosstab(runs: DataFrame) -> DataFrame:
    """For each configuration and vehicle: rows, ok, named rejections, not applicable, and their shares."""
    rows = with_status(runs)
    by = rows.groupBy("config_id", "vehicle_index").agg(
        F.count("*").alias("n_rows"), F.sum((F.col("status") == "ok").cast("long")).alias("ok"), F.sum((F.col("status") == "not_applicable").cast("long")).alias("not_applicable"),
        F.sum((F.col("status") == "outside_area").cast("long")).alias("outside_area"), F.sum((F.col("status") == "collision").cast("long")).alias("collision"),
    )
    named = F.col("n_rows") - F.col("ok") - F.col("not_applicable")
    by = by.withColumn("named_rejections", named)
    return by.withColumns({
        "ok_share": F.round(F.col("ok") / F.col("n_rows"), 4), "named_rejection_share": F.round(F.col("named_rejections") / F.col("n_rows"), 4),
        "factually_out_of_pool": F.col("named_rejections") / F.col("n_rows") >= 0.8,
    })


def pool_sizes(runs: DataFrame) -> DataFrame:
    """One row: minimum, quartiles, maximum and mean of the observed-ok pool sizes; quartiles are the values at the
    lower index floor(q * (n - 1)). Sizes are counted first, so the running sums have a row for each size only."""
    sizes = with_status(runs).groupBy("instance_id").agg(F.sum((F.col("status") == "ok").cast("long")).alias("size"))
    by = sizes.groupBy("size").agg(F.count("*").alias("n"))
    up = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("size")))
    last = F.col("total") - 1
    return by.agg(
        F.max("total").alias("n_instances"), F.sum(F.when(F.col("size") == 0, F.col("n")).otherwise(0)).alias("zero_ok"), F.sum(F.when(F.col("size") <= 1, F.col("n")).otherwise(0)).alias("degenerate"),
        F.min("size").alias("least"), at(F.floor(0.25 * last)).alias("q1"), ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("median"), at(F.floor(0.75 * last)).alias("q3"),
        F.max("size").alias("most"), F.round(F.sum(F.col("size") * F.col("n")) / F.max("total"), 4).alias("mean"),
    )


def census_by_fold(sizes: DataFrame, folds: DataFrame, holdout: list[int]) -> DataFrame:
    """``(fold, split, ...)`` of :func:`census`: fields, instances, mean pools and instances without an ok run of each fold;
    a fold's split is by field alone."""
    split = F.when(F.col("fold").isin(*holdout), "holdout").otherwise("train")
    return sizes.join(folds, "field_id").groupBy("fold", split.alias("split")).agg(
        F.count_distinct("field_id").alias("n_fields"), F.count("*").alias("n_instances"), F.round(F.avg("observed"), 6).alias("mean_ok"),
        F.round(F.avg(F.col("applicable") - F.col("observed")), 6).alias("mean_lost"), F.sum((F.col("observed") == 0).cast("long")).alias("zero_ok"),
    )


def size_histogram(runs: DataFrame) -> DataFrame:
    """``(size, n)``: how many instances have so many runs that are ok."""
    sizes = with_status(runs).groupBy("instance_id").agg(F.sum((F.col("status") == "ok").cast("long")).alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


def classes(runs: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, vehicle_index, status, n, share)``: every class of status of a configuration and vehicle with its share.
    ``names(config_id, name)`` may lack configurations, which go by the first eight letters of their id."""
    by = with_status(runs).groupBy("config_id", "vehicle_index", "status").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("config_id", "vehicle_index"))
    by = by.withColumn("share", F.round(share, 6)).join(names, "config_id", "left")
    return by.select(F.coalesce("name", F.substring("config_id", 1, 8)).alias("name"), "vehicle_index", "status", "n", "share")
