"""Preferences, regret of configurations, baselines and the single best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import scalarize
from ..sources.runs import OBJECTIVES
from .pareto import with_status


def grid() -> list[tuple[float, float, float]]:
    """The 22 weight vectors in their fixed order: three vertices, nine points on edges, ten of sixths inside."""
    out = [tuple(float(i == j) for j in range(3)) for i in range(3)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for t in (0.25, 0.5, 0.75):
            point = [0.0, 0.0, 0.0]
            point[i], point[j] = t, 1 - t
            out.append(tuple(point))
    return out + [(i / 6, j / 6, (6 - i - j) / 6) for i in range(1, 5) for j in range(1, 6 - i)]


def preferences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *w) for k, w in enumerate(grid())], "preference long, w1 double, w2 double, w3 double")


def _scored(runs: DataFrame, applicable: DataFrame | None) -> tuple[DataFrame, list[str], list[tuple[Column, Column]]]:
    """Nominal configurations with the scores of all preferences side by side, so the matrix is shuffled once; their keys; the
    score and regret at each preference."""
    rows = with_status(runs)
    ok = F.col("status") == "ok"
    fits = F.col("status") != "not_applicable"
    if applicable is not None:
        rows = rows.join(applicable.select("config_id", "vehicle_index").distinct().withColumn("fits", F.lit(True)), ["config_id", "vehicle_index"], "left")
        alien = F.raise_error(F.concat(F.lit("ok though not applicable: "), "instance_id", F.lit(" "), "config_id")).cast("boolean")
        fits = F.when(ok & F.col("fits").isNull(), alien).otherwise(F.coalesce("fits", F.lit(False)))
    values, reference = [F.col(o) for o in OBJECTIVES], [F.col(f"ref_{o}") for o in OBJECTIVES]
    scores = {f"s{k}": F.when(ok, scalarize(values, reference, [F.lit(x) for x in w])) for k, w in enumerate(grid())}
    keys = ["field_id", "instance_id", "config_id", "vehicle_index"]
    w = Window.partitionBy("instance_id")
    wide = rows.select(*keys, fits.alias("applicable"), *(s.alias(k) for k, s in scores.items()))
    wide = wide.select("*", *(f(k).over(w).alias(k + name) for k in scores for f, name in ((F.min, "low"), (F.max, "high"))))
    told = [(F.col(k), F.coalesce(F.col(k) - F.col(k + "low"), F.col(k + "high") - F.col(k + "low") + 1)) for k in scores]
    return wide, keys, told


def regrets(runs: DataFrame, applicable: DataFrame | None = None) -> DataFrame:
    """``(field_id, instance_id, config_id, vehicle_index, preference, score, regret, applicable)`` for each nominal
    configuration of an instance and each preference.

    The score is the weighted Chebyshev distance; the regret is against the best observed one. A configuration
    that wasn't observed ok has the instance's largest regret plus one; all are null where none was observed.
    ``applicable(config_id, vehicle_index)`` names what goes together whatever was observed; a run that is ok but not
    there is an error. Without that table a run counts as applicable unless its status says otherwise.
    """
    wide, keys, told = _scored(runs, applicable)
    each = [F.struct(F.lit(i).cast("long").alias("preference"), s.alias("score"), r.alias("regret")) for i, (s, r) in enumerate(told)]
    long = wide.select(*keys, "applicable", F.explode(F.array(*each)).alias("p"))
    return long.select(*keys, "p.preference", "p.score", "p.regret", "applicable")


def wide_regrets(runs: DataFrame, applicable: DataFrame | None = None) -> DataFrame:
    """``(field_id, instance_id, config_id, vehicle_index, applicable, e1, e2, ...)``: :func:`regrets` with those of all
    preferences side by side."""
    wide, keys, told = _scored(runs, applicable)
    return wide.select(*keys, "applicable", *(r.alias(f"e{i + 1}") for i, (_, r) in enumerate(told)))


def random_baselines(regret: DataFrame) -> DataFrame:
    """Mean regret of a random choice among the applicable and among all nominal configurations."""
    return regret.groupBy("instance_id", "preference").agg(F.avg(F.when(F.col("applicable"), F.col("regret"))).alias("random_applicable"), F.avg("regret").alias("random_nominal"))


def field_losses(regret: DataFrame) -> DataFrame:
    """For each field and configuration the mean over preferences, then over analysable instances."""
    by = regret.where("regret IS NOT NULL").groupBy("field_id", "instance_id", "config_id").agg(F.avg("regret").alias("loss"))
    return by.groupBy("field_id", "config_id").agg(F.avg("loss").alias("loss"), F.count("*").alias("n_instances"))


def single_best(losses: DataFrame) -> DataFrame:
    """One row: the configuration of the smallest mean loss over fields, the smaller id among equals."""
    by = losses.groupBy("config_id").agg(F.round(F.avg("loss"), 9).alias("loss"), F.count("*").alias("n_fields"))
    return by.agg(F.min(F.struct("loss", "config_id", "n_fields")).alias("best")).select("best.config_id", "best.loss", "best.n_fields")


def cross_validate(regret: DataFrame, folds: DataFrame) -> DataFrame:
    """For each fold the configuration that is best on the other folds, its loss on the fold's fields and the random
    choices' losses there. ``folds(field_id, fold)`` must name every field, and no other."""
    losses = field_losses(regret)
    fields = regret.select("field_id").distinct()
    mismatch = fields.join(folds, "field_id", "full_outer").where(F.col("fold").isNull()).count() + folds.join(fields, "field_id", "left_anti").count()
    if mismatch:
        raise ValueError(f"{mismatch} fields differ between the matrix and the folds")
    names = folds.select(F.col("fold").alias("held")).distinct()
    by_fold = losses.join(folds, "field_id")
    # a configuration's loss without a fold is its total less the fold's share
    part = by_fold.groupBy("config_id", "fold").agg(F.sum("loss").alias("loss"), F.count("*").alias("n"))
    total = part.groupBy("config_id").agg(F.sum("loss").alias("all_loss"), F.sum("n").alias("all_n"))
    pairs = total.join(names).join(part.withColumnRenamed("fold", "held"), ["config_id", "held"], "left").fillna(0, ["loss", "n"])
    pairs = pairs.where("all_n > n").withColumn("mean", F.round((F.col("all_loss") - F.col("loss")) / (F.col("all_n") - F.col("n")), 9))
    best = pairs.groupBy("held").agg(F.min(F.struct("mean", "config_id")).alias("b")).select(F.col("held").alias("fold"), F.col("b.config_id").alias("config_id"))
    chosen = by_fold.join(best, ["fold", "config_id"]).groupBy("fold", "config_id").agg(F.round(F.avg("loss"), 6).alias("sbs_loss"), F.count("*").alias("n_fields"))
    random = regret.where("regret IS NOT NULL").groupBy("field_id", "instance_id", "preference").agg(F.avg(F.when(F.col("applicable"), F.col("regret"))).alias("a"), F.avg("regret").alias("n"))
    random = random.groupBy("field_id").agg(F.avg("a").alias("a"), F.avg("n").alias("n")).join(folds, "field_id")
    random = random.groupBy("fold").agg(F.round(F.avg("a"), 6).alias("random_applicable_loss"), F.round(F.avg("n"), 6).alias("random_nominal_loss"))
    return chosen.join(random, "fold")
