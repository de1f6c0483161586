"""Confirmatory records: one row each, with a test, its bound for a family of tests, and the declared failure criteria."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stats
from .splits import normal_tail

#: The level of the family of tests and their number.
ALPHA, FAMILY = 0.01, 3
#: A design has so many offsets, spacings and vehicles.
DESIGN = (5, 2, 2)


@F.pandas_udf(T.DoubleType())
def _tail(z: pd.Series) -> pd.Series:
    return pd.Series([normal_tail(x) for x in z], dtype=float)


def tested(values: DataFrame, column: str, null_value: float, pratt: bool = False) -> DataFrame:
    """One row of :func:`stats.wilcoxon_greater` with ``p``, its upper bound in the family and whether that rejects."""
    one = stats.wilcoxon_greater(values, column, null_value, pratt=pratt)
    p = F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(_tail(F.coalesce("z", F.lit(0.0))))
    one = one.select("statistic", "z", F.round(p, 9).alias("p")).withColumn("bound", F.least(F.lit(1.0), FAMILY * F.col("p")))
    return one.withColumn("rejected", F.col("bound") <= ALPHA)


def pareto_record(estimates: DataFrame) -> DataFrame:
    """The record of ``pareto.field_estimates``: sizes, spread, the share of fields with a single-point front, the test
    that the median exceeds 1, and three criteria."""
    median, zeroed = F.col("median_front_size"), F.col("median_zero_as_zero")
    one = estimates.agg(
        F.count("*").alias("n_all_fields"), F.count(median).alias("n_analyzable_fields"), F.median(zeroed).alias("sensitivity_median"), F.sum((median == 1).cast("long")).alias("n_single"),
    )
    spread = stats.distribution(estimates.where(median.isNotNull()), "median_front_size").drop("n")
    out = one.crossJoin(spread).crossJoin(tested(estimates, "median_front_size", 1.0))  # one row each
    single = F.col("n_single") / F.col("n_analyzable_fields")
    zero = F.col("n_all_fields") - F.col("n_analyzable_fields")
    return out.select(
        "n_all_fields", "n_analyzable_fields", zero.alias("n_zero_ok_fields"), "least", "q1", "median", "q3", "most", "mean", "iqr", "sensitivity_median", F.round(single, 9).alias("single_front_share"),
        "statistic", "z", "p", "bound", "rejected", (F.col("median") == 1).alias("median_is_1"), (single > 0.9).alias("over_90_percent_single"), (zero / F.col("n_all_fields") > 0.3).alias("over_30_percent_zero_ok"),
    )


def design_cell(instance_id: Column) -> dict[str, Column]:
    """Parts of an instance's name "field:principal_axis:offset:spacing:vehicle:number"; another form is an error."""
    parts = F.split(instance_id, ":")
    wrong = F.raise_error(F.concat(F.lit("not the name of a design's cell: "), instance_id))
    whole = (F.size(parts) >= 6) & (F.element_at(parts, -5) == "principal_axis") & (F.element_at(parts, -2) == "vehicle")
    number = lambda k, kind: F.when(whole, F.coalesce(F.element_at(parts, k).try_cast(kind), wrong.cast(kind))).otherwise(wrong.cast(kind))
    field = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 5, F.lit(0))), ":")
    return {"field": field, "offset": number(-4, "double"), "spacing": number(-3, "double"), "vehicle": number(-1, "long")}


def row_angle_effects(sizes: DataFrame) -> DataFrame:
    """``(field_id, n_cells, n_front_instances, n_offset_bins, constant, rho)`` of ``pareto.front_sizes`` over a design.

    A field must have each cell of five offsets, two spacings and two vehicles once, and a cell's name must agree with
    its row; anything else is an error. A bin's value is the median front of an offset's cells that have one; ``rho`` is
    the rank correlation over at least three bins, 0 where they are equal.
    """
    cell = design_cell(F.col("instance_id"))
    agrees = (cell["field"] == F.col("field_id")) & (cell["vehicle"] == F.col("vehicle_index"))
    checked = F.when(agrees, cell["offset"]).otherwise(F.raise_error(F.concat(F.lit("a row disagrees with its name: "), "instance_id")).cast("double"))
    rows = sizes.select("field_id", "front_size", checked.alias("offset"), cell["spacing"].alias("spacing"), cell["vehicle"].alias("vehicle"))
    offsets, spacings, vehicles = DESIGN
    whole = (F.count("*") == offsets * spacings * vehicles) & (F.count_distinct("offset", "spacing", "vehicle") == offsets * spacings * vehicles)
    whole &= (F.count_distinct("offset") == offsets) & (F.count_distinct("spacing") == spacings) & (F.count_distinct("vehicle") == vehicles)
    broken = F.raise_error(F.concat(F.lit("not a whole design: "), F.first("field_id"))).cast("long")
    fields = rows.groupBy("field_id").agg(F.when(whole, F.count("*")).otherwise(broken).alias("n_cells"), F.count("front_size").alias("n_front_instances"))
    bins = rows.groupBy("field_id", "offset").agg(F.median("front_size").alias("y"))
    rho = stats.spearman(bins, "field_id", "offset", "y").withColumnRenamed("n", "n_offset_bins")
    return fields.join(rho, "field_id", "left").withColumn("n_offset_bins", F.coalesce("n_offset_bins", F.lit(0)))


def effects_record(effects: DataFrame, least_fields: int = 150) -> DataFrame:
    """The record of :func:`row_angle_effects`: fields by their number of bins, spread of rho, the test that it exceeds 0
    (zeros ranked), the same over fields with all five bins, and two criteria."""
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    one = effects.agg(
        F.count("*").alias("n_all_fields"), F.count("rho").alias("n_analyzable_fields"), count(F.col("n_front_instances") == 0).alias("n_zero_ok_fields"),
        *(count(F.col("rho").isNotNull() & (F.col("n_offset_bins") == k)).alias(f"n_{k}_bins") for k in (3, 4, 5)), count(F.col("constant")).alias("n_constant"),
    )
    spread = stats.distribution(effects.where("rho IS NOT NULL"), "rho").select("q1", "median", "q3", "mean")
    full = tested(effects.where("n_offset_bins = 5"), "rho", 0.0, pratt=True).select(F.col("z").alias("full_z"), F.col("p").alias("full_p"))
    out = one.crossJoin(spread).crossJoin(tested(effects, "rho", 0.0, pratt=True)).crossJoin(full)  # one row each
    return out.select("*", (F.col("median") <= 0).alias("median_not_above_0"), (F.col("n_analyzable_fields") < least_fields).alias("too_few_fields"))


def recommend(predicted: DataFrame, regret: DataFrame) -> DataFrame:
    """``(field_id, instance_id, preference, config_id, regret, infeasible)``: among the applicable configurations of an
    instance the one of least predicted regret, the smaller id among equals. ``predicted(instance_id, config_id,
    preference, predicted)`` may lack configurations that no model knows; they aren't chosen."""
    rows = regret.where("applicable").join(predicted, ["instance_id", "config_id", "preference"])
    best = F.min(F.struct("predicted", "config_id", F.struct("regret", F.col("score").isNull().alias("infeasible")).alias("found"))).alias("b")
    by = rows.groupBy("field_id", "instance_id", "preference").agg(best)
    return by.select("field_id", "instance_id", "preference", "b.config_id", "b.found.regret", "b.found.infeasible")


def field_differences(choices: DataFrame, regret: DataFrame) -> DataFrame:
    """``(field_id, recommender_loss, random_loss, d)`` over instances where something was observed: a field's mean regret
    of the choices, of a random applicable configuration, and the first less half of the second."""
    mean = lambda rows, name: rows.groupBy("field_id", "instance_id").agg(F.avg("x").alias("x")).groupBy("field_id").agg(F.avg("x").alias(name))
    ours = mean(choices.where("regret IS NOT NULL").select("field_id", "instance_id", F.col("regret").alias("x")), "recommender_loss")
    random = regret.where("applicable AND regret IS NOT NULL").groupBy("field_id", "instance_id", "preference").agg(F.avg("regret").alias("x"))
    return ours.join(mean(random, "random_loss"), "field_id").withColumn("d", F.col("recommender_loss") - 0.5 * F.col("random_loss"))


def recommender_record(choices: DataFrame, regret: DataFrame, probes: list[str] = ()) -> DataFrame:
    """The record of :func:`recommend`: mean losses and differences of all fields and without the ``probes``, rates of
    choices that weren't observed ok, and the two criteria. The sign-flip test of ``d`` is ``splits.sign_flip_p``."""
    d = field_differences(choices, regret)
    track = lambda rows, tail: rows.agg(
        F.count("*").alias(f"n_fields{tail}"), F.round(F.avg("recommender_loss"), 9).alias(f"recommender_loss{tail}"), F.round(F.avg("random_loss"), 9).alias(f"random_loss{tail}"),
        F.round(F.avg("d"), 9).alias(f"mean_d{tail}"), F.round(F.median("d"), 9).alias(f"median_d{tail}"), F.round(F.avg((F.col("d") < 0).cast("double")), 9).alias(f"negative_share{tail}"),
    )
    rate = choices.agg(F.count("*").alias("n_choices"), F.sum(F.col("infeasible").cast("long")).alias("n_infeasible"))
    by = regret.where("preference = 0 AND applicable").groupBy("instance_id").agg(F.count("*").alias("a"), F.count("score").alias("o")).where("o > 0")
    random = by.agg(F.avg((F.col("a") - F.col("o")) / F.col("a")).alias("random"))
    out = track(d, "").crossJoin(track(d.where(~F.col("field_id").isin(*probes)), "_less_probes")).crossJoin(rate).crossJoin(random)  # one row each
    ours = F.col("n_infeasible") / F.col("n_choices")
    return out.select(
        *(c for c in out.columns if c != "random"), F.round(ours, 9).alias("infeasible_rate"), F.round("random", 9).alias("random_infeasible_rate"),
        (F.col("mean_d") >= 0).alias("not_below_half_random"), (ours > F.col("random")).alias("infeasible_above_random"),
    )
