"""The run matrix, one row for each instance and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTIVES = ("path_length", "headland_turns", "row_crossings")
#: References declared beforehand, never taken from observations.
REFERENCE = {"path_length": 120_000.0, "headland_turns": 60.0, "row_crossings": 60.0}


def runs_view(lineitem: DataFrame) -> DataFrame:
    """Line items in the shape of a run matrix: a supplier is a field, its return flags and line statuses are its
    instances, line numbers are configurations. Objectives are minima and counts, exact in any order of rows.

    Configuration c7 doesn't apply to vehicle 0; other statuses come from the number of rows.
    """
    number = F.col("l_linenumber")
    by = lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count("*").alias("n"), F.min("l_extendedprice").alias("a"), (F.min("l_quantity") + 1.0).alias("c")
    )
    vehicle = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    static = (number == 7) & (vehicle == 0)
    collapsed = F.col("n") % 13 == 5  # not applicable here, though the configuration goes with the vehicle
    status = F.when(static | (F.col("n") % 5 == 3) | collapsed, "not_applicable").when(F.col("n") % 7 == 4, "timeout").when(F.col("n") % 11 == 6, "collision").otherwise("ok")
    reason = F.when(static, "needs a reverse gear").when(F.col("n") % 5 == 3, "validator_rejected:outside_area").when(collapsed, "the headland leaves nothing")
    out = by.select(
        F.col("l_suppkey").cast("string").alias("field_id"),
        F.concat_ws(":", F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus").alias("instance_id"),
        F.concat(F.lit("c"), number.cast("string")).alias("config_id"),
        vehicle.cast("long").alias("vehicle_index"),
        status.alias("runstatus"), reason.alias("failure_reason"), "a", "n", "c",
    )
    ok = F.col("runstatus") == "ok"
    for name, source in zip(OBJECTIVES, ("a", "n", "c")):
        out = out.withColumn(name, F.when(ok, F.col(source).cast("double")))
    for name, value in REFERENCE.items():
        out = out.withColumn(f"ref_{name}", F.lit(value))
    return out.drop("a", "n", "c")


def union_sparse(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the sorted union of their columns, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def selected(runs: DataFrame, fields: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the runs of ``fields(field_id)`` alone; a column or a field that the matrix lacks is an error.

    The semi join keeps rows of other fields from being read further than the scan; where ``fields`` is small it is
    broadcast and its names are pushed to the scan as a runtime filter.
    """
    if missing := sorted({"field_id", *columns} - set(runs.columns)):
        raise ValueError(f"the matrix lacks {missing}")
    asked = fields.select("field_id").distinct()
    lost = asked.join(runs.select("field_id").distinct(), "field_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"the matrix lacks fields such as {sorted(r.field_id for r in lost)}")
    return runs.join(asked, "field_id", "left_semi").select(*columns)


def read_selected(spark: SparkSession, path: str, field_ids: list[str], columns: list[str]) -> DataFrame:
    """:func:`selected` of a written matrix for a list of fields, which goes to the scan as a pushed predicate; a row of
    another field is an error, so a holdout can't leak."""
    if not field_ids:
        raise ValueError("no field was asked for")
    runs = spark.read.parquet(path)
    if missing := sorted({"field_id", *columns} - set(runs.columns)):
        raise ValueError(f"the matrix lacks {missing}")
    allowed = F.col("field_id").isin(*sorted(set(field_ids)))
    rows = runs.select(*dict.fromkeys(["field_id", *columns])).where(allowed)
    found = {r.field_id for r in rows.select("field_id").distinct().collect()}  # at most those asked for
    if lost := sorted(set(field_ids) - found):
        raise ValueError(f"the matrix lacks fields {lost}")
    return rows.where(F.when(allowed, F.lit(True)).otherwise(F.raise_error(F.lit("a field that was not asked for")).cast("boolean"))).select(*columns)
