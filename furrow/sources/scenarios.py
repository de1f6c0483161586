"""Scenarios of the algorithm-selection exchange format: for each objective a folder of its description, runs, feature
values, feature costs and folds, one file each."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import hash_fold
from .runs import OBJECTIVES
from .sinks import exchange_runs, quoted

FEATURE, COST = "feature__", "feature_cost__"
_STATUSES = "{ok,timeout,memout,not_applicable,crash,other}"


def relation_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows as lines of the format, in order; missing values are "?"."""
    kinds = dict(rows.dtypes)
    quote = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z0-9._-]+$"), F.col(c)).otherwise(F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    line = F.concat_ws(",", *(F.coalesce(quote(c) if kinds[c] == "string" else F.col(c).cast("string"), F.lit("?")) for c in rows.columns))
    return rows.orderBy(*order).select(line.alias("line"))


def write_relation(rows: DataFrame, path: Path, relation: str, order: list[str], kinds: dict[str, str] | None = None) -> None:
    """One file of a relation; the lines come to the writer a partition at a time."""
    types = {c: "STRING" if t == "string" else "NUMERIC" for c, t in rows.dtypes} | (kinds or {})
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([f"@RELATION {quoted(relation)}", *(f"@ATTRIBUTE {quoted(c)} {types[c]}" for c in rows.columns), "@DATA"]) + "\n")
        for r in relation_lines(rows, order).toLocalIterator():
            f.write(r.line + "\n")


def _described(name: str, stratum: str, crossable: bool, folds: int) -> str:
    return (
        f"scenario_id: {name}-{stratum}\nrow_crossable: {str(crossable).lower()}\nmetric: solution_quality\nmaximize: false\n"
        "note: three objectives give three scenarios of the same instances, runs, features and folds; they are not weighted into one\n"
        "note: whether rows can be crossed changes what is feasible, so each case has scenarios of its own\n"
        f"note: folds are by field, since a field's instances share most features\ncv_folds: {folds}\n"
    )


def write_scenarios(runs: DataFrame, path: str, *, cv_folds: int, row_crossable: bool, name: str = "coverage") -> list[Path]:
    """Writes the three scenarios of a run matrix and returns their folders.

    Columns that begin with "feature__" are features and those with "feature_cost__" their costs, one value an
    instance; runtime is the column ``planning_s`` if there is one. A field's instances share a fold.
    """
    stratum = "crossable" if row_crossable else "uncrossable"
    features, costs = ([c for c in sorted(runs.columns) if c.startswith(p)] for p in (FEATURE, COST))
    by = runs.groupBy("instance_id").agg(F.first("field_id").alias("field_id"), *(F.max(c).alias(c) for c in features + costs))
    plain = lambda cs, p: by.select("instance_id", *(F.col(c).cast("double").alias(c.removeprefix(p)) for c in cs))
    cv = by.select("instance_id", F.lit(1).cast("long").alias("repetition"), hash_fold(F.col("field_id"), cv_folds).alias("fold"))
    seconds = (F.col("planning_s") if "planning_s" in runs.columns else F.lit(None)).cast("double")
    keyed = runs.select("instance_id", F.col("config_id").alias("algorithm"), seconds.alias("runtime"))
    out = []
    for objective in OBJECTIVES:
        folder = Path(path) / stratum / objective
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "description.txt").write_text(_described(f"{name}-{objective}", stratum, row_crossable, cv_folds), encoding="utf-8")
        told = exchange_runs(runs, objective).join(keyed, ["instance_id", "algorithm"])
        told = told.select("instance_id", "repetition", "algorithm", "runtime", "runstatus", F.col(objective).alias("quality"))
        write_relation(told, folder / "algorithm_runs.arff", f"{name}_{objective}_runs", ["instance_id", "algorithm"], {"runstatus": _STATUSES})
        write_relation(plain(features, FEATURE), folder / "feature_values.arff", f"{name}_{objective}_features", ["instance_id"])
        write_relation(plain(costs, COST), folder / "feature_costs.arff", f"{name}_{objective}_feature_costs", ["instance_id"])
        write_relation(cv, folder / "cv.arff", f"{name}_{objective}_cv", ["instance_id"])
        out.append(folder)
    return out
