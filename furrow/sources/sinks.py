"""Sinks: run tables, checkpoints, field corpora and the algorithm-selection exchange format."""

from __future__ import annotations

import gzip
import json
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import exchange_status
from ..operators.pareto import front, points, with_status
from ..operators.splits import chain, content_hash
from .runs import OBJECTIVES


def write_runs(runs: DataFrame, path: str) -> None:
    """Columns in order, zstd."""
    runs.select(*sorted(runs.columns)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_checkpoint(lines: list[dict], path: str) -> None:
    """Gzipped JSON lines, the same bytes for the same rows."""
    text = "".join(json.dumps(x, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n" for x in lines)
    with open(path, "wb") as f, gzip.GzipFile(fileobj=f, mode="wb", mtime=0, filename="") as z:
        z.write(text.encode())


def write_once(path: str, content: str) -> None:
    """Writes a result; another content than the one that is there is refused."""
    p = Path(path)
    if p.exists() and p.read_text(encoding="utf-8") != content:
        raise FileExistsError(f"{path} holds another result")
    p.write_text(content, encoding="utf-8")


def manifest(counts: dict) -> dict:
    return {**counts, "manifest_hash": content_hash(counts)}


def write_log(payloads: list, path: str) -> None:
    Path(path).write_text("".join(json.dumps(e, sort_keys=True, ensure_ascii=False) + "\n" for e in chain(payloads)), encoding="utf-8")


def export_fields(fields: DataFrame, path: str, licenses: tuple[str, ...]) -> dict:
    """Writes the fields that are fit and whose licence is allowed; returns the manifest of the counts."""
    allowed = F.col("license").isin(*licenses)
    n = fields.agg(F.count("*").alias("input"), F.sum(F.col("reason").isNotNull().cast("long")).alias("quarantined"), F.sum((F.col("reason").isNull() & ~allowed).cast("long")).alias("filtered")).first()
    fields.where(F.col("reason").isNull() & allowed).drop("reason").write.mode("overwrite").json(path)
    counts = {k: int(n[k] or 0) for k in ("input", "quarantined", "filtered")}
    return manifest({**counts, "exported": counts["input"] - counts["quarantined"] - counts["filtered"]})


def quoted(text: str) -> str:
    """A value of the exchange format, in quotes if it isn't plain."""
    return text if text and all(c.isalnum() or c in "._-" for c in text) else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def exchange_runs(runs: DataFrame, objective: str) -> DataFrame:
    """``(instance_id, repetition, algorithm, objective, runstatus)``, a row for each run; the objective is null unless ok."""
    rows = with_status(runs)
    return rows.select("instance_id", F.lit(1).cast("long").alias("repetition"), F.col("config_id").alias("algorithm"), F.when(F.col("status") == "ok", F.col(objective)).alias(objective), exchange_status(F.col("status")).alias("runstatus"))


def write_exchange(rows: DataFrame, path: str, relation: str, order: list[str]) -> None:
    """A relation in the exchange format, sorted; missing values are "?". The header is the first line of the parts."""
    kinds = dict(rows.dtypes)
    head = [f"@RELATION {quoted(relation)}", *(f"@ATTRIBUTE {quoted(c)} {'STRING' if kinds[c] == 'string' else 'NUMERIC'}" for c in rows.columns), "@DATA"]
    quote = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z0-9._-]+$"), F.col(c)).otherwise(F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    line = F.concat_ws(",", *(F.coalesce(quote(c) if kinds[c] == "string" else F.col(c).cast("string"), F.lit("?")) for c in rows.columns))
    body = rows.orderBy(*order).select(line.alias("value"))
    spark = rows.sparkSession
    top = spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    top.write.mode("overwrite").text(f"{path}/header")
    body.write.mode("overwrite").text(f"{path}/data")  # parts in order


def write_crosstab(table: DataFrame, path: str) -> None:
    """A crosstab of settings, such as ``pools.crosstab``, as JSON and as a Markdown table, in order of all columns; it has a row
    for each configuration and vehicle."""
    rows = [r.asDict() for r in table.orderBy(*table.columns).collect()]
    write_once(f"{path}.json", json.dumps(rows, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    cells = [table.columns, ["---"] * len(table.columns), *([str(r[c]) for c in table.columns] for r in rows)]
    write_once(f"{path}.md", "".join("| " + " | ".join(x) + " |\n" for x in cells))


def _projected(x: float, y: float, z: float, size: float = 300.0) -> tuple[float, float]:
    """A point of the unit cube in the plane: the third axis goes up, the second slantwise."""
    return round(40 + size * (x + 0.5 * y), 2), round(40 + size * (1.5 - 0.35 * y - z), 2)


def write_front_figure(runs: DataFrame, instance_id: str, path: str) -> None:
    """One instance's points as CSV, each with whether it lies on the front, and as an SVG of the objectives over their
    references, clipped to 1. An instance has a point for each configuration at most; one without points is an error."""
    rows = points(runs).where(F.col("instance_id") == instance_id)
    best = {r.config_id for r in front(rows).select("config_id").collect()}
    told = sorted(rows.select("config_id", *OBJECTIVES, *(f"ref_{o}" for o in OBJECTIVES)).collect())
    if not told:
        raise ValueError(f"{instance_id} has no point")
    lines = [",".join(["config_id", *OBJECTIVES, "is_pareto"])] + [",".join([r.config_id, *(repr(r[o]) for o in OBJECTIVES), str(r.config_id in best).lower()]) for r in told]
    write_once(f"{path}.csv", "\n".join(lines) + "\n")
    marks = []
    for r in told:
        x, y = _projected(*(min(max(r[o] / r[f"ref_{o}"], 0.0), 1.0) for o in OBJECTIVES))
        marks.append(f'<circle cx="{x}" cy="{y}" r="{6 if r.config_id in best else 4}" fill="{"#1b6ca8" if r.config_id in best else "#bbbbbb"}"><title>{escape(r.config_id)}</title></circle>')
    axes = "".join('<line x1="{}" y1="{}" x2="{}" y2="{}" stroke="#888888"/>'.format(*_projected(0, 0, 0), *_projected(*end)) for end in ((1, 0, 0), (0, 1, 0), (0, 0, 1)))
    write_once(f"{path}.svg", f'<svg xmlns="http://www.w3.org/2000/svg" width="540" height="540">{axes}{"".join(marks)}</svg>\n')


def write_assignment(evidence: dict, path: str) -> None:
    """Fold evidence as sorted JSON; another assignment in its place is refused."""
    write_once(path, json.dumps(evidence, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
