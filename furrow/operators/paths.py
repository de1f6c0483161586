"""Metrics of paths given as points or segments in order, by windows over each path."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import row_crossings as crossing
from ..functions.scalars import wrapped


def polyline_metrics(points: DataFrame, key: str = "path_id", order: str = "seq", cusp_tolerance: float = 1e-9) -> DataFrame:
    """For each polyline ``(path_id, seq, x, y)``: points, length, heading change, its rate by length, tortuosity and
    cusps. Steps of length 0 have no heading; a path of one point has tortuosity 1, a closed one infinite."""
    w = Window.partitionBy(key).orderBy(order)
    steps = points.select(key, order, "x", "y", (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy"))
    steps = steps.withColumn("d", F.hypot("dx", "dy"))
    ends = steps.groupBy(key).agg(
        F.count("*").alias("n_points"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"),
        F.min(F.struct(F.col(order), "x", "y")).alias("first"), F.max(F.struct(F.col(order), "x", "y")).alias("last"),
    )
    moves = steps.where("dx <> 0 OR dy <> 0").withColumn("heading", F.atan2("dy", "dx"))
    turn = F.abs(wrapped(F.lead("heading").over(w) - F.col("heading")))
    angle = F.abs(F.atan2(F.col("dx") * F.lead("dy").over(w) - F.col("dy") * F.lead("dx").over(w), F.col("dx") * F.lead("dx").over(w) + F.col("dy") * F.lead("dy").over(w)))
    turns = moves.select(key, turn.alias("turn"), (F.abs(angle - math.pi) <= cusp_tolerance).alias("cusp")).groupBy(key).agg(F.sum("turn").alias("change"), F.sum(F.col("cusp").cast("long")).alias("cusps"))
    out = ends.join(turns, key, "left")
    chord = F.hypot(F.col("last.x") - F.col("first.x"), F.col("last.y") - F.col("first.y"))
    change = F.coalesce("change", F.lit(0.0))
    tortuosity = F.when(F.col("n_points") < 2, F.lit(1.0)).when(chord > 0, F.col("length") / chord).when(F.col("length") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return out.select(key, "n_points", "length", change.alias("heading_change"), F.when(F.col("length") > 0, change / F.col("length")).otherwise(F.lit(0.0)).alias("aol"), tortuosity.alias("tortuosity"), F.coalesce("cusps", F.lit(0)).alias("cusps"))


def densify(points: DataFrame, step: float, key: str = "path_id", order: str = "seq") -> DataFrame:
    """Each step cut into equal parts of at most ``step``; ``seq`` counts anew from 0."""
    if step <= 0:
        raise ValueError("a step is above 0")
    w = Window.partitionBy(key).orderBy(order)
    s = points.select(key, F.col(order).alias("o"), "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) / step)).cast("int")
    s = s.withColumn("n", F.when(F.col("x2").isNull(), 1).otherwise(n)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.col("k") / F.col("n")
    at = lambda c: F.col(c) + F.coalesce((F.col(f"{c}2") - F.col(c)) * part, F.lit(0.0))
    return s.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("o", "k")) - 1).alias("seq"), at("x").alias("x"), at("y").alias("y"))


def resample(points: DataFrame, count: int, key: str = "path_id", order: str = "seq") -> DataFrame:
    """``count`` points at equal arc lengths from the first to the last."""
    w = Window.partitionBy(key).orderBy(order)
    s = points.select(key, F.col(order).alias("o"), "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).withColumn("d", F.coalesce(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), F.lit(0.0)))
    s = s.withColumn("end", F.sum("d").over(w2 := Window.partitionBy(key).orderBy("o").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("d"))
    s = s.withColumn("total", F.sum("d").over(Window.partitionBy(key)))
    gap = F.col("total") / max(1, count - 1)
    last = F.col("x2").isNull()
    # a segment holds the marks from its start up to its end; the last point holds the last mark
    first = F.ceil(F.when(gap > 0, F.col("start") / gap).otherwise(0.0)).cast("int")
    upto = F.when(last, F.lit(count - 1)).otherwise(F.least(F.ceil(F.when(gap > 0, F.col("end") / gap).otherwise(0.0)).cast("int") - 1, F.lit(count - 2)))
    first = F.when(last, F.when(gap > 0, F.lit(count - 1)).otherwise(F.lit(0))).otherwise(first)
    s = s.withColumn("first", first).withColumn("upto", upto).where("first <= upto").withColumn("seq", F.explode(F.sequence("first", "upto")))
    part = F.when(F.col("d") > 0, (F.col("seq") * gap - F.col("start")) / F.col("d")).otherwise(F.lit(0.0))
    at = lambda c: F.col(c) + F.coalesce((F.col(f"{c}2") - F.col(c)) * part, F.lit(0.0))
    return s.select(key, "seq", at("x").alias("x"), at("y").alias("y"))


def segment_metrics(segments: DataFrame, key: str = "path_id", order: str = "seq") -> DataFrame:
    """For each path of ``(path_id, seq, kind, length, cell)``, kind WORK or another, cell that of a work segment:
    headland turns and the transfers before, between and after work segments, within and between cells.

    A run of other segments between two work segments is one turn; a leading run counts as a headland turn, too,
    once work follows. Paths without work have transfers that can't be told apart: an error.
    """
    work = F.col("kind") == "WORK"
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    s = segments.select(
        key, F.col(order).alias("o"), "kind", "length",
        F.coalesce(F.sum(work.cast("long")).over(before), F.lit(0)).alias("done"), F.coalesce(F.sum(work.cast("long")).over(after), F.lit(0)).alias("ahead"),
        F.lag(F.col("kind")).over(w).alias("previous"),
        F.last(F.when(work, F.col("cell")), ignorenulls=True).over(before).alias("cell_before"), F.first(F.when(work, F.col("cell")), ignorenulls=True).over(after).alias("cell_after"),
        F.when(work, F.col("cell")).alias("cell"),
    )
    other = ~work
    inner = other & (F.col("done") > 0) & (F.col("ahead") > 0)
    same = F.col("cell_before").eqNullSafe(F.col("cell_after"))
    add = lambda c: F.sum(F.when(c, F.col("length")).otherwise(0.0))
    # each work segment but the first ends one transfer, of length 0 if it follows work at once
    joined = work & (F.col("done") > 0)
    ends_same = F.col("cell_before").eqNullSafe(F.col("cell"))
    by = s.groupBy(key).agg(
        F.sum(work.cast("long")).alias("n_work"), F.sum((work & (F.col("previous") != "WORK")).cast("long")).alias("headland_turns"),
        add(other & (F.col("done") == 0)).alias("entry_m"), add(inner & same).alias("turn_m"), add(inner & ~same).alias("inter_cell_m"), add(other & (F.col("ahead") == 0) & (F.col("done") > 0)).alias("exit_m"),
        F.sum((joined & ends_same).cast("long")).alias("n_turns"), F.sum((joined & ~ends_same).cast("long")).alias("n_inter_cell"), add(other).alias("transfer_m"), add(work).alias("work_m"),
    )
    return by.withColumn("n_work", F.when(F.col("n_work") > 0, F.col("n_work")).otherwise(F.raise_error(F.lit("a path without work has transfers that can't be told apart")).cast("long")))


def crossings(segments: DataFrame, direction: float, spacing: float, key: str = "path_id") -> DataFrame:
    """Rows that each path of ``(path_id, x1, y1, x2, y2)`` crosses, by the chords of its segments."""
    one = crossing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(direction), F.lit(spacing))
    return segments.groupBy(key).agg(F.sum(one).alias("crossings"))


def tour_lengths(tours: DataFrame, nodes: DataFrame, distance, key: str = "tour_id") -> DataFrame:
    """Length of each closed tour ``(tour_id, seq, node_id)`` over ``nodes(node_id, x, y)``; ``distance`` maps two
    columns of differences to one."""
    w = Window.partitionBy(key).orderBy("seq")
    at = tours.join(nodes, "node_id")
    first = F.first(F.struct("x", "y")).over(w)
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(w), first)
    legs = at.select(key, (nxt["x"] - F.col("x")).alias("dx"), (nxt["y"] - F.col("y")).alias("dy"))
    return legs.groupBy(key).agg(F.sum(distance(F.col("dx"), F.col("dy"))).alias("length"), F.count("*").alias("n_nodes"))


def nearest_places(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest of some places, the first among equals, and the distance. All points go outward from where
    they lie among the places, sorted along their wider side, until the next place is further along it than the nearest one."""
    if np.ptp(cx) < np.ptp(cy):
        x, y, cx, cy = y, x, cy, cx
    _, first = np.unique(np.column_stack([cx, cy]), axis=0, return_index=True)  # along the first column; of equal places the first
    sx, sy = cx[first], cy[first]
    at = np.searchsorted(sx, x)
    best, found = np.full(len(x), np.inf), np.full(len(x), len(cx))
    going, step = {1: np.arange(len(x)), -1: np.arange(len(x))}, 0
    while any(map(len, going.values())):
        for side, of in going.items():
            j = at[of] + (step if side > 0 else -1 - step)
            on = (j >= 0) & (j < len(sx))
            of, j = of[on], j[on]
            dx = sx[j] - x[of]
            on = np.abs(dx) * (1 - 1e-12) <= best[of]
            of, j, dx = of[on], j[on], dx[on]
            dy = sy[j] - y[of]
            d = np.sqrt(dx * dx + dy * dy)
            better = (d < best[of]) | ((d == best[of]) & (first[j] < found[of]))
            best[of[better]], found[of[better]] = d[better], first[j[better]]
            going[side] = of
        step += 1
    return found, best


def nearest_cells(segments: DataFrame, cells: DataFrame, key: str = "field_id") -> DataFrame:
    """``(segment_id, cell, distance)``: the nearest of a field's ``cells(cell, cx, cy)`` to a segment's middle ``(x, y)``, the
    smaller among equals; null where the field has none. A cell without a place is taken if the field has no other, and then, as
    for a segment without one, the distance is null.

    No pair is written anywhere: a field's segments are dealt out to as many parts as there are cores, each with all its cells.
    """
    parts = segments.sparkSession.sparkContext.defaultParallelism
    left = segments.select(F.col(key).alias("k"), F.pmod(F.hash("segment_id"), F.lit(parts)).alias("part"), "segment_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    right = cells.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cell", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"segment_id": a["segment_id"], "cell": None, "distance": np.nan})
        if len(a) and len(b):
            b = b.sort_values("cell")
            x, y, cx, cy = (v.to_numpy(float) for v in (a["x"], a["y"], b["cx"], b["cy"]))
            known, placed = np.isfinite(x) & np.isfinite(y), np.isfinite(cx) & np.isfinite(cy)
            names = b["cell"].to_numpy(object)
            near, distance = np.full(len(a), names[0]), np.full(len(a), np.nan)
            if placed.any():
                place, distance[known] = nearest_places(x[known], y[known], cx[placed], cy[placed])
                near[known] = names[placed][place]
            out = out.assign(cell=near, distance=distance)
        return out

    kinds = dict(segments.dtypes) | dict(cells.dtypes)
    n = 4 * parts
    both = left.repartition(n, "k", "part").groupBy("k", "part").cogroup(right.repartition(n, "k", "part").groupBy("k", "part"))
    return both.applyInPandas(run, f"segment_id {kinds['segment_id']}, cell {kinds['cell']}, distance double")
