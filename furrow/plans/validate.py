"""An independent check of a path, and its metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .coverage import Config, Inapplicable, Rows, Segment, Vehicle, plan

#: Fixed values: (id, unit, direction, role, change with the scale, name in papers) of the metrics.
METRICS = (
    ("path_length", "m", "minimize", "diagnostic", "linear", "path_length"),
    ("total_heading_change", "1", "minimize", "diagnostic", "invariant", "total_heading_change"),
    ("aol", "1", "minimize", "diagnostic", "inverse_linear", "heading_change_per_meter"),
    ("tortuosity", "1", "minimize", "diagnostic", "invariant", "tortuosity"),
    ("cusp_count", "count", "minimize", "diagnostic", "invariant", "cusp_count"),
    ("coverage_ratio_field", "1", "maximize", "hard_constraint", "invariant", "coverage_ratio_field"),
    ("coverage_ratio_main", "1", "maximize", "diagnostic", "invariant", "coverage_ratio_main"),
    ("overlap_ratio", "1", "minimize", "primary", "invariant", "overlap_ratio"),
    ("nonwork_normalized", "1", "minimize", "primary", "invariant", "nonwork_normalized"),
    ("outside_area", "m^2", "minimize", "hard_constraint", "quadratic", "outside_area"),
    ("collision_area", "m^2", "minimize", "hard_constraint", "quadratic", "collision_area"),
    ("L_R", "m", "minimize", "diagnostic", "linear", "L_R"),
    ("L_area", "1", "minimize", "diagnostic", "invariant", "normalized_path_length"),
    ("eta_L", "1", "minimize", "diagnostic", "invariant", "nonwork_length_ratio"),
    ("turning_overhead_ratio", "1", "minimize", "diagnostic", "invariant", "turning_overhead_ratio"),
    ("transit_length", "m", "minimize", "diagnostic", "linear", "transit_length"),
    ("headland_turn_count", "count", "minimize", "diagnostic", "invariant", "headland_turn_count"),
    ("row_crossings", "count", "minimize", "diagnostic", "invariant", "row_crossing_equivalent"),
    ("swath_count", "count", "minimize", "diagnostic", "invariant", "swath_count"),
    ("headland_area_ratio", "1", "minimize", "diagnostic", "invariant", "headland_area_ratio"),
    ("min_clearance", "m", "maximize", "diagnostic", "linear", "min_clearance"),
    ("median_clearance", "m", "maximize", "diagnostic", "linear", "median_clearance"),
    ("collision_checks", "count", "minimize", "diagnostic", "undefined", "collision_checks"),
    ("objective_evaluations", "count", "minimize", "diagnostic", "undefined", "objective_evaluations"),
    ("runtime_ms", "s", "minimize", "diagnostic", "undefined", "runtime_s"),
)


def metric(name: str) -> tuple:
    """A metric by its id or its name in papers."""
    return next(m for m in METRICS if name in (m[0], m[5]))


@dataclass
class Problem:
    field: geo.Ring
    obstacles: list[geo.Ring] = field(default_factory=list)
    forbidden: list[geo.Ring] = field(default_factory=list)
    rows: Rows | None = None


@dataclass
class Result:
    status: str
    reason: str | None = None
    metrics: dict[str, float] = field(default_factory=dict)


def _refused(status: str, reason: str) -> Result:
    return Result(status, f"validator_rejected:{reason}")


def turn_counts(segments: list[Segment]) -> int:
    """Runs of other segments that work follows; a leading run counts."""
    turns, apart = 0, False
    for s in segments:
        turns += s.kind == "WORK" and apart
        apart = s.kind != "WORK"
    return turns


def heading_changes(points: np.ndarray) -> tuple[float, int]:
    """Sum of absolute changes of heading, and reversals, of a polyline; steps of length 0 have no heading."""
    d = np.diff(points, axis=0)
    d = d[(d != 0).any(1)]
    if len(d) < 2:
        return 0.0, 0
    turn = np.arctan2(d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0], (d[:-1] * d[1:]).sum(1))
    return float(np.abs(turn).sum()), int((np.abs(np.abs(turn) - math.pi) <= 1e-9).sum())


def validate(problem: Problem, vehicle: Vehicle, segments: list[Segment], *, threshold: float = 0.0, epsilon: float = 1e-9, headland: float = 0.0) -> Result:
    """Checks in a fixed order, the first failure counts: empty, unjoined ends, collision, curvature, reverse gear,
    outside, forbidden zones, coverage; then nineteen metrics, which must be finite but for the tortuosity.

    Areas are exact for strips along straight steps, with discs of 64 sides at corners.
    """
    if not segments:
        return _refused("infeasible", "empty_path")
    if any((a.points[-1] != b.points[0]).any() and np.hypot(*(a.points[-1] - b.points[0])) > 1e-6 for a, b in zip(segments, segments[1:])):
        return _refused("constraint_violation", "discontinuous_endpoints")
    body = [geo.strip(s.points, vehicle.body) for s in segments]
    for b in body:
        if problem.obstacles and geo.overlay_areas(b, [[o] for o in problem.obstacles])["inside"] > epsilon:
            return _refused("collision", "collision")
    limit = math.inf if vehicle.radius <= 1e-9 else 1 / vehicle.radius
    if max(abs(s.curvature) for s in segments) > limit * (1 + 1e-12):
        return _refused("infeasible_kinematics", "curvature_limit")
    if any(s.reversing for s in segments) and not vehicle.can_reverse:
        return _refused("infeasible_kinematics", "reverse_without_gear")
    outside = sum(0.0 if geo.within_convex(problem.field, np.vstack([r for p in b for r in p] or [s.points])) else geo.overlay_areas(b, [[problem.field]])["outside"] for s, b in zip(segments, body))
    if outside > epsilon * 1e3:
        return _refused("constraint_violation", "outside_area")
    every = np.vstack([s.points for s in segments])
    for zone in problem.forbidden:
        if any(0 < geo.contains(zone, s.points).sum() < len(s.points) for s in segments):
            return _refused("constraint_violation", "forbidden_crossing")
    work = [p for s in segments if s.kind == "WORK" for p in geo.strip(s.points, vehicle.width)]
    free = [[problem.field, *problem.obstacles]]
    cover = geo.overlay_areas(work, free)
    area = cover["clip"]
    if cover["inside"] / area + 1e-12 < threshold:
        return _refused("constraint_violation", "coverage_threshold")
    lengths = {k: sum(s.length for s in segments if s.kind == k) for k in ("WORK", "TURN", "TRANSIT")}
    total = sum(lengths.values())
    other = total - lengths["WORK"]
    change, cusps = heading_changes(every)
    chord = float(np.hypot(*(every[-1] - every[0])))
    crossed = 0.0
    if problem.rows:
        normal = np.array([-math.sin(problem.rows.direction), math.cos(problem.rows.direction)])
        crossed = sum(abs(float((s.points[-1] - s.points[0]) @ normal)) for s in segments) / problem.rows.spacing
    main = main_area([problem.field, *problem.obstacles], headland)
    metrics = {
        "coverage_ratio_field": cover["inside"] / area, "coverage_ratio_main": min(1.0, cover["inside"] / main) if main > 0 else 0.0, "overlap_ratio": (cover["sum"] - cover["inside"]) / area,
        "nonwork_normalized": other * vehicle.width / area, "outside_area": outside, "collision_area": 0.0, "L_R": total, "L_area": total * vehicle.width / area,
        "eta_L": other / total if total else 0.0, "turning_overhead_ratio": lengths["TURN"] / total if total else 0.0, "swath_count": float(sum(s.kind == "WORK" for s in segments)),
        "path_length": total, "transit_length": sum(float(np.hypot(*(s.points[-1] - s.points[0]))) for s in segments if s.kind == "TRANSIT"), "headland_turn_count": float(turn_counts(segments)),
        "row_crossings": crossed, "total_heading_change": change, "aol": change / total if total else 0.0,
        "tortuosity": total / chord if chord else math.inf if total else 1.0, "cusp_count": float(cusps),
    }
    if not all(math.isfinite(v) for k, v in metrics.items() if k != "tortuosity"):
        return _refused("numerical_error", "nonfinite_metric")
    return Result("ok", None, metrics)


def main_area(rings: list[geo.Ring], headland: float, lines: int = 2000) -> float:
    """Area of what a headland leaves, by lines at equal distances (exact without one)."""
    if headland <= 0:
        return abs(geo.signed_area(rings[0])) - sum(abs(geo.signed_area(h)) for h in rings[1:])
    low, high = float(rings[0][:, 1].min()), float(rings[0][:, 1].max())
    step = (high - low) / lines
    return step * math.fsum(geo.eroded_lengths(rings, low + (np.arange(lines) + 0.5) * step, (1.0, 0.0), headland))


def zero_radius_length(swaths: list) -> float:
    """Length with turns on the spot: the swaths and the straight links between them."""
    return sum(math.dist(*s) for s in swaths) + sum(math.dist(a[1], b[0]) for a, b in zip(swaths, swaths[1:]))


_CHECKED = ("coverage_ratio_field", "overlap_ratio", "headland_turn_count", "swath_count", "path_length", "row_crossings")


def validated_runs(instances: DataFrame, configs: list[Config], vehicles: list[Vehicle], threshold: float = 0.0) -> DataFrame:
    """``coverage.run_matrix`` of ``instances(instance_id, wkt, vehicle_index, row_direction, row_spacing)`` with every path
    checked by :func:`validate`, whose verdict is the run's status; objectives and metrics are null unless it is ok.

    A refusal is ``not_applicable`` where the configuration has no headland, else keeps its named reason; an exception is
    a crash. An instance's holes are its obstacles.
    """
    names = instances.sparkSession.createDataFrame([(k, c.config_id) for k, c in enumerate(configs)], "place int, config_id string")
    grid = instances.crossJoin(F.broadcast(names))  # a list of settings
    columns = ["instance_id", "config_id", "vehicle_index", "runstatus", "failure_reason", "work_m", *_CHECKED]

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                config, vehicle = configs[r.place], vehicles[r.vehicle_index]
                row: dict = dict.fromkeys(columns) | {"instance_id": r.instance_id, "config_id": r.config_id, "vehicle_index": r.vehicle_index, "runstatus": "crash"}
                try:
                    rings = geo.parse_polygon(r.wkt)
                    rows = None if r.row_spacing is None or math.isnan(r.row_spacing) else Rows(r.row_direction, r.row_spacing)
                    planned = plan(rings, vehicle, config, rows)
                    found = validate(Problem(rings[0], rings[1:], rows=rows), vehicle, planned["segments"], threshold=threshold, headland=float(config.params.get("headland_width", 0.0)))
                    row |= {"runstatus": found.status, "failure_reason": found.reason}
                    if found.status == "ok":
                        row |= {"work_m": planned["work_m"]} | {k: found.metrics[k] for k in _CHECKED}
                    elif config.headland == "no_headland":
                        row |= {"runstatus": "not_applicable"}
                except Inapplicable as e:
                    row |= {"runstatus": "not_applicable", "failure_reason": str(e)}
                except Exception as e:  # noqa: BLE001  failures are rows
                    row["failure_reason"] = f"{type(e).__name__}: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=columns).astype({k: float for k in ("work_m", *_CHECKED)})

    return grid.mapInPandas(run, "instance_id string, config_id string, vehicle_index long, runstatus string, failure_reason string, " + ", ".join(f"{k} double" for k in ("work_m", *_CHECKED)))
