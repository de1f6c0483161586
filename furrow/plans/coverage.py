"""Coverage plans: from a field and a configuration to swaths, a route, a path and its metrics."""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kinematics as kin
from ..operators.splits import content_hash

FEATURES = "field_id long, area_m2 double, perimeter_area_ratio double, convexity_deficiency double, elongation double, reflex_vertex_count long"


@dataclass(frozen=True)
class Vehicle:
    width: float
    body: float
    radius: float
    can_reverse: bool = False


@dataclass(frozen=True)
class Config:
    """One algorithm for each slot, and parameters."""

    decomposition: str = "no_decomposition"
    headland: str = "uniform_headland"
    swath: str = "min_width"
    route: str = "boustrophedon_order"
    path: str = "dubins_transit"
    params: dict = field(default_factory=lambda: {"headland_width": 8.0})

    @property
    def config_id(self) -> str:
        return content_hash(asdict(self))


@dataclass(frozen=True)
class Rows:
    direction: float
    spacing: float


#: The algorithms that each slot knows.
CATALOGUE = {
    "decomposition": ("no_decomposition", "boustrophedon_cells"),
    "headland": ("uniform_headland", "no_headland"),
    "swath": ("fixed_angle", "principal_axis", "min_width", "longest_edge", "row_aligned"),
    "route": ("boustrophedon_order", "skip_one_order", "rural_postman_greedy"),
    "path": ("dubins_transit", "reeds_shepp_transit"),
}
_U, _D = {"decomposition": "no_decomposition", "headland": "uniform_headland", "route": "boustrophedon_order", "path": "dubins_transit"}, {"headland_width": 8.0}


def standard_configs() -> list[Config]:
    """The thirteen frozen configurations."""
    make = lambda swath, params=None, **slots: Config(**{**_U, **slots, "swath": swath, "params": {**_D, **(params or {})}})
    return [
        make("min_width"), make("principal_axis"), make("longest_edge"), make("fixed_angle", {"angle": 0.0}), make("fixed_angle", {"angle": math.pi / 2}),
        make("min_width", route="skip_one_order"), make("min_width", route="rural_postman_greedy"), make("min_width", decomposition="boustrophedon_cells"),
        make("min_width", {"headland_width": 12.0}), make("row_aligned"), make("row_aligned", route="skip_one_order"), make("row_aligned", path="reeds_shepp_transit"),
        make("min_width", headland="no_headland", path="reeds_shepp_transit"),
    ]


class Inapplicable(ValueError):
    """A configuration that doesn't fit the field or the vehicle."""


def direction(rings: list[geo.Ring], config: Config, rows: Rows | None) -> float:
    if config.swath == "fixed_angle":
        return float(config.params["angle"])
    if config.swath == "row_aligned":
        if rows is None:
            raise Inapplicable("there are no rows")
        return rows.direction
    of = {"principal_axis": geo.principal_angle, "min_width": geo.min_width_angle, "longest_edge": geo.longest_edge_angle}
    return of[config.swath](rings[0])


def cells(rings: list[geo.Ring], angle: float, offsets: list[float]) -> list[list[int]]:
    """Sweep lines' parts grouped into cells: a line of as many parts as the one before continues its cells, each part
    the one it overlaps; where the number changes, new cells begin. ``offsets`` are those of the lines, in order."""
    u = geo.canonical(angle)
    before: list[tuple[float, float]] = []
    numbers: list[int] = []
    out, fresh = [], 0
    for at in offsets:
        parts = geo.inner_intervals(rings, at, u)
        goes_on = len(parts) == len(before) and all(a < d and c < b for (a, b), (c, d) in zip(parts, before))
        if not goes_on:
            numbers = list(range(fresh, fresh + len(parts)))
            fresh += len(parts)
        out.append(numbers)
        before = parts
    return out


def order(swaths: list, route: str, angle: float, radius: float, params: dict) -> list[tuple[int, bool]]:
    """Places of swaths in the order of driving, and whether each is driven forwards."""
    n = range(len(swaths))
    if route == "ranked_swath_order":
        ranks = {k: params.get(f"rank:{k}") for k in n}
        if None in ranks.values():
            raise Inapplicable("a swath has no rank")
        return [(k, i % 2 == 0) for i, k in enumerate(sorted(n, key=lambda k: (ranks[k], k)))]
    u = geo.canonical(angle)
    middle = {k: ((swaths[k][0][0] + swaths[k][1][0]) * -u[1] + (swaths[k][0][1] + swaths[k][1][1]) * u[0]) / 2 for k in n}
    if route == "boustrophedon_order":
        return [(k, i % 2 == 0) for i, k in enumerate(sorted(n, key=lambda k: (round(middle[k], 9), k)))]
    if route == "skip_one_order":
        return [(k, i % 2 == 0) for part in (list(n)[::2], list(n)[1::2]) for i, k in enumerate(part)]
    if route != "rural_postman_greedy":
        raise Inapplicable(f"unknown route {route}")
    out, left = [(0, True)], set(n) - {0}
    while left:
        k, ahead = out[-1]
        pose = _pose(swaths[k], ahead, True)
        k, ahead = min(((k, e) for k in left for e in (True, False)), key=lambda o: (kin.dubins(pose, _pose(swaths[o[0]], o[1], False), radius)[0].length, o[0], not o[1]))
        out.append((k, ahead))
        left.discard(k)
    return out


@dataclass
class Segment:
    """A piece of a path: WORK, TURN or TRANSIT, its points, the curvature it declares, and whether it backs up."""

    kind: str
    points: np.ndarray
    curvature: float = 0.0
    reversing: bool = False

    @property
    def length(self) -> float:
        return float(np.hypot(*np.diff(self.points, axis=0).T).sum())


def _driven(swath, ahead: bool):
    return swath if ahead else swath[::-1]


def _pose(swath, ahead: bool, leave: bool) -> kin.Pose:
    a, b = swath if ahead else swath[::-1]
    p = b if leave else a
    return (*p, math.atan2(b[1] - a[1], b[0] - a[0]))


def _inside(rings: list[geo.Ring], points: np.ndarray, margin: float) -> bool:
    free = geo.contains(rings[0], points)
    for h in rings[1:]:
        free &= ~geo.contains(h, points)
    return bool(free.all()) and all((geo.distance_to_edges(r, points) >= margin - 1e-6).all() for r in rings)


def plan(rings: list[geo.Ring], vehicle: Vehicle, config: Config, rows: Rows | None = None, *, multiplier: float = 1.0, penalty: float = 0.0, step: float = 0.5, swaths: list | None = None) -> dict:
    """Swaths, route, path and metrics of one field.

    The vehicle's centre must stay inside the field, half its body from its sides and holes; this is checked on
    points at most ``step`` apart. Raises :class:`Inapplicable` where the configuration doesn't fit. ``swaths`` are those
    that :func:`geo.swaths` gives for the configuration, if they are known.
    """
    if config.path == "reeds_shepp_transit" and not vehicle.can_reverse:
        raise Inapplicable("the path needs a reverse gear")
    if config.path == "dubins_transit" and vehicle.radius <= 1e-9:
        raise Inapplicable("the path needs a turning circle")
    margin = float(config.params["headland_width"]) if config.headland == "uniform_headland" else vehicle.body / 2
    angle = direction(rings, config, rows)
    if swaths is None:
        swaths = geo.swaths(rings, angle, vehicle.width, margin)
    if not swaths:
        raise Inapplicable("the headland leaves nothing")
    if config.decomposition == "boustrophedon_cells":
        u = geo.canonical(angle)
        at = [round((s[0][0] * -u[1] + s[0][1] * u[0]), 9) for s in swaths]
        lines = sorted(set(at))
        parts = dict(zip(lines, cells(rings, angle, lines)))
        seen: dict = {}
        cell = []
        for a in at:
            i = seen[a] = seen.get(a, -1) + 1
            cell.append(parts[a][min(i, len(parts[a]) - 1)])
        swaths = [s for _, s in sorted(zip(cell, swaths), key=lambda x: x[0])]
        ranks = sorted(cell)
    else:
        ranks = [0] * len(swaths)
    turn = order(swaths, config.route, angle, vehicle.radius, config.params)
    if config.decomposition == "boustrophedon_cells":
        turn = [(k, i % 2 == 0) for c in sorted(set(ranks)) for i, (k, _) in enumerate([t for t in turn if ranks[t[0]] == c])]
    work = sum(math.dist(*s) for s in swaths)
    transfers, ok, unchecked = 0.0, True, []
    segments = [Segment("WORK", np.array(_driven(swaths[turn[0][0]], turn[0][1])))]
    crossings = sum(_crossed(*swaths[k], rows) for k, _ in turn)
    for (a, fa), (b, fb) in zip(turn, turn[1:]):
        start, goal = _pose(swaths[a], fa, True), _pose(swaths[b], fb, False)
        if config.path == "dubins_transit":
            if (chosen := kin.shortest(start, goal, vehicle.radius)) is None:
                raise ValueError("no path reaches the next swath")
            points = kin.sample(start, chosen, vehicle.radius, step)
            unchecked.append(points)
        else:
            words = kin.reeds_shepp(start, goal, vehicle.radius)
            chosen = next((w for w in words if _inside(rings, kin.sample(start, w, vehicle.radius, step), vehicle.body / 2)), None)
            if chosen is None:
                ok = False
                chosen = min(words, key=lambda w: (w.cost(vehicle.radius, multiplier, penalty), w.name))
            points = kin.sample(start, chosen, vehicle.radius, step)
        transfers += chosen.length * vehicle.radius
        crossings += _crossed(start[:2], goal[:2], rows)
        reverse = any(v < -1e-12 for _, v in chosen.steps)
        curvature = 1 / vehicle.radius if any(k != "S" and abs(v) > 1e-12 for k, v in chosen.steps) else 0.0
        segments += [Segment("TURN", points, curvature, reverse), Segment("WORK", np.array(_driven(swaths[b], fb)))]
    if unchecked:  # one word each, so their points are looked at together
        ok = _inside(rings, np.concatenate(unchecked), vehicle.body / 2)
    return {
        "status": "ok" if ok else "constraint_violation", "failure_reason": None if ok else "validator_rejected:outside_area",
        "path_length": work + transfers, "headland_turns": float(len(turn) - 1), "row_crossings": crossings, "n_swaths": len(swaths), "work_m": work, "transfer_m": transfers, "segments": segments,
    }


def _crossed(a, b, rows: Rows | None) -> float:
    if rows is None:
        return 0.0
    return abs(-math.sin(rows.direction) * (b[0] - a[0]) + math.cos(rows.direction) * (b[1] - a[1])) / rows.spacing


@lru_cache(64)
def _rings(wkt: str) -> tuple:
    return tuple(geo.parse_polygon(wkt))


_RUN = "instance_id string, config_id string, runstatus string, failure_reason string, path_length double, headland_turns double, row_crossings double, n_swaths long, work_m double, transfer_m double, planning_s double"


def run_matrix(instances: DataFrame, configs: list[Config], vehicles: list[Vehicle], done: DataFrame | None = None) -> DataFrame:
    """A row for each of ``instances(instance_id, wkt, vehicle_index, row_direction, row_spacing)`` and configuration,
    but for those in ``done(instance_id, config_id)``. Failures are rows: a configuration that doesn't fit is not
    applicable, any other exception is a crash with its reason. Instances that differ in their id alone share a plan, whose
    seconds stand in each one's row."""
    names = instances.sparkSession.createDataFrame([(k, c.config_id) for k, c in enumerate(configs)], "place int, config_id string")
    grid = instances.crossJoin(F.broadcast(names))  # a list of settings
    if done is not None:
        grid = grid.join(done.select("instance_id", "config_id"), ["instance_id", "config_id"], "left_anti")

    def run(batches):
        before, told = None, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rows = None if r.row_spacing is None or math.isnan(r.row_spacing) else Rows(r.row_direction, r.row_spacing)
                names = {"instance_id": r.instance_id, "config_id": r.config_id}
                if (now := (r.wkt, r.vehicle_index, r.place, rows)) == before:
                    out.append(told | names)
                    continue
                began, before = time.perf_counter(), now
                row = {"runstatus": "crash", "failure_reason": None}
                try:
                    found = plan(list(_rings(r.wkt)), vehicles[r.vehicle_index], configs[r.place], rows)
                    row["runstatus"] = "ok" if found["status"] == "ok" else "not_applicable" if configs[r.place].headland == "no_headland" else "outside_area"
                    row["failure_reason"] = found["failure_reason"]
                    row |= {k: found[k] for k in ("n_swaths", "work_m", "transfer_m")}
                    if found["status"] == "ok":
                        row |= {k: found[k] for k in ("path_length", "headland_turns", "row_crossings")}
                except Inapplicable as e:
                    row |= {"runstatus": "not_applicable", "failure_reason": str(e)}
                except Exception as e:  # noqa: BLE001  failures are rows
                    row["failure_reason"] = f"{type(e).__name__}: {e}"
                told = row | {"planning_s": time.perf_counter() - began}
                out.append(told | names)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _RUN.split(", ")])
            yield frame.astype({"n_swaths": "Int64"})

    work = ["wkt", "vehicle_index", "row_direction", "row_spacing", "place"]
    dealt = grid.repartition(4 * instances.sparkSession.sparkContext.defaultParallelism, *work).sortWithinPartitions(*work)
    return dealt.mapInPandas(run, _RUN)


def reference_length(area, parts, diameter, width: float, radius: float):
    """A bound known before any run, in numbers or columns: twice the work of a full cover, and a transfer between each
    pair of parts along the field's diameter and half a turn."""
    return 2 * area / width + parts * parts * (diameter + math.pi * radius)


def rectangles(part: DataFrame) -> DataFrame:
    """A rectangle for each part: a tenth of its price by its size and 30."""
    w, h = F.col("p_retailprice") / 10.0, F.col("p_size") + 30.0
    return part.select(F.col("p_partkey").cast("long").alias("field_id"), F.format_string("POLYGON ((0 0, %s 0, %s %s, 0 %s, 0 0))", w, w, h, h).alias("wkt"))


def features(fields: DataFrame) -> DataFrame:
    """Shape features of ``fields(field_id, wkt)``; a hole counts as an obstacle."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, wkt in zip(pdf["field_id"], pdf["wkt"]):
                rings = geo.parse_polygon(wkt)
                area = abs(geo.signed_area(rings[0])) - sum(abs(geo.signed_area(h)) for h in rings[1:])
                long, wide, _ = geo.smallest_rectangle(rings[0])
                full = abs(geo.signed_area(geo.hull(rings[0])))
                round_area = sum(geo.perimeter(r) for r in rings) / math.sqrt(area)
                out.append((i, area, round(round_area, 9), round(1 - area / full, 9) + 0.0, round(long / wide, 9) if wide else 1.0, geo.reflex_corners(rings[0], rings[1:])))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return fields.mapInPandas(run, FEATURES)


#: The features of an instance, in this order.
INSTANCE_FEATURES = (
    "area_m2", "perimeter_area_ratio", "convexity_deficiency", "elongation", "reflex_vertex_count", "obstacle_count", "obstacle_area_ratio", "row_angle_vs_principal",
    "crossing_density", "spacing_to_width_ratio", "turning_ratio", "swath_count_at_minwidth",
)


def narrow_swaths(exterior: geo.Ring, width: float) -> int:
    """How many swaths cover a polygon along the side across which it is narrowest; at least one."""
    u = geo.canonical(geo.min_width_angle(exterior))
    return max(1, math.ceil(float(np.ptp(exterior @ np.array([-u[1], u[0]]))) / width))


def _shape(rings: list[geo.Ring]) -> dict[str, float]:
    """What features and references share of a field with holes that don't meet each other or its side."""
    holes = sum(abs(geo.signed_area(h)) for h in rings[1:])
    full = geo.hull(rings[0])
    return {"field": abs(geo.signed_area(rings[0])), "holes": holes, "area": abs(geo.signed_area(rings[0])) - holes, "hull": abs(geo.signed_area(full)), "diameter": float(max(np.hypot(*(full - p).T).max() for p in full))}


@dataclass(frozen=True)
class _Fixed:
    """What the features take from a field and a width alone."""

    shape: dict[str, float]
    sides: tuple[float, float]
    around: float
    corners: float
    holes: float
    angle: float
    swaths: float


def _fixed(rings: list[geo.Ring], width: float) -> _Fixed:
    long, wide, _ = geo.smallest_rectangle(rings[0])
    around, corners = sum(map(geo.perimeter, rings)), float(geo.reflex_corners(rings[0], rings[1:]))
    return _Fixed(_shape(rings), (long, wide), around, corners, float(len(rings) - 1), geo.principal_angle(rings[0]), float(narrow_swaths(rings[0], width)))


def feature_values(rings: list[geo.Ring], direction: float | None, spacing: float | None, width: float, radius: float) -> dict[str, float | None]:
    """The twelve features of one field with holes as obstacles; those of rows are None where there are none."""
    return _feature_values(_fixed(rings, width), direction, spacing, width, radius)


def _feature_values(field: _Fixed, direction: float | None, spacing: float | None, width: float, radius: float) -> dict[str, float | None]:
    shape, (long, wide) = field.shape, field.sides
    angle = density = ratio = None
    if spacing is not None and not math.isnan(spacing):
        off = abs(direction - field.angle) % math.pi
        angle, density, ratio = min(off, math.pi - off), math.sqrt(shape["area"]) / spacing, spacing / width
    return dict(zip(INSTANCE_FEATURES, (
        shape["area"], field.around / math.sqrt(shape["area"]), 1 - shape["area"] / shape["hull"], long / wide if wide > 1e-12 else 1.0,
        field.corners, field.holes, shape["holes"] / shape["field"], angle, density, ratio, radius / width, field.swaths,
    )))


def _instance_features(batches):
    of = lru_cache(1 << 13)(lambda wkt, width: _fixed(_rings(wkt), width))
    for pdf in batches:
        out = [(r.instance_id, *_feature_values(of(r.wkt, r.width), r.row_direction, r.row_spacing, r.width, r.radius).values()) for r in pdf.itertuples(index=False)]
        yield pd.DataFrame(out, columns=["instance_id", *INSTANCE_FEATURES]).astype({c: float for c in INSTANCE_FEATURES})


def instance_features(instances: DataFrame) -> DataFrame:
    """The twelve features of ``instances(instance_id, wkt, row_direction, row_spacing, width, radius)``; the holes of a field
    are its obstacles. The three features of rows are null where there are none. What a shape and a width fix is computed once
    for the instances that a task meets, as long as it remembers them."""
    columns = ("wkt", "row_direction", "row_spacing", "width", "radius")
    return instances.select("instance_id", *columns).mapInPandas(_instance_features, "instance_id string, " + ", ".join(f"{c} double" for c in INSTANCE_FEATURES))


def analytic_references(instances: DataFrame) -> DataFrame:
    """Bounds of the three objectives known before any run, for ``instances`` as :func:`instance_features` takes them.

    The path's bound is :func:`reference_length` of the free area and the number of narrow swaths; that number bounds the
    turns; crossings are bounded by the path over the spacing, or by 1 where there are no rows. ``basis`` tells which.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rings = _rings(r.wkt)
                shape, n = _shape(rings), narrow_swaths(rings[0], r.width)
                path = reference_length(shape["area"], n, shape["diameter"], r.width, max(r.radius, 0.0))
                rows = r.row_spacing is not None and not math.isnan(r.row_spacing)
                out.append((r.instance_id, path, float(max(n, 1)), path / r.row_spacing if rows else 1.0, "path/spacing" if rows else "no rows"))
            yield pd.DataFrame(out, columns=["instance_id", "ref_path_length", "ref_headland_turns", "ref_row_crossings", "basis"])

    columns = ("wkt", "row_spacing", "width", "radius")
    return instances.select("instance_id", *columns).mapInPandas(run, "instance_id string, ref_path_length double, ref_headland_turns double, ref_row_crossings double, basis string")


def rectangle_plan(part: DataFrame, width: float = 5.0, headland: float = 8.0, radius: float = 2.0) -> DataFrame:
    """The plan of axis-parallel rectangles in closed form: strips along the longer side of what the headland leaves,
    half turns of pi * R + d - 2 R between full strips; rectangles that the headland takes up have none."""
    w, h = F.col("p_retailprice") / 10.0 - 2 * headland, F.col("p_size") + 30.0 - 2 * headland
    rows = part.select(F.col("p_partkey").cast("long").alias("field_id"), w.alias("w"), h.alias("h")).where("w > 0 AND h > 0")
    n = F.greatest(F.lit(1), F.ceil(F.least("w", "h") / width)).cast("long")
    rows = rows.select("field_id", n.alias("n_swaths"), F.greatest("w", "h").alias("long"))
    turns = F.when(F.col("n_swaths") < 2, F.lit(0.0)).otherwise((F.col("n_swaths") - 2) * (math.pi * radius + width - 2 * radius))
    return rows.select("field_id", "n_swaths", F.round("long", 6).alias("swath_length"), F.round(F.col("n_swaths") * F.col("long"), 6).alias("work_m"), (F.col("n_swaths") - 1).alias("n_turns"), F.round(turns, 6).alias("full_turns_m"))


