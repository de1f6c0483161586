import math

import numpy as np
import pytest

from furrow.functions import geometry as geo
from furrow.plans import coverage, validate

FIELD = geo.ring([(0, 0), (100, 0), (100, 50), (0, 50)])


def strips(width):
    return [geo.strip(np.array(s), width)[0] for s in geo.swaths([FIELD], 0.0, width, 0)]


def test_strip_areas():
    a = geo.overlay_areas(strips(10), [[FIELD]])
    assert a["inside"] == pytest.approx(5000) and a["sum"] == pytest.approx(5000) and a["outside"] == pytest.approx(0, abs=1e-9)
    b = geo.overlay_areas(strips(12), [[FIELD]])
    assert b["inside"] == pytest.approx(5000) and b["sum"] - b["inside"] == pytest.approx(1000)


def test_overlays():
    square, hole = geo.ring([(0, 0), (4, 0), (4, 4), (0, 4)]), geo.ring([(1, 1), (2, 1), (2, 2), (1, 2)])
    diamond = geo.ring([(4, 2), (6, 4), (4, 6), (2, 4)])
    got = geo.overlay_areas([[diamond]], [[square, hole]])
    assert got["clip"] == pytest.approx(15) and got["inside"] == pytest.approx(2) and got["outside"] == pytest.approx(6)
    disc = geo.strip(np.array([(0, 0), (1, 0)]), 2.0, round_ends=True)[1]
    assert geo.overlay_areas([disc])["inside"] == pytest.approx(0.5 * 64 * math.sin(2 * math.pi / 64))
    r = np.random.default_rng(0)
    for _ in range(5):
        shapes = [[geo.hull(r.uniform(0, 10, (6, 2)))] for _ in range(4)]
        points = r.uniform(0, 10, (40_000, 2))
        inside = np.any([geo.contains(s[0], points) for s in shapes], axis=0).mean() * 100
        assert geo.overlay_areas(shapes)["inside"] == pytest.approx(inside, abs=1.0)


def path():
    v = coverage.Vehicle(5.0, 2.0, 2.0)
    return v, coverage.plan([FIELD], v, coverage.standard_configs()[0])["segments"]


def test_valid_path():
    v, segments = path()
    r = validate.validate(validate.Problem(FIELD, rows=coverage.Rows(0.0, 0.75)), v, segments, headland=8.0)
    m = r.metrics
    assert r.status == "ok" and len(m) == 19 and set(m) <= {x[0] for x in validate.METRICS}
    assert m["headland_turn_count"] == m["swath_count"] - 1 == 6
    assert m["coverage_ratio_field"] == pytest.approx(84 * 34 / 5000) and m["coverage_ratio_main"] == pytest.approx(1, abs=2e-3)
    assert m["L_area"] * (1 - m["eta_L"]) == pytest.approx(m["coverage_ratio_field"] + m["overlap_ratio"], rel=1e-9)


def test_refusals():
    v, segments = path()
    problem = validate.Problem(FIELD)
    reason = lambda *a, **k: validate.validate(*a, **k).reason.split(":")[1]
    assert reason(problem, v, []) == "empty_path"
    assert reason(problem, v, segments[::2]) == "discontinuous_endpoints"
    assert reason(validate.Problem(FIELD, [geo.ring([(50, 10), (52, 10), (52, 15), (50, 15)])]), v, segments) == "collision"
    assert reason(problem, coverage.Vehicle(5.0, 2.0, 3.0), segments) == "curvature_limit"
    backward = [*segments[:-1], coverage.Segment("WORK", segments[-1].points, 0.0, True)]
    assert reason(problem, v, backward) == "reverse_without_gear"
    assert reason(validate.Problem(geo.ring([(0, 0), (94, 0), (94, 50), (0, 50)])), v, segments) == "outside_area"
    assert reason(validate.Problem(FIELD, forbidden=[geo.ring([(90, 20), (99, 20), (99, 30), (90, 30)])]), v, segments) == "forbidden_crossing"
    assert reason(problem, v, segments, threshold=0.9) == "coverage_threshold"


def test_names():
    assert len({m[0] for m in validate.METRICS}) == len({m[5] for m in validate.METRICS}) == 25 and validate.metric("runtime_s")[0] == "runtime_ms"
    assert geo.clearance(np.array([(0.0, 0.0), (5.0, 5.0)]), [geo.ring([(4, 4), (6, 4), (6, 6), (4, 6)])]) == pytest.approx([math.hypot(4, 4), 0])
    assert validate.zero_radius_length([((0, 0), (1, 0)), ((1, 1), (0, 1))]) == 3


def test_lengths_of_many_lines():
    r = np.random.default_rng(3)
    for k in range(40):
        rings = [geo.ring([(0, 0), (40, 0), (40, 40), (0, 40)]), geo.ring(r.uniform(10, 20, (4, 2)))] if k % 2 else [geo.ring(r.uniform(0, 40, (6, 2)))]
        u, offsets = geo.canonical(float(r.uniform(0, 3)) if k % 4 else 0.0), r.uniform(-40, 60, 50)
        one = [sum(b - a for a, b in geo.eroded_intervals(rings, o, u, k % 3)) for o in offsets]
        assert geo.eroded_lengths(rings, offsets, u, k % 3) == pytest.approx(one, abs=1e-8)


def test_sums_of_overlays_by_points():
    """Areas of overlapping triangles against a fine grid of points, and of nothing."""
    r = np.random.default_rng(5)
    polygons, clip = [[geo.ring(r.uniform(0, 10, (3, 2)))] for _ in range(5)], [[geo.ring([(2, 2), (9, 3), (4, 9)])], [geo.ring([(5, 1), (8, 1), (8, 6), (5, 6)])]]
    at = np.stack(np.meshgrid(np.arange(0.005, 10, 0.01), np.arange(0.005, 10, 0.01)), -1).reshape(-1, 2)
    each, over = [geo.contains(p[0], at) for p in polygons], geo.contains(clip[0][0], at) | geo.contains(clip[1][0], at)
    some = np.any(each, axis=0)
    want = {"inside": some & over, "outside": some & ~over, "clip": over, "sum": np.sum(each, axis=0) * over}
    got = geo.overlay_areas(polygons, clip)
    assert all(got[k] == pytest.approx(v.sum() * 1e-4, abs=0.05) for k, v in want.items())
    assert geo.overlay_areas([]) == dict.fromkeys(("inside", "outside", "clip", "sum"), 0.0)


def test_a_convex_field_holds_what_its_corners_say():
    square = geo.ring([(0, 0), (0, 10), (10, 10), (10, 0)])
    assert geo.within_convex(square, np.array([[0.0, 0.0], [10.0, 5.0], [3.0, 4.0]])) and not geo.within_convex(square, np.array([[3.0, 4.0], [10.1, 5.0]]))
    notched = geo.ring([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)])
    star = geo.ring([(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)])
    assert not geo.within_convex(notched, np.array([[1.0, 1.0]])) and not geo.within_convex(star, np.array([[0.0, 0.0]]))


def test_checks_do_not_go_line_by_line(monkeypatch):
    """A rectangle's plan and its check look at a few hundred lines, not at thousands."""
    calls = []
    for name in ("eroded_intervals", "_eroded"):
        if hasattr(geo, name):
            monkeypatch.setattr(geo, name, lambda *a, f=getattr(geo, name): calls.append(1) or f(*a))
    found = coverage.plan([FIELD], coverage.Vehicle(5.0, 2.0, 2.0), coverage.standard_configs()[0], coverage.Rows(0.3, 0.75))
    assert validate.validate(validate.Problem(FIELD), coverage.Vehicle(5.0, 2.0, 2.0), found["segments"], headland=8.0).status == "ok"
    assert 0 < len(calls) < 300


def test_slabs_thinner_than_numbers():
    """Sides that end one number apart leave slabs whose middle is at an end of theirs."""
    x = np.nextafter(5e5, math.inf)
    polygons = [[geo.ring([(5e5 - 1, 0), (5e5, 0), (x, 1), (5e5 - 1, 1)])], [geo.ring([(5e5, 0), (x, 0), (5e5 + 1, 2), (5e5, 2)])]]
    got = geo.overlay_areas(polygons, [[geo.ring([(5e5 - 2, -1), (5e5 + 2, -1), (5e5 + 2, 3), (5e5 - 2, 3)])]])
    assert got["inside"] == pytest.approx(2.0, abs=1e-6) and got["clip"] == pytest.approx(16.0) and got["outside"] == 0
