import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import geometry as geo
from furrow.functions import kinematics as kin
from furrow.functions import scalars
from furrow.operators import recommender, routing
from furrow.plans import coverage, evolution

FIELD = geo.ring([(0, 0), (100, 0), (100, 50), (0, 50)])


# fixed values: radii, distances apart and lengths of half turns
@pytest.mark.parametrize("radius, shift, length", [(2, 5, 7.283185307179587), (3, 8, 11.42477796076938), (1.5, 4, 5.712388980384690), (3, 6, 9.42477796076938), (1, 0, 7.330382858376184), (1, 1, 6.032529644843455), (1, 2, math.pi)])
def test_half_turns(spark, radius, shift, length):
    assert kin.dubins((0, 0, 0), (0, shift, math.pi), radius)[0].length * radius == pytest.approx(length, abs=1e-9)
    column = scalars.dubins_length(F.lit(0.0), F.lit(float(shift)), F.lit(0.0), F.lit(math.pi), F.lit(float(radius)))
    assert spark.range(1).select(column).first()[0] == pytest.approx(length, abs=1e-9)


def test_words_close():
    r = np.random.default_rng(3)
    seen = set()
    for _ in range(300):
        a, b = (tuple(r.uniform(-50, 50, 2)) + (float(r.uniform(-4, 4)),) for _ in range(2))
        radius = float(r.uniform(0.5, 20))
        forward, both = kin.dubins(a, b, radius), kin.reeds_shepp(a, b, radius)
        assert both[0].length <= forward[0].length + 1e-9
        seen |= {w.name for w in forward}
        for w in (forward[0], both[0]):
            assert np.hypot(*(kin.sample(a, w, radius, 0.5)[-1] - b[:2])) < 1e-6
    assert {"L+S+L+", "R+S+R+", "L+S+R+", "R+S+L+"} <= seen
    assert kin.reeds_shepp((0, 0, 0), (-3, 0, 0), 1)[0].length == pytest.approx(3)
    with pytest.raises(ValueError):
        kin.dubins((0, 0, 0), (1, 1, 1), 0)


def test_features():
    square, notch = geo.ring([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), geo.ring([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)])
    hole = geo.ring([(1, 1), (2, 1), (2, 2), (1, 2)])
    assert geo.reflex_corners(square) == 0 and geo.reflex_corners(notch) == 1 and geo.reflex_corners(square, [hole]) == 4
    assert abs(geo.signed_area(notch)) == 12 and geo.is_simple(notch) and not geo.is_simple(geo.ring([(0, 0), (2, 2), (2, 0), (0, 2)]))
    r = np.random.default_rng(0)
    for _ in range(20):
        t = r.uniform(0, 7)
        m = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        moved = notch @ m + r.uniform(-99, 99, 2)
        assert abs(geo.signed_area(moved)) == pytest.approx(12, rel=1e-9) and geo.reflex_corners(moved) == 1
        assert geo.smallest_rectangle(moved)[:2] == pytest.approx(geo.smallest_rectangle(notch)[:2], rel=1e-9)


def test_text_and_hash():
    text = "POLYGON ((0 0, 10 0, 10 5, 0 5, 0 0), (1 1, 2 1, 2 2, 1 1))"
    rings = geo.parse_polygon(text)
    again = geo.parse_polygon(geo.format_polygon(rings))
    assert geo.geometry_hash(rings, "EPSG:1") == geo.geometry_hash(again, "EPSG:1") != geo.geometry_hash(again, "EPSG:2")
    turned = [np.roll(rings[0], 2, 0)[::-1], rings[1]]
    assert geo.geometry_hash(turned, "EPSG:1") == geo.geometry_hash(rings, "EPSG:1")
    with pytest.raises(ValueError):
        geo.parse_polygon("LINESTRING (0 0, 1 1)")


def test_utm():
    east, north, code = geo.utm(9.0, 48.0)
    assert code == 32632 and east == pytest.approx(500000, abs=1e-6) and north == pytest.approx(5316300.2244, abs=0.01)
    assert geo.utm(9.0, -48.0)[2] == 32732


def test_swaths():
    assert len(geo.swaths([FIELD], 0.0, 10, 0)) == 5
    strips = geo.swaths([FIELD], 0.0, 12, 0)
    assert len(strips) == 5 and strips[-1][0][1] == pytest.approx(44)  # the last one is moved inside
    inner = geo.swaths([FIELD], 0.0, 10, 8)
    assert len(inner) == 4 and inner[0][0] == pytest.approx((8, 13)) and inner[0][1] == pytest.approx((92, 13))
    assert geo.swaths([FIELD], 0.0, 10, 26) == []
    hole = geo.ring([(40, 20), (60, 20), (60, 30), (40, 30)])
    assert len(geo.swaths([FIELD, hole], 0.0, 10, 0)) == 6


def test_plan_of_a_rectangle():
    v = coverage.Vehicle(5.0, 2.0, 2.0)
    p = coverage.plan([FIELD], v, coverage.standard_configs()[0], coverage.Rows(0.0, 0.75))
    strips = math.ceil(34 / 5)
    assert p["status"] == "ok" and p["n_swaths"] == strips and p["work_m"] == pytest.approx(strips * 84) and p["headland_turns"] == strips - 1
    full = math.pi * 2 + 5 - 4
    assert p["transfer_m"] == pytest.approx((strips - 2) * full + kin.dubins((0, 0, 0), (0, 34 - 5 * (strips - 1), math.pi), 2)[0].length * 2, rel=1e-6)
    with pytest.raises(coverage.Inapplicable):
        coverage.plan([geo.ring([(0, 0), (30, 0), (30, 12), (0, 12)])], v, coverage.standard_configs()[0])
    with pytest.raises(coverage.Inapplicable):
        coverage.plan([FIELD], v, coverage.standard_configs()[12])
    for config in coverage.standard_configs()[:11]:
        assert coverage.plan([FIELD], v, config, coverage.Rows(0.3, 0.75))["n_swaths"] > 0


def test_run_matrix(spark):
    wkt = ["POLYGON ((0 0, 100 0, 100 50, 0 50, 0 0))", "POLYGON ((0 0, 30 0, 30 12, 0 12, 0 0))", "nonsense"]
    rows = spark.createDataFrame([(f"f{k}", w, 0, 0.3, 0.75) for k, w in enumerate(wkt)], "instance_id string, wkt string, vehicle_index int, row_direction double, row_spacing double")
    configs = coverage.standard_configs()[:2]
    got = coverage.run_matrix(rows, configs, [coverage.Vehicle(5.0, 2.0, 2.0)])
    kept = got.collect()
    assert sorted((r.instance_id, r.runstatus) for r in kept) == [("f0", "ok")] * 2 + [("f1", "not_applicable")] * 2 + [("f2", "crash")] * 2
    done = spark.createDataFrame([("f0", configs[0].config_id)], "instance_id string, config_id string")
    assert coverage.run_matrix(rows, configs, [coverage.Vehicle(5.0, 2.0, 2.0)], done).count() == 5


def test_tours(spark):
    nodes = spark.createDataFrame([(1, "A", 0.0, 0.0), (1, "B", 1.0, 0.0), (1, "C", 3.0, 0.0)], "problem_id int, node_id string, x double, y double")
    t = routing.nearest_neighbour_tours(nodes).orderBy("seq").collect()
    assert [r.node_id for r in t] == ["A", "B", "C"] and sum(r.leg for r in t) == 6
    with pytest.raises(Exception, match="repeated"):
        routing.nearest_neighbour_tours(nodes.union(nodes)).collect()


def test_exact_capacity():
    x = y = np.zeros(4)
    assert len(routing.savings_free_routes(list("dabc"), x, y, [0, 0.1, 0.2, 0.3], 0.6)) == 2  # 0.1 + 0.2 + 0.3 is above 0.6 exactly
    assert len(routing.savings_free_routes(list("dabc"), x, y, [0, 1e308, 5e-324, 0], 1e308)) == 2
    with pytest.raises(routing.ConstructionError):
        routing.savings_free_routes(list("da"), x, y, [0, 2], 1)


def test_construct():
    got = routing.construct((), lambda s: len(s) == 3, lambda s: [k for k in (2, 1, 0) if k not in s], lambda s, a: (*s, a), lambda s, a: 0.0)
    assert got == (2, 1, 0)
    with pytest.raises(routing.ConstructionError):
        routing.construct((), lambda s: False, lambda s: [1], lambda s, a: s, lambda s, a: math.nan)


def test_tsplib_distances(spark):
    row = spark.createDataFrame([(1.0, 1.5)], "x double, y double")
    d = row.select(scalars.nearest_integer(F.lit(2.5)).alias("a"), scalars.tsplib_distance(F.col("x"), F.col("y"), "CEIL_2D").alias("b")).first()
    assert (d.a, d.b) == (3, 2)


def test_trees():
    r = np.random.default_rng(0)
    x = r.uniform(size=(200, 3))
    y = np.stack([x[:, 0] > 0.5, x[:, 1]], 1).astype(float)
    p = recommender.fit_predict(x, y, x, trees=20)
    assert np.abs(p - y).mean() < 0.05 and (p >= 0).all()
    assert (recommender.fit_predict(x[:1], y[:1], x, trees=2) == np.maximum(0, y[0])).all()


def test_forest_tries_all_features_and_keeps_two_rows_a_leaf():
    r = np.random.default_rng(3)
    x, y = r.uniform(size=(90, 5)), r.uniform(size=(90, 22))
    forest = recommender.grow(x, y, r, 7)
    at = np.repeat(np.arange(7), 90)
    rows = np.tile(np.arange(90), 7)
    while (inner := forest.feature[at] >= 0).any():
        goes = x[rows, np.maximum(forest.feature[at], 0)] <= forest.cut[at]
        at = np.where(inner, np.where(goes, forest.left[at], forest.right[at]), at)
    leaves, n = np.unique(at, return_counts=True)
    assert n.min() >= 2 and n.sum() == 630
    for leaf in leaves:
        assert forest.value[leaf] == pytest.approx(y[rows[at == leaf]].mean(0))
    # one telling feature of nine: the first cuts use it, as every feature is tried
    wide = r.uniform(size=(200, 9))
    root = recommender.grow(wide, (wide[:, 4:5] > 0.5).astype(float), r, 100)
    assert (root.feature[:100] == 4).mean() > 0.9


def test_recommender_learns_from_applicable_rows(spark):
    rows = [("c", f"i{k}", k % 2, k % 3 != 0, 1.0, 5.0 if k % 3 else 900.0) for k in range(24)]
    d = spark.createDataFrame(rows, "config_id string, instance_id string, fold long, applicable boolean, x double, e1 double")
    got = recommender.cross_predict(d, ["x"], ["e1"], trees=4).collect()
    assert len(got) == 24 and all(g.e1 == pytest.approx(5.0) for g in got)


def test_sandbox_and_evolution():
    for bad in ("import os\n", "def f(p):\n    return p.__class__\n", "def f(p):\n    return open('x')\n", "def f(:\n"):
        with pytest.raises((evolution.Refused, NameError)):
            evolution.gates(evolution.compile_heuristic(bad), [{}])
    pool = {"a": np.array([5.0, 5.0, 5.0])}
    run = lambda: evolution.evolve(pool, lambda f, i: pool[i] - f({}), lambda r, k: f"def f(p):\n    return {[0.0, 0.5, 9.0][k]}\n", 3, np.array([10.0] * 3), [{}])
    records, log = run()
    assert [r["kept"] for r in records] == [False, True, False] and log == run()[1]
    assert records[1]["score"] == pytest.approx(5.5**3 - 125) and records[2]["reason"].startswith("an offset")


def test_equal_instances_count_once_each():
    """One instance that stands for three gives the ledger of three equal ones."""
    propose = lambda r, k: f"def f(p):\n    return {[0.1, 0.3, 0.7][k]}\n"
    start = {"a": np.array([5.0, 5.0, 5.0]), "b": np.array([4.0, 6.0, 5.0])}
    of = lambda names: {k: start[k[0]] for k in names}
    log = lambda names, **more: evolution.evolve(of(names), lambda f, i: start[i[0]] - f({}), propose, 3, np.array([10.0] * 3), [{}], **more)[1]
    assert log(["a", "b"], counts={"a": 3, "b": 1}) == log(["a", "a2", "a3", "b"]) != log(["a", "b"])


def test_spans_stop_at_the_first_line_that_meets_the_field(monkeypatch):
    ring, calls = geo.ring([(0, 0), (90, 0), (90, 45), (45, 45), (45, 90), (0, 90)]), []
    for name in ("eroded_intervals", "_eroded"):
        if hasattr(geo, name):
            monkeypatch.setattr(geo, name, lambda *a, f=getattr(geo, name): calls.append(1) or f(*a))
    assert geo.eroded_span([ring], (1.0, 0.0), 8.0) == pytest.approx((8.0, 82.0)) and 0 < len(calls) < 150


def plain_routes(ids, x, y, need, capacity, depot):
    """Routes by looking at every customer at every step."""
    left, out = sorted((k for k in range(len(ids)) if k != depot), key=lambda k: ids[k]), []
    while left:
        at, room, route = depot, capacity, []
        while fits := [k for k in left if need[k] <= room]:
            at, route = min(fits, key=lambda k: math.hypot(x[k] - x[at], y[k] - y[at])), route  # noqa: B023
            room -= need[at]
            route.append(at)
            left.remove(at)
        out.append(route)
    return out


@pytest.mark.parametrize("spread", [0, 4, 1000])
def test_routes_are_those_of_a_plain_search(spread):
    r = np.random.default_rng(spread)
    for n in (1, 2, 9, 60, 200):
        x, y = (r.integers(0, spread + 1, n).astype(float) for _ in "xy")
        ids, need, depot = [f"n{k:04d}" for k in r.permutation(n)], r.integers(0, 8, n).tolist(), int(r.integers(0, n))
        assert routing.savings_free_routes(ids, x, y, need, 20.0, depot) == plain_routes(ids, x, y, need, 20, depot)


def test_steps_of_a_route_do_not_look_at_all_customers(monkeypatch):
    n, calls, hypot = 4000, [0], math.hypot

    def counted(*a):
        calls[0] += 1
        return hypot(*a)

    monkeypatch.setattr(routing.math, "hypot", counted)
    r = np.random.default_rng(1)
    routes = routing.savings_free_routes([f"n{k:04d}" for k in range(n)], r.uniform(0, 100, n), r.uniform(0, 100, n), np.arange(n) % 7 + 1.0, 20.0)
    assert sum(map(len, routes)) == n - 1 and calls[0] < 200 * n


def test_equal_instances_share_a_plan(spark):
    """Equal fields under other ids have equal rows, down to the seconds of the one plan; others have their own."""
    box = "POLYGON ((0 0, {0} 0, {0} 50, 0 50, 0 0))"
    rows = [(f"i{k}", box.format([90, 80][k % 2]), 0, 0.3, [0.75, None][k // 2 % 2]) for k in range(12)]
    d = spark.createDataFrame(rows, "instance_id string, wkt string, vehicle_index int, row_direction double, row_spacing double")
    vehicle, configs = coverage.Vehicle(5.0, 2.0, 2.0), [c for c in coverage.standard_configs() if c.path == "dubins_transit"][:3]
    found = coverage.run_matrix(d, configs, [vehicle]).collect()
    assert len({(r.instance_id, r.config_id) for r in found}) == 36 and {r.runstatus for r in found} == {"ok"}
    seconds, length = {}, {}
    for r in found:
        k = int(r.instance_id[1:])
        seconds.setdefault((k % 4, r.config_id), set()).add(r.planning_s)
        length.setdefault((k % 2, r.config_id), set()).add(r.path_length)
    assert len(seconds) == 12 and all(len(v) == 1 for v in seconds.values()) and all(len(v) == 1 for v in length.values())


def test_equal_rows_weigh_as_many():
    """Rows of a weight predict as their copies do, in any order; leaves count copies."""
    r = np.random.default_rng(6)
    x, y, asked = r.uniform(size=(40, 5)), r.uniform(size=(40, 3)), r.uniform(size=(30, 5))
    x[:, 2], weight = 1.0, r.integers(1, 5, 40)
    copies = r.permutation(np.repeat(np.arange(40), weight))
    want = recommender.fit_predict(x[copies], y[copies], asked, trees=30)
    assert recommender.fit_predict(x, y, asked, trees=30, weight=weight) == pytest.approx(want, abs=1e-12)
    single = recommender.grow(x, y, np.random.default_rng(0), 3, weight=np.full(40, 2))
    assert (single.feature != 2).all() and (single.feature < 0).sum() == 120 and recommender.grow(x, y, np.random.default_rng(0), 3).feature.size < single.feature.size


def plain_tree(x, y, cuts, leaf=2):
    """The leaves' rows of a tree grown node by node with the given cuts of each node, breadth first."""
    level, leaves = [np.arange(len(x))], []
    while level:
        chance, after = cuts(len(level)), []
        for k, rows in enumerate(level):
            best, found = -1.0, None
            for f in range(x.shape[1]):
                v = x[rows, f]
                beyond = v > v.min() + (v.max() - v.min()) * chance[f, k]
                if min(beyond.sum(), (~beyond).sum()) < leaf or (y[rows] == y[rows[0]]).all():
                    continue
                d = y[rows] - y.mean(0)
                gain = sum((d[m].sum(0) ** 2).sum() / m.sum() for m in (beyond, ~beyond))
                if gain > best * (1 + 1e-12):
                    best, found = gain, beyond
            if found is None:
                leaves.append(rows)
            else:
                after += [rows[~found], rows[found]]
        level = after
    return leaves


def test_trees_are_those_grown_node_by_node():
    for seed, n in ((1, 30), (2, 700)):
        r = np.random.default_rng(seed)
        x, y = r.uniform(size=(n, 4)).round(2), r.uniform(size=(n, 2))
        draws = np.random.default_rng(seed)
        forest = recommender.grow(x, y, np.random.default_rng(seed), 1)
        for rows in plain_tree(x, y, lambda nodes: draws.random((4, nodes))):  # noqa: B023
            assert forest.predict(x[rows]) == pytest.approx(np.tile(y[rows].mean(0), (len(rows), 1)), abs=1e-9)


def test_models_get_equal_rows_once(spark):
    rows = [("c", f"i{k}", k % 3, True, float(k // 3 % 4), float(k // 3 % 4)) for k in range(48)]
    d = spark.createDataFrame(rows, "config_id string, instance_id string, fold long, applicable boolean, x double, e1 double")
    got = recommender.cross_predict(d, ["x"], ["e1"], trees=6)
    assert sorted(r.instance_id for r in got.collect()) == sorted(r[1] for r in rows)
    x, y, fold = (np.array([r[k] for r in rows]) for k in (4, 5, 2))
    for r in got.collect():
        want = recommender.fit_predict(x[fold != r.fold, None], y[fold != r.fold, None], np.array([[x[int(r.instance_id[1:])]]]), 6)
        assert r.e1 == pytest.approx(want[0, 0], abs=1e-12)


def test_rows_of_equal_features_are_learnt_from_together(monkeypatch):
    """Trees get a row for each distinct row of features, whose outputs differ, and predict as from all rows."""
    sizes, grow = [], recommender.grow
    monkeypatch.setattr(recommender, "grow", lambda x, *more: sizes.append(len(x)) or grow(x, *more))
    r = np.random.default_rng(8)
    x, y = np.repeat(np.array([[0.0, 1.0], [0.0, 2.0], [3.0, 1.0]]), 20, axis=0), r.uniform(size=(60, 4))
    p = recommender.fit_predict(x, y, x, trees=5)
    assert set(sizes) == {3} and p == pytest.approx(np.repeat(y.reshape(3, 20, 4).mean(1), 20, axis=0), abs=1e-12)
    turn = r.permutation(60)
    assert (recommender.fit_predict(x[turn], y[turn], x, trees=5) == p).all()


def test_a_model_predicts_distinct_rows_once(spark):
    """A fold's rows of equal features get one prediction, made from the other folds' mean outputs; unfit rows get it, too."""
    rows = [("cd"[k % 2], f"i{k}", k % 3, k % 7 != 0, -0.0 if k % 4 < 2 else 0.0, float(k // 4 % 3) if k % 5 else None, float(k) if k % 11 else None) for k in range(240)]
    d = spark.createDataFrame(rows, "config_id string, instance_id string, fold long, applicable boolean, x double, z double, e1 double")
    got = {r.instance_id: r for r in recommender.cross_predict(d, ["x", "z"], ["e1"], trees=4).collect()}
    assert len(got) == 240
    for c, i, fold, _, _, z, _ in rows:
        same = [r[6] for r in rows if r[0] == c and r[2] != fold and r[3] and r[6] is not None and (r[5] or 0.0) == (z or 0.0)]
        assert (got[i].config_id, got[i].fold) == (c, fold) and got[i].e1 == pytest.approx(np.mean(same), abs=1e-9)


def test_models_have_partitions_of_their_own(spark):
    for n in (1, 7, 70):
        at = spark.createDataFrame([(k,) for k in recommender._places(spark, n)], "place int").repartition(n, "place")
        assert at.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() == [1] * n
