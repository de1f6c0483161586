"""Confirmatory records, designs, selections, logs and the evolution's gates on small hand-made cases."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from furrow.operators import confirm, pareto, recommender, regret, splits, stats
from furrow.plans import coverage, evolution, queries, studies
from furrow.sources import readers, runs

SIZES = "field_id string, instance_id string, vehicle_index long, effective_pool long, front_size long"


def design(spark, size=lambda o, s, v: o + 1, drop=0):
    rows = [("f:1", f"f:1:principal_axis:{0.1 * o:.1f}:{s}:vehicle:{v}", v, 3, size(o, s, v)) for o in range(5) for s in ("0.75", "1.5") for v in (0, 1)]
    return spark.createDataFrame(rows[drop:], SIZES)


def test_row_angle_effects(spark):
    got = confirm.row_angle_effects(design(spark)).first()
    assert (got.n_cells, got.n_front_instances, got.n_offset_bins, got.constant, got.rho) == (20, 20, 5, False, 1.0)
    flat = confirm.row_angle_effects(design(spark, lambda o, s, v: 2)).first()
    assert (flat.constant, flat.rho) == (True, 0.0)
    few = confirm.row_angle_effects(design(spark, lambda o, s, v: 1 if o < 2 else None)).first()
    assert (few.n_offset_bins, few.rho, few.constant) == (2, None, None)
    none = confirm.row_angle_effects(design(spark, lambda o, s, v: None)).first()
    assert (none.n_front_instances, none.n_offset_bins, none.rho) == (0, 0, None)


@pytest.mark.parametrize("change", ["missing", "other field", "other vehicle", "name"])
def test_broken_designs(spark, change):
    d = design(spark, drop=int(change == "missing"))
    if change == "other field":
        d = d.withColumn("field_id", F.lit("g"))
    elif change == "other vehicle":
        d = d.withColumn("vehicle_index", F.lit(7).cast("long"))
    elif change == "name":
        d = d.withColumn("instance_id", F.regexp_replace("instance_id", "principal_axis", "longest_edge"))
    with pytest.raises(Exception, match="design|name"):
        confirm.row_angle_effects(d).collect()


def test_normal_tail_of_a_record(spark):
    d = spark.createDataFrame([(float(k), 0.0) for k in (2, 3, 3, 5, 1)], "median_front_size double, median_zero_as_zero double")
    got = confirm.pareto_record(d).first()
    z = stats.wilcoxon_greater(d, "median_front_size", 1.0).first().z
    assert got.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-9) and got.bound == pytest.approx(min(1.0, 3 * got.p)) and got.n_zero_ok_fields == 0


def test_recommendation(spark):
    r = spark.createDataFrame(
        [("f", "i", c, 0, 0, s, x, a) for c, s, x, a in (("a", 0.1, 0.0, True), ("b", None, 2.0, True), ("c", 0.3, 0.2, False))],
        "field_id string, instance_id string, config_id string, vehicle_index long, preference long, score double, regret double, applicable boolean",
    )
    told = lambda *p: spark.createDataFrame([("i", c, 0, v) for c, v in p], "instance_id string, config_id string, preference long, predicted double")
    pick = lambda p: confirm.recommend(p, r).first()
    assert pick(told(("a", 0.5), ("b", 0.5), ("c", 0.0))).config_id == "a"  # ties by id; c isn't applicable
    worse = confirm.recommend(told(("a", 0.5), ("b", 0.1)), r)
    assert (worse.first().config_id, worse.first().infeasible) == ("b", True)
    record = confirm.recommender_record(worse, r).first()
    assert (record.recommender_loss, record.random_loss, record.mean_d, record.infeasible_rate, record.random_infeasible_rate) == (2.0, 1.0, 1.5, 1.0, 0.5)
    assert record.not_below_half_random and record.infeasible_above_random


def test_static_pools(spark):
    from tests.test_analysis import runs as matrix

    d = matrix(spark, [("i", "A", "ok", None, (10.0, 5.0, 2.0)), ("i", "B", "not_applicable", None, None)])
    settings = spark.createDataFrame([("A", v) for v in range(3)] + [("B", v) for v in range(3)], "config_id string, vehicle_index long")
    assert all(x.applicable for x in regret.regrets(d, settings).collect())  # whatever was observed
    with pytest.raises(Exception, match="not applicable"):
        regret.regrets(d, settings.where("config_id = 'B'")).collect()


def test_references(spark):
    one = [("i", 1.0, 2.0, 3.0), ("i", 1.0, 2.0, 3.0), ("j", None, None, None)]
    schema = "instance_id string, ref_path_length double, ref_headland_turns double, ref_row_crossings double"
    got = {r.instance_id: tuple(r)[1:] for r in pareto.references(spark.createDataFrame(one, schema), {"path_length": 7, "headland_turns": 8, "row_crossings": 9}).collect()}
    assert got == {"i": (1.0, 2.0, 3.0, "instance"), "j": (7.0, 8.0, 9.0, "global")}
    for bad in (one, [("i", 1.0, 2.0, 3.0), ("i", 1.5, 2.0, 3.0)]):
        with pytest.raises(Exception, match="no reference|several"):
            pareto.references(spark.createDataFrame(bad, schema)).collect()


def test_ecdf_keeps_ties_apart(spark):
    d = spark.createDataFrame([(2,), (1,), (2,), (None,)], "v long")
    assert sorted((r.value, r.share) for r in pareto.ecdf(d, "v").collect()) == [(1, pytest.approx(1 / 3)), (2, pytest.approx(2 / 3)), (2, 1.0)]


def test_selected_runs(spark, tmp_path):
    d = spark.createDataFrame([("f", 1), ("g", 2), ("g", 3)], "field_id string, x long")
    d.write.parquet(str(tmp_path / "runs"))
    assert sorted(r.x for r in runs.read_selected(spark, str(tmp_path / "runs"), ["g"], ["x"]).collect()) == [2, 3]
    plan = runs.read_selected(spark, str(tmp_path / "runs"), ["g"], ["x"])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "field_id" in plan.split("PushedFilters")[1]
    for fields, columns, told in ((["g", "h"], ["x"], "lacks fields"), (["g"], ["y"], "lacks"), ([], ["x"], "no field")):
        with pytest.raises(ValueError, match=told):
            runs.read_selected(spark, str(tmp_path / "runs"), fields, columns)
    with pytest.raises(ValueError, match="lacks fields"):
        runs.selected(d, spark.createDataFrame([("h",)], "field_id string"), ["x"])


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    assert readers.read_log(spark, str(path)).count() == 0
    path.write_text("\n".join(json.dumps(e) for e in splits.chain([{"a": 1}, {"a": 2}])) + "\n\n")
    got = readers.read_log(spark, str(path))
    assert tuple(splits.verify_chain(got).first()) == (2, 0, 0)
    path.write_text("{broken\n")
    with pytest.raises(Exception, match="broken line"):
        readers.read_log(spark, str(path)).collect()
    rows = spark.createDataFrame([(k, s, json.dumps({"s": s})) for k in (1, 2) for s in range(4)], "k long, s long, payload string")
    logs = splits.chains(rows, "k", "s")
    assert sorted(map(tuple, splits.verify_chains(logs, "k").collect())) == [(1, 4, 0, 0), (2, 4, 0, 0)]
    cut = logs.where("NOT (k = 1 AND index = 1)")
    assert sorted(map(tuple, splits.verify_chains(cut, "k").collect())) == [(1, 3, 0, 2), (2, 4, 0, 0)]


def test_configs(tmp_path):
    path = tmp_path / "configs.json"
    entry = {"reason": "a baseline", "decomposition": "no_decomposition", "headland": "uniform_headland", "swath": "min_width", "route": "boustrophedon_order", "path": "dubins_transit", "params": {"headland_width": 8.0}}
    path.write_text(json.dumps([entry]))
    assert readers.read_configs(str(path)) == [coverage.standard_configs()[0]]
    for bad in ([{**entry, "reason": " "}], [{**entry, "route": "x"}], [entry, entry]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            readers.read_configs(str(path))


def test_fold_evidence(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "field_id string, fold long")
    got = splits.fold_evidence(d).first()
    assert got.assignment_hash == splits.content_hash([{"field_id": f, "fold": k} for f, k in (("a", 1), ("b", 2), ("c", 1))])
    for bad in (d.where("fold = 1").union(spark.createDataFrame([("d", 1), ("e", 2)], d.schema)), d.union(d.where("field_id = 'b'"))):
        with pytest.raises(Exception, match="round-robin"):
            splits.fold_evidence(bad).collect()


def test_features_of_holes():
    square = np.array([[0.0, 0.0], [40.0, 0.0], [40.0, 20.0], [0.0, 20.0]])
    hole = np.array([[10.0, 5.0], [10.0, 10.0], [15.0, 10.0], [15.0, 5.0]])
    got = coverage.feature_values([square, hole], math.pi - 0.2, 0.5, 5.0, 2.0)
    assert got["obstacle_count"] == 1 and got["obstacle_area_ratio"] == pytest.approx(25 / 800) and got["reflex_vertex_count"] == 4
    assert got["row_angle_vs_principal"] == pytest.approx(0.2) and got["swath_count_at_minwidth"] == 4 and got["turning_ratio"] == 0.4
    assert coverage.feature_values([square], None, None, 5.0, 2.0)["crossing_density"] is None


def test_reviewers_and_gates():
    told = evolution.compile_heuristic
    for bad in ("import os", "def f(p):\n    return open('x')", "def f(p):\n    return p.__class__", "x = 1", "def f(p:", "1 / 0"):
        with pytest.raises(evolution.Refused):
            told(bad)
    fine = told("def f(p):\n    return 0.1 * min(1.0, p.get('elongation', 0.0))")
    raises, far = told("def f(p):\n    return p['elongation'] * 0"), told("def f(p):\n    return 3.0")
    say = lambda f: evolution.refuted([r(f) for r in evolution.SWATH_REVIEWERS])
    assert [say(f) for f in (fine, raises, far)] == [False, True, True]
    soft = evolution.Verdict(True, "x")
    assert evolution.refuted([soft, evolution.Verdict(False)]) and not evolution.refuted([soft, *[evolution.Verdict(False)] * 2])  # a tie rejects
    square = [np.array([[0.0, 0.0], [90.0, 0.0], [90.0, 40.0], [0.0, 40.0]])]
    features = lambda rings, direction: {**coverage.feature_values(rings, direction, 0.75, 5.0, 2.0), "x": float(rings[0][0, 0])}
    evolution.invariance_gate(fine, features, square, 0.3, np.random.default_rng(1))
    with pytest.raises(evolution.Refused, match="place"):
        evolution.invariance_gate(told("def f(p):\n    return p['x'] / 1e5"), features, square, 0.3, np.random.default_rng(1))


def test_route_scores():
    ends = [((0.0, 5.0 * k), (50.0, 5.0 * k)) for k in range(4)]
    near = evolution.compile_heuristic("def f(s, c):\n    return c['distance_norm'] + 0.01 * c['axis_offset_norm']")
    assert evolution.order_by_score(near, ends, (0.0, 0.0), (1.0, 0.0), 5.0) == [0, 1, 2, 3]
    with pytest.raises(evolution.Refused, match="share"):
        evolution.order_by_score(evolution.compile_heuristic("def f(s, c):\n    return 1.0"), ends, (0.0, 0.0), (1.0, 0.0), 5.0)
    assert not evolution.refuted([r(near) for r in evolution.ROUTE_REVIEWERS])
    assert evolution.refuted([r(evolution.compile_heuristic("def f(s, c):\n    return 1 / c['axis_offset_norm']")) for r in evolution.ROUTE_REVIEWERS])


def test_route_contract_and_motions():
    r = np.random.default_rng(3)
    ends = [((0.0, 5.0 * k), (50.0 + k, 5.0 * k)) for k in range(5)]
    place = ((22.0, 9.0), (1.0, 0.0), 5.0, 2.0)
    near = evolution.compile_heuristic("def f(s, c):\n    return c['distance_norm'] + 0.01 * c['axis_offset_norm']")
    evolution.route_contract(near)
    evolution.route_invariance_gate(near, ends, *place, r)
    first = evolution.swath_scores(evolution.compile_heuristic("def f(s, c):\n    return c['axis_offset_norm']"), ends, [], *place)
    assert first == {k: abs(5.0 * k - 9.0) / 5.0 for k in range(5)}  # without a sign
    away = evolution.swath_scores(evolution.compile_heuristic("def f(s, c):\n    return c['distance_norm']"), ends, [1], *place)
    assert away[2] == pytest.approx(np.hypot(52 - 51, 5) / 2.0)  # over the radius, from the far end to the far end
    state = []
    with pytest.raises(evolution.Refused, match="different"):
        evolution.route_contract(lambda s, c: state.append(0) or float(len(state)))
    with pytest.raises(evolution.Refused, match="place"):
        evolution.route_invariance_gate(lambda s, c: c["distance_norm"] + round(c["axis_offset_norm"] * 1e17 % 7), ends, *place, r)
    assert evolution.transfer_length(ends[:2], [0, 1], (0.0, 0.0)) == pytest.approx(np.hypot(1, 5))
    with pytest.raises(ValueError):
        evolution.transfer_length(ends, [0, 1, 1, 2, 3], (0.0, 0.0))


def test_proposers():
    r = np.random.default_rng(0)
    with pytest.raises(ValueError, match="no client"):
        evolution.asked(None, str)(r, 0)
    with pytest.raises(ValueError, match="another"):
        evolution.asked(lambda p: {"prompt": "other", "response": "x"}, str)(r, 0)
    assert evolution.asked(lambda p: {"prompt": p, "response": "def f(p):\n    return 0.0"}, lambda k: f"round {k}")(r, 3).startswith("def f")
    with pytest.raises(ValueError, match="replay"):
        evolution.checked(evolution.Candidate("mine", "x", "y", {"prompt": "p", "response": "x"}), 0)


def test_one_fold_alone(spark):
    rows = [("c", f"i{k}", k % 3 + 1, True, float(k), float(k)) for k in range(12)]
    d = spark.createDataFrame(rows, "config_id string, instance_id string, fold long, applicable boolean, x double, e1 double")
    got = recommender.cross_predict(d, ["x"], ["e1"], trees=8, held=[2])
    assert {r.fold for r in got.collect()} == {2} and got.count() == 4


def test_a_shape_is_planned_once(spark, tmp_path):
    """Three copies of the suppliers under other keys are as many shapes, and each stands for three fields."""
    d = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    n = d.count()
    d.crossJoin(spark.range(3).select(F.col("id").alias("copy"))).withColumn("s_suppkey", F.col("s_suppkey") + 1000 * F.col("copy")).drop("copy").write.parquet(str(tmp_path / "supplier.parquet"))
    fields, counts = studies._shapes(spark, str(tmp_path))
    assert fields.count() == len(counts) <= n and sum(counts.values()) == 3 * n and min(counts.values()) == 3
    fields.unpersist()
    last = entry.queries()["route_evolution_ledger"](spark, str(tmp_path)).orderBy("index").collect()[-1]
    assert json.loads(last.payload)["evaluations"] % (3 * n) == 0 < json.loads(last.payload)["evaluations"]


def test_swaths_are_laid_once_and_a_source_planned_once(spark, monkeypatch):
    """Shapes that all differ: each one's swaths serve all rounds, and a source that is proposed again costs no job."""
    from furrow.functions import geometry as geo

    data, calls, planned = "/root/testdata/sf0.001", [], studies._planned
    fields, counts = studies._shapes(spark, data, studies._laid)
    some = fields.limit(8).collect()
    assert len(some) == 8 <= len(counts)
    for r in some:
        rings = geo.parse_polygon(r.wkt)
        ends = [((a, b), (c, d)) for a, b, c, d in np.array(r.swaths).reshape(-1, 4).tolist()]
        assert ends == geo.swaths(rings, geo.principal_angle(rings[0]), 5.0, 8.0)
        if ends:
            config = coverage.Config(swath="principal_axis")
            with monkeypatch.context() as m:
                whole = coverage.plan(rings, studies._VEHICLE, config)
                m.setattr(geo, "swaths", None)
                assert {k: v for k, v in coverage.plan(rings, studies._VEHICLE, config, swaths=ends).items() if k != "segments"} == {k: v for k, v in whole.items() if k != "segments"}
    fields.unpersist()
    monkeypatch.setattr(studies, "_planned", lambda *a: calls.append(a) or planned(*a))
    log = [json.loads(r.payload) for r in entry.queries()["route_evolution_ledger"](spark, data).orderBy("index").collect()]
    evaluated = [r["candidate"] for before, r in zip([{"evaluations": 0}, *log], log) if r["evaluations"] > before["evaluations"]]
    assert len(calls) == 1 + len(set(evaluated)) < 1 + len(evaluated)  # the plan by turns, and each source


def test_route_distances_of_either_direction():
    """Each pair's distance, measured once, is that of the ends where swaths are left and entered in turn."""
    r = np.random.default_rng(5)
    ends = [tuple(map(tuple, r.uniform(0, 90, (2, 2)).tolist())) for _ in range(5)]
    away = evolution.compile_heuristic("def f(s, c):\n    return c['distance_norm']")
    for done in ([], [3], [3, 1], [3, 1, 4]):
        at = np.array([40.0, 30.0]) if not done else np.array(ends[done[-1]][len(done) % 2])
        expected = {k: float(np.hypot(*(np.array(ends[k][len(done) % 2]) - at))) / 2.0 for k in range(5) if k not in done}
        assert evolution.swath_scores(away, ends, done, (40.0, 30.0), (1.0, 0.5), 5.0, 2.0) == expected


def test_what_is_learnt_from_is_made_once(spark):
    """Several readers of the learning table do not each make it anew."""
    r, features, outputs = studies._learnable(spark, "/root/testdata/sf0.001")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "parquet" not in plan and "Exchange" not in plan
    assert r.count() == r.select("instance_id", "config_id").distinct().count() == 420 and len(features) == 12 and len(outputs) == 22


def test_regrets_side_by_side(spark):
    d = "/root/testdata/sf0.001"
    runs, fits = queries._runs(spark, d), queries._applicable(spark)
    wide = regret.wide_regrets(runs, fits)
    told = wide.select("instance_id", "config_id", F.posexplode(F.array(*(f"e{k + 1}" for k in range(22)))).alias("preference", "regret"))
    want = regret.regrets(runs, fits).select("instance_id", "config_id", F.col("preference").cast("int").alias("preference"), "regret")
    assert told.count() == want.count() and not told.exceptAll(want).count()


def test_a_shape_is_measured_once_for_its_instances(monkeypatch):
    """Instances of a field share what its shape fixes."""
    calls, of = [], coverage.narrow_swaths
    monkeypatch.setattr(coverage, "narrow_swaths", lambda *a: calls.append(1) or of(*a))
    wkt = "POLYGON ((0 0, 60 0, 60 30, 30 30, 30 60, 0 60, 0 0))"
    asked = pd.DataFrame([(str(k), wkt, 0.3, 0.75 if k % 2 else float("nan"), 5.0, 2.0) for k in range(6)], columns=["instance_id", "wkt", "row_direction", "row_spacing", "width", "radius"])
    (got,) = coverage._instance_features([asked])
    want = [coverage.feature_values(list(coverage._rings(wkt)), 0.3, s, 5.0, 2.0) for s in asked["row_spacing"]]
    assert len(calls) == 1 + len(want)
    pd.testing.assert_frame_equal(got.drop(columns="instance_id"), pd.DataFrame(want).astype(float))
