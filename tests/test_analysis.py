import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import status
from furrow.operators import paths, pareto, pools, regret, splits, stats

RUN = "field_id string, instance_id string, config_id string, vehicle_index long, runstatus string, failure_reason string, path_length double, headland_turns double, row_crossings double, ref_path_length double, ref_headland_turns double, ref_row_crossings double"


def runs(spark, rows, ref=(100.0, 10.0, 10.0)):
    return spark.createDataFrame([("f", i, c, 0, s, r, *(p or (None,) * 3), *ref) for i, c, s, r, p in rows], RUN)


def test_status(spark):
    d = runs(spark, [("i", "a", "not_applicable", "validator_rejected:collision", None), ("i", "b", "ok", None, (1.0, 1.0, 1.0)), ("i", "c", "crash", "free text", None)])
    assert {r.config_id: r.status for r in pareto.with_status(d).collect()} == {"a": "collision", "b": "ok", "c": "crash"}
    assert [tuple(r) for r in pools.status_differences(d).collect()] == [("not_applicable->collision", 1)]
    bad = runs(spark, [("i", "a", "ok", "validator_rejected:nothing", None)])
    with pytest.raises(Exception, match="unknown rejection"):
        pareto.with_status(bad).select("status").collect()


def test_corpus_status(spark):
    rows = [("infeasible_kinematics", None, "uniform_headland", 2.0, "not_applicable"), ("infeasible", None, "uniform_headland", 2.0, "not_applicable"), ("constraint_violation", "validator_rejected:outside_area", "no_headland", 2.0, "not_applicable"), ("constraint_violation", "validator_rejected:outside_area", "uniform_headland", 2.0, "outside_area"), ("collision", None, "no_headland", 2.0, "collision"), ("ok", None, "no_headland", 0.0, "ok")]
    d = spark.createDataFrame(rows, "s string, r string, h string, t double, want string")
    assert d.where(status.corpus_status(F.col("s"), F.col("r"), F.col("h"), F.col("t")) != F.col("want")).count() == 0
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("x", "y", "z", 1.0)], "s string, r string, h string, t double").select(status.corpus_status(F.col("s"), F.col("r"), F.col("h"), F.col("t"))).collect()


def test_front_and_medians(spark):
    rows = [("i", "a", "ok", None, (1.0, 3.0, 3.0)), ("i", "b", "ok", None, (3.0, 1.0, 3.0)), ("i", "c", "ok", "validator_rejected:outside_area", (0.0, 0.0, 0.0)), ("j", "a", "crash", None, None)]
    sizes = pareto.front_sizes(runs(spark, rows))
    assert {r.instance_id: r.front_size for r in sizes.collect()} == {"i": 2, "j": None}
    f = pareto.field_estimates(sizes).first()
    assert (f.median_front_size, f.median_zero_as_zero, f.n_front_instances) == (2.0, 1.0, 1)
    equal = runs(spark, [("i", "a", "ok", None, (1.0, 1.0, 1.0)), ("i", "b", "ok", None, (1.0, 1.0, 1.0))])
    assert pareto.front(pareto.points(equal)).count() == 2
    empty = runs(spark, [])
    assert pareto.front_sizes(empty).count() == 0 and pareto.pareto_summary(empty).first().n_instances_in_corpus == 0


def test_hypervolume_truths(spark):
    v = lambda p, r: pareto.volume(np.array(p, float), np.array(r, float))
    assert v([(3, 2, 1)], (10, 8, 5)) == 7 * 6 * 4
    assert v([(3, 2, 1), (20, 0, 0)], (10, 8, 5)) == 168
    assert v([(2, 2, 2)], (10, 10, 10)) == 512
    assert v([(10, 0, 0)], (10, 10, 10)) == 0
    r = np.random.default_rng(1)
    p = r.integers(0, 6, (7, 3)).astype(float)
    want = sum(any((q <= cell).all() for q in p) for cell in map(np.array, itertools.product(range(7), repeat=3)))
    assert v(p, (7, 7, 7)) == want
    d = runs(spark, [("i", "a", "ok", None, (3.0, 2.0, 1.0)), ("i", "b", "ok", None, (200.0, 0.0, 0.0))], (10.0, 8.0, 5.0))
    e = pareto.front_evaluation(d).first()
    assert (e.n_beyond, e.front_size, e.hypervolume) == (1, 1, 168.0)


def test_regret_truths(spark):
    d = runs(spark, [("i", "A", "ok", None, (10.0, 5.0, 2.0)), ("i", "B", "ok", None, (20.0, 2.0, 1.0))])
    r = {(x.config_id, x.preference): x.regret for x in regret.regrets(d).collect()}
    for k, (a, b) in enumerate([(0.0, 0.1), (0.3, 0.0), (0.1, 0.0)]):
        assert r["A", k] == pytest.approx(a) and r["B", k] == pytest.approx(b)
    base = {x.preference: x.random_applicable for x in regret.random_baselines(regret.regrets(d)).collect()}
    assert [base[k] for k in range(3)] == pytest.approx([0.05, 0.15, 0.05])
    missing = runs(spark, [("i", "A", "ok", None, (10.0, 5.0, 2.0)), ("i", "B", "timeout", None, None)])
    assert {x.config_id: x.regret for x in regret.regrets(missing).where("preference = 0").collect()} == {"A": 0.0, "B": 1.0}
    none = runs(spark, [("i", "A", "timeout", None, None)])
    assert regret.regrets(none).where("regret IS NOT NULL").count() == 0
    assert len(regret.grid()) == 22 and all(math.isclose(sum(w), 1) for w in regret.grid())


def test_census_and_completeness(spark):
    d = runs(spark, [("i", "A", "ok", None, (1.0, 1.0, 1.0)), ("i", "A", "ok", None, (1.0, 1.0, 1.0)), ("i", "X", "ok", None, (1.0, 1.0, 1.0))])
    c = pareto.completeness(d, spark.createDataFrame([("A",), ("B",)], "config_id string")).first()
    assert (c.n_rows, c.n_configs, c.n_foreign, c.n_missing, c.complete) == (3, 2, 1, 1, False)
    n = pools.census(d, spark.createDataFrame([("A", 0)], "config_id string, vehicle_index long")).first()
    assert (n.nominal, n.applicable, n.observed, n.violated) == (2, 2, 3, True)


def test_static_applicable(spark):
    from furrow.plans.coverage import CATALOGUE, standard_configs

    configs = standard_configs()
    c = spark.createDataFrame([(str(k), x.decomposition, x.headland, x.swath, x.route, x.path) for k, x in enumerate(configs)], "config_id string, decomposition string, headland string, swath string, route string, path string")
    v = spark.createDataFrame([(0, False), (1, True)], "vehicle_index long, can_reverse boolean")
    cards = spark.createDataFrame([(s, a) for s, names in CATALOGUE.items() for a in names], "stage string, algorithm string")
    found = {r.vehicle_index: r["count"] for r in pools.static_applicable(c, v, cards).groupBy("vehicle_index").count().collect()}
    assert len(configs) == 13 and len({x.config_id for x in configs}) == 13 and found == {0: 11, 1: 13}


def test_rank_statistics(spark):
    values = [3.0, -1.0, 2.0, 2.0, 0.0, -4.0, 0.0, 5.0]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    for pratt in (False, True):
        x = np.array(values if pratt else [v for v in values if v])
        order = np.abs(x)
        ranks = np.array([(order < v).sum() + ((order == v).sum() + 1) / 2 for v in order])
        got = stats.wilcoxon_greater(d, "x", 0.0, pratt).first()
        assert got.statistic == ranks[x > 0].sum() and got.n_zero == 2 and got.n == 8
        m, z0 = len(x), int((x == 0).sum())
        var = (m * (m + 1) * (2 * m + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24 - sum(t**3 - t for t in np.unique(order[order > 0], return_counts=True)[1]) / 48
        assert got.z == pytest.approx((got.statistic - (m * (m + 1) - z0 * (z0 + 1)) / 4) / math.sqrt(var), abs=1e-8)
    zeros = stats.wilcoxon_greater(spark.createDataFrame([(0.0,)], "x double"), "x", 0.0).first()
    assert zeros.z is None and stats.p_value(zeros.z) == 1.0
    s = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 3, 6.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0), ("c", 1, 2.0)], "k string, x int, y double")
    rho = {r.k: r.rho for r in stats.spearman(s, "k", "x", "y").collect()}
    assert rho["a"] == pytest.approx(math.sqrt(3) / 2) and rho["b"] == 0.0 and rho["c"] is None


def large_signed_rank(spark, pratt):
    """The record of three million differences -1, 0, 1, 2, 1, as given and by whole numbers in Python."""
    n = 3_000_000
    d = spark.range(n).select((F.array(*(F.lit(float(v)) for v in (-1, 0, 1, 2, 1)))[(F.col("id") % 5).cast("int")]).alias("x"))
    fifth = n // 5
    z0 = fifth if pratt else 0
    ones = 2 * z0 + 3 * fifth + 1  # twice the rank of a difference of size 1
    twos = 2 * z0 + 7 * fifth + 1
    statistic = Fraction(2 * fifth * ones + fifth * twos, 2)
    m = 4 * fifth + z0
    var = Fraction(m * (m + 1) * (2 * m + 1) - z0 * (z0 + 1) * (2 * z0 + 1), 24) - Fraction((3 * fifth) ** 3 - 3 * fifth + fifth**3 - fifth, 48)
    return stats.wilcoxon_greater(d, "x", 0.0, pratt).first(), (n, fifth, float(statistic), float(statistic - Fraction(m * (m + 1) - z0 * (z0 + 1), 4)) / math.sqrt(var))


def test_signed_rank_of_millions(spark):
    got, want = large_signed_rank(spark, False)
    assert (got.n, got.n_zero, got.statistic) == want[:3] and got.z == pytest.approx(want[3], abs=1e-8)


def test_signed_rank_of_millions_with_zeros(spark):
    got, want = large_signed_rank(spark, True)
    assert (got.n, got.n_zero, got.statistic) == want[:3] and got.z == pytest.approx(want[3], abs=1e-8)


def test_sign_flip():
    assert splits.sign_flip_p([0.1, -0.2, 0.05, -0.3, -0.15], 500, 1) * 501 == pytest.approx(round(splits.sign_flip_p([0.1, -0.2, 0.05, -0.3, -0.15], 500, 1) * 501))
    assert splits.sign_flip_p([-1.0] * 20, 500, 1) < 0.01 < splits.sign_flip_p([1.0] * 20, 500, 1)


def test_folds(spark):
    import hashlib

    ids = [f"f{k}" for k in range(37)]
    got = {r.field_id: r.fold for r in splits.grouped_folds(spark.createDataFrame([(i,) for i in ids * 2], "field_id string")).collect()}
    want = sorted(ids, key=lambda i: (hashlib.sha256(f"{splits.SEED}\x1f{i}".encode()).hexdigest(), i))
    assert got == {i: k % 10 + 1 for k, i in enumerate(want)}
    one = spark.createDataFrame([("abc",)], "f string").select(splits.hash_fold(F.col("f"), 7)).first()[0]
    assert one == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") % 7 + 1
    held = splits.field_holdout(ids, 0.3, 1)
    assert len(held) == 11 and held == splits.field_holdout(reversed(ids), 0.3, 1)
    with pytest.raises(ValueError):
        splits.field_holdout(["a"], 0.5, 1)


def test_chain(spark):
    log = splits.chain([{"a": 1}, {"b": [2.5, None]}, "ü"])
    import json

    rows = [(e["index"], json.dumps(e["payload"]), e["prev_hash"], e["entry_hash"]) for e in log]
    schema = "index long, payload string, prev_hash string, entry_hash string"
    assert tuple(splits.verify_chain(spark.createDataFrame(rows, schema)).first()) == (3, 0, 0)
    rows[1] = (1, json.dumps({"b": 3}), *rows[1][2:])
    assert tuple(splits.verify_chain(spark.createDataFrame(rows, schema)).first()) == (3, 1, 0)
    rows[1] = (1, rows[1][1], None, splits.log_entry(1, {"b": 3}, None)["entry_hash"])
    assert tuple(splits.verify_chain(spark.createDataFrame(rows, schema)).first()) == (3, 0, 2)


def test_comparison(spark):
    a = spark.createDataFrame([("x", 1.0, 0.0), ("y", 2.0, 1.0)], "k string, m double, n double")
    assert {r.n_disagree for r in stats.compare(a, a, "k", ["m", "n"]).collect()} == {0}
    b = spark.createDataFrame([("x", 1.0, 0.0), ("y", 2.5, 0.0)], "k string, m double, n double")
    got = {r.metric: r for r in stats.compare(a, b, "k", ["m", "n"]).collect()}
    assert got["m"].max_rel == pytest.approx(0.2) and got["n"].max_rel == math.inf
    with pytest.raises(Exception, match="different keys"):
        stats.compare(a, b.where("k = 'x'"), "k", ["m"]).collect()


def test_polylines(spark):
    rows = [("sq", k, x, y) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)])] + [("back", 0, 0, 0), ("back", 1, 2, 0), ("back", 2, 1, 0), ("dot", 0, 1, 1)]
    d = spark.createDataFrame([(k, s, float(x), float(y)) for k, s, x, y in rows], "path_id string, seq int, x double, y double")
    m = {r.path_id: r for r in paths.polyline_metrics(d).collect()}
    assert m["sq"].length == 4 and m["sq"].heading_change == pytest.approx(1.5 * math.pi) and m["sq"].tortuosity == math.inf
    assert m["back"].cusps == 1 and m["back"].tortuosity == 3 and m["dot"].tortuosity == 1 and m["dot"].length == 0
    dense = paths.densify(d.where("path_id = 'back'"), 0.5).orderBy("seq").collect()
    assert [r.x for r in dense] == [0, 0.5, 1, 1.5, 2, 1.5, 1]
    even = paths.resample(d.where("path_id = 'back'"), 4).orderBy("seq").collect()
    assert [r.x for r in even] == pytest.approx([0, 1, 2, 1]) and [r.seq for r in even] == [0, 1, 2, 3]


def test_segments(spark):
    rows = [("p", k, kind, float(n), c) for k, (kind, n, c) in enumerate([("TURN", 3, None), ("WORK", 10, 0), ("TURN", 2, None), ("TURN", 1, None), ("WORK", 10, 0), ("WORK", 5, 1), ("TURN", 4, None), ("WORK", 5, 0), ("TURN", 7, None)])]
    schema = "path_id string, seq int, kind string, length double, cell int"
    m = paths.segment_metrics(spark.createDataFrame(rows, schema)).first()
    assert (m.entry_m, m.turn_m, m.inter_cell_m, m.exit_m, m.n_turns, m.n_inter_cell, m.headland_turns) == (3, 3, 4, 7, 1, 2, 3)
    with pytest.raises(Exception, match="without work"):
        paths.segment_metrics(spark.createDataFrame([("p", 0, "TURN", 1.0, None)], schema)).collect()


def test_nearest_places():
    r = np.random.default_rng(2)
    for k in range(60):
        n, wide = int(r.integers(1, 40)), [0, 3, 1000][k % 3]
        x, y, cx, cy = (r.integers(0, wide * s + 1, size).astype(float) for s, size in ((1, 30), (2, 30), (1, n), (1 + k % 2 * 4, n)))
        d = np.sqrt((x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2)
        found, distance = paths.nearest_places(x, y, cx, cy)
        assert (found == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_nearest_cells_make_no_pairs(spark):
    """Nulls, ties and fields without cells; and no join whose pairs would have to be kept."""
    s = spark.createDataFrame([("f", 1, 0.0, 0.0), ("f", 2, 5.0, 5.0), ("f", 3, None, 1.0), ("g", 4, 0.0, 0.0), (None, 5, 0.0, 0.0), ("h", 6, 1.0, 1.0)], "field_id string, segment_id long, x double, y double")
    c = spark.createDataFrame([("f", 9, 0.0, 1.0), ("f", 8, 1.0, 0.0), ("f", 7, None, 0.0), ("h", 3, 1.0, None), ("h", 2, None, 1.0), (None, 1, 0.0, 0.0)], "field_id string, cell int, cx double, cy double")
    found = paths.nearest_cells(s, c)
    assert found.dtypes == [("segment_id", "bigint"), ("cell", "int"), ("distance", "double")]
    rows = {r.segment_id: (r.cell, r.distance) for r in found.collect()}
    assert rows == {1: (8, 1.0), 2: (8, math.sqrt(41)), 3: (7, None), 4: (None, None), 5: (None, None), 6: (2, None)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
