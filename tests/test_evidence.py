"""Scenarios, logs that grow, sealed files, fold evidence and the check before an evaluation."""

import json

import pytest

from furrow.operators import splits
from furrow.sources import evidence, scenarios
from tests.test_analysis import runs as matrix


def test_scenarios(spark, tmp_path):
    d = matrix(spark, [("f:1", "it's", "ok", None, (3.0, 2.0, 1.0)), ("f:1", "b", "timeout", None, None)])
    d = d.selectExpr("*", "cast(7 as double) as feature__area", "cast(0.5 as double) as feature_cost__area")
    folders = scenarios.write_scenarios(d, str(tmp_path), cv_folds=10, row_crossable=True)
    assert [f.name for f in folders] == ["path_length", "headland_turns", "row_crossings"] and folders[0].parent.name == "crossable"
    assert sorted(p.name for p in folders[0].iterdir()) == ["algorithm_runs.arff", "cv.arff", "description.txt", "feature_costs.arff", "feature_values.arff"]
    lines = (folders[1] / "algorithm_runs.arff").read_text().splitlines()
    assert lines[0] == "@RELATION coverage_headland_turns_runs" and "{ok,timeout" in lines[5] and lines[7] == "@DATA"
    assert lines[8:] == ["'f:1',1,b,?,timeout,?", "'f:1',1,'it\\'s',?,ok,2.0"]
    assert (folders[0] / "feature_values.arff").read_text().endswith("@DATA\n'f:1',7.0\n") and "row_crossable: true" in (folders[0] / "description.txt").read_text()


def test_logs_and_seals(tmp_path):
    log, a = tmp_path / "log.jsonl", tmp_path / "a"
    a.write_text("one")
    assert evidence.entries(log) == [] and evidence.append(log, {"artifact": "a", "sha": evidence.file_hash(a)})["index"] == 0
    evidence.append(log, {"artifact": "b"})
    assert [e["payload"]["artifact"] for e in evidence.entries(log)] == ["a", "b"] and evidence.sealed(log, "b", "sha") is None
    evidence.replace_unless_sealed(a, tmp_path / "out" / "a", log, "a", "sha")
    a.write_text("two")
    with pytest.raises(ValueError, match="sealed"):
        evidence.replace_unless_sealed(a, tmp_path / "out" / "a", log, "a", "sha")
    assert (tmp_path / "out" / "a").read_text() == "one"
    log.write_text(log.read_text().replace('"b"', '"c"'))
    with pytest.raises(ValueError, match="altered"):
        evidence.entries(log)


def test_checkpoint_rows(tmp_path):
    path = tmp_path / "c.jsonl"
    assert evidence.append_rows(path, [{"run_key": "x"}, {"run_key": "y"}, {"run_key": "x"}]) == 2
    assert evidence.append_rows(path, [{"run_key": "y"}, {"run_key": "z"}]) == 1
    assert [json.loads(x)["run_key"] for x in path.read_text().splitlines()] == ["x", "y", "z"]


def test_fold_evidence(spark, tmp_path):
    fields = [f"f{k}" for k in range(25)]
    manifest = {"licenses": dict.fromkeys(fields, "cc0-1.0"), "effective_pool_size_by_instance": {"f1:a": 3}}
    made = evidence.fold_evidence(manifest, {"field_ids": ["f3", "f4"], "seal_hash": "x"})
    assert made["n_training_fields"] == 23 and sorted(made["fold_sizes"].values()) == [2] * 7 + [3] * 3
    dealt = splits.grouped_folds(spark.createDataFrame([(f,) for f in fields if f not in ("f3", "f4")], "field_id string"))
    assert {a["field_id"]: a["fold"] for a in made["assignments"]} == {r.field_id: r.fold for r in dealt.collect()}
    log = tmp_path / "log"
    assert evidence.register(made, log) == evidence.register(made, log)
    with pytest.raises(ValueError, match="something else"):
        evidence.register(evidence.fold_evidence(manifest, {"field_ids": ["f3"], "seal_hash": "x"}), log)
    with pytest.raises(ValueError, match="contradicts"):
        evidence.verified({**made, "assignments": made["assignments"][::-1]})
    for bad in ({}, {"licenses": {"a": "x"}, "effective_pool_size_by_instance": {"b:1": 1}}):
        with pytest.raises(ValueError):
            evidence.fields_of_manifest(bad)
    with pytest.raises(ValueError, match="holdout"):
        evidence.fold_evidence(manifest, {"field_ids": ["zz"], "seal_hash": "x"})


def test_holdout_and_preflight(tmp_path):
    h = evidence.Holdout()
    with pytest.raises(ValueError):
        h.verify(["a"], 1)
    h.seal(["b", "a"], 1)
    h.verify(["a", "b"], 1)
    with pytest.raises(RuntimeError):
        h.seal(["a"], 1)
    with pytest.raises(ValueError):
        h.verify(["a"], 1)
    log, census = tmp_path / "log", tmp_path / "census"
    census.write_text("x")
    evidence.append(log, {"artifact": "genesis"})
    evidence.append(log, {"artifact": "pool_census", "sha": evidence.file_hash(census)})
    files = {str(census): ("pool_census", "sha", "census")}
    evidence.preflight(log, files, ["genesis", "pool_census"], "abc", "ab", "c")
    census.write_text("y")
    with pytest.raises(ValueError, match="other bytes.*part the fields"):
        evidence.preflight(log, files, ["genesis", "pool_census"], "abc", "ab", "bc")
    with pytest.raises(ValueError, match="the log holds"):
        evidence.preflight(log, {}, ["genesis"], "abc", "ab", "c")


def test_reports(spark, tmp_path):
    from pyspark.sql import functions as F

    from furrow.functions import scalars
    from furrow.operators import pools
    from furrow.sources import sinks

    d = matrix(spark, [("i", "a", "ok", None, (3.0, 2.0, 1.0)), ("i", "b", "ok", None, (4.0, 2.0, 1.0)), ("i", "c", "ok", None, (300.0, 0.0, 0.0)), ("i", "d", "timeout", None, None)])
    sinks.write_front_figure(d, "i", str(tmp_path / "front"))
    assert (tmp_path / "front.csv").read_text().splitlines()[1:] == ["a,3.0,2.0,1.0,true", "b,4.0,2.0,1.0,false", "c,300.0,0.0,0.0,true"]
    assert (tmp_path / "front.svg").read_text().count("<circle") == 3
    with pytest.raises(ValueError, match="no point"):
        sinks.write_front_figure(d, "j", str(tmp_path / "none"))
    sinks.write_crosstab(pools.crosstab(d), str(tmp_path / "tab"))
    sinks.write_crosstab(pools.crosstab(d), str(tmp_path / "tab"))  # the same again
    assert len(json.loads((tmp_path / "tab.json").read_text())) == 4 and len((tmp_path / "tab.md").read_text().splitlines()) == 6
    with pytest.raises(FileExistsError):
        sinks.write_crosstab(pools.crosstab(d.limit(1)), str(tmp_path / "tab"))
    cost = lambda k: spark.range(1).select(scalars.objective_cost(F.lit(2.0), F.lit(k))).first()[0]
    assert (cost("minimize"), cost("maximize")) == (2.0, -2.0)
    with pytest.raises(Exception, match="direction"):
        cost("x")
