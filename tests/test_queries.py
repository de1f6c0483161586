import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from furrow.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    other = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in other.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, other.fetchall())


def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() == 10 and "median_front_size" in found.columns


def test_forward_paths_are_not_shorter(spark):
    q = entry.queries()
    both = q["dubins_lengths"](spark, DATA).withColumnRenamed("length", "forward").join(q["reeds_shepp_lengths"](spark, DATA), "p_partkey")
    assert both.count() == 200 and both.where("length > forward + 1e-6").count() == 0


@pytest.mark.parametrize("name", ["evolution_ledger", "route_evolution_ledger", "recommender_test", "capacitated_routes", "nearest_neighbour_tours"])
def test_reruns_agree(spark, name):
    f = entry.queries()[name]
    assert rows(f(spark, DATA).columns, f(spark, DATA).collect()) == rows(f(spark, DATA).columns, f(spark, DATA).collect())


def test_recommender_predicts_all_preferences(spark):
    got = entry.queries()["recommender_cross_validation"](spark, DATA)
    runs = plans._runs(spark, DATA)
    assert got.columns == ["config_id", "instance_id", "fold", *(f"e{k}" for k in range(1, 23))]
    assert got.count() == runs.count() and got.where(" OR ".join(f"e{k} IS NULL OR e{k} < 0" for k in range(1, 23))).count() == 0
