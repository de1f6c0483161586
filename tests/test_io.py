import gzip
import json
import zipfile

import pytest

from furrow.sources import readers, sinks
from furrow.streaming.resume import ingest

SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
TSP = "NAME: s\nTYPE: TSP\nDIMENSION: 4\nEDGE_WEIGHT_TYPE: EUC_2D\nNODE_COORD_SECTION\n1 0 0\n2 10 0\n3 10 10\n4 0 10\nEOF\n"
CVRP = "NAME : v\nCOMMENT : (trucks: 2)\nTYPE : CVRP\nDIMENSION : 3\nEDGE_WEIGHT_TYPE : EUC_2D\nCAPACITY : 30\nNODE_COORD_SECTION\n1 0 0\n2 1 0\n3 2 0\nDEMAND_SECTION\n1 0\n2 10\n3 20\nDEPOT_SECTION\n1\n-1\nEOF\n"


def test_field_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("NL_1.wkt", SQUARE)
        z.writestr("XX_2.wkt", SQUARE)
        z.writestr("EE_3.wkt", "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))")
        z.writestr("LT_4.wkt", "POINT (0 0)")
        z.writestr("read.me", "")
    fields = readers.read_field_archives(spark, str(tmp_path / "*.zip"))
    got = {r.field_id: r for r in fields.collect()}
    assert got["NL_1"].license == "public-domain" and got["NL_1"].reason is None and got["XX_2"].license == "unknown"
    assert "crosses" in got["EE_3"].reason and "polygon" in got["LT_4"].reason and len(got) == 4
    m = sinks.export_fields(fields, str(tmp_path / "out"), readers.FOR_REDISTRIBUTION)
    assert (m["input"], m["quarantined"], m["filtered"], m["exported"]) == (4, 2, 1, 1)
    assert [r.field_id for r in readers.read_field_corpus(spark, str(tmp_path / "out")).collect()] == ["NL_1"]
    (tmp_path / "bad.jsonl").write_text(json.dumps({"field_id": "a", "license": "MINE"}) + "\n\n")
    with pytest.raises(Exception, match="unknown licence"):
        readers.read_field_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_checkpoints(spark, tmp_path):
    rows = [{"run_key": "a", "x": 1}, {"run_key": "b", "x": 2}]
    for name in ("one.jsonl.gz", "two.jsonl.gz"):
        sinks.write_checkpoint(rows, str(tmp_path / name))
    assert (tmp_path / "one.jsonl.gz").read_bytes() == (tmp_path / "two.jsonl.gz").read_bytes()
    assert len(gzip.decompress((tmp_path / "one.jsonl.gz").read_bytes()).splitlines()) == 2
    done = readers.read_checkpoint(spark, str(tmp_path / "one.jsonl.gz"), "run_key string, x long")
    assert done.count() == 2
    grid = spark.createDataFrame([("a",), ("c",)], "run_key string")
    assert [r.run_key for r in readers.remaining(grid, done).collect()] == ["c"]
    with pytest.raises(Exception, match="repeated run key"):
        readers.read_checkpoint(spark, str(tmp_path / "*.gz"), "run_key string, x long").collect()


def test_comparison(spark, tmp_path):
    head = ",".join(readers.COMPARISON)
    line = ",".join(["r1", *["1.5"] * 10, "EPSG:1", "boustrophedon"])
    (tmp_path / "a.csv").write_text(f"{head}\n{line}\n")
    assert readers.read_comparison(spark, str(tmp_path / "a.csv")).first().path_length == 1.5
    for text in (f"{head},x\n{line},1\n", f"{head}\n{line}\n{line}\n", f"{head}\n{line.replace('1.5', 'x', 1)}\n", f"{head}\n{line.replace('1.5', 'NaN', 1)}\n", f"{head}\n{line.replace('EPSG:1', ' ')}\n"):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            readers.read_comparison(spark, str(tmp_path / "b.csv")).collect()


def test_routing_files(spark, tmp_path):
    (tmp_path / "s.tsp").write_text(TSP)
    rows = readers.read_routing(spark, str(tmp_path / "s.tsp")).collect()
    assert [r.node_id for r in rows] == ["n1", "n2", "n3", "n4"] and rows[0].start == "n1"
    p = readers.parse_routing(CVRP)
    assert (p["capacity"], p["trucks"], p["start"], [n[3] for n in p["nodes"]]) == (30.0, 2, "n1", [0.0, 10.0, 20.0])
    for bad in (TSP.replace("EUC_2D", "GEO"), TSP.replace("DIMENSION: 4", "DIMENSION: 5"), TSP.replace("2 10 0", "1 10 0"), CVRP.replace("1 0\n2 10", "1 5\n2 10"), CVRP.replace("3 20", "2 20")):
        with pytest.raises(readers.FormatError):
            readers.parse_routing(bad)


def test_exchange(spark, tmp_path):
    assert sinks.quoted("a b'c") == "'a b\\'c'" and sinks.quoted("a-1") == "a-1"
    d = spark.createDataFrame([("i 1", 1.5), ("j", None)], "instance_id string, x double")
    sinks.write_exchange(d, str(tmp_path / "e"), "runs", ["instance_id"])
    data = [r.value for r in spark.read.text(str(tmp_path / "e/data")).collect()]
    assert sorted(data) == ["'i 1',1.5", "j,?"]
    assert [r.value for r in spark.read.text(str(tmp_path / "e/header")).collect()][0] == "@RELATION runs"


def test_write_once(tmp_path):
    sinks.write_once(str(tmp_path / "r"), "a")
    sinks.write_once(str(tmp_path / "r"), "a")
    with pytest.raises(FileExistsError):
        sinks.write_once(str(tmp_path / "r"), "b")


def test_resumed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"run_key": "a", "x": 1}\n{"run_key": "a", "x": 1}\n{"run_key": "b", "x": 2}\n')
    go = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "run_key string, x long").awaitTermination()
    go()
    (tmp_path / "in/2.json").write_text('{"run_key": "b", "x": 2}\n{"run_key": "c", "x": 3}\n')
    go()
    assert sorted(r.run_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_declared_coordinates(spark):
    from pyspark.sql import functions as F

    rows = [(155000.0, 156000.0, 463000.0, 464000.0, True, "metres"), (5.0, 5.1, 52.0, 52.1, False, "degrees"), (5.0, 5.1, 52.0, 52.1, True, None), (155000.0, 156000.0, 463000.0, 464000.0, False, None)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, g boolean, want string")
    got = d.select("want", readers.crs_fault(*(F.col(c) for c in "abcdg")).alias("fault")).collect()
    assert all((r.fault is None) == (r.want is None) and (r.want is None or r.fault.startswith(r.want)) for r in got)
