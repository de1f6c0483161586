"""Sources: field corpora, run checkpoints, logs, comparison tables and routing problems."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo

#: Licences of fields, those that permit analysis and those that permit redistribution.
LICENSES = ("public-domain", "cc0-1.0", "cc-by-4.0", "cc-by-sa-3.0-ee", "non-commercial", "unknown")
FOR_ANALYSIS = ("public-domain", "cc0-1.0", "cc-by-sa-3.0-ee", "non-commercial")
FOR_REDISTRIBUTION = ("public-domain", "cc0-1.0", "cc-by-sa-3.0-ee")
#: A field id's prefix gives its source, licence and coordinate system.
PREFIXES = {"NL": ("PDOK/Nationaal-Georegister", "public-domain", "EPSG:28992"), "EE": ("INSPIRE-EE", "cc-by-sa-3.0-ee", "EPSG:3301"), "LT": ("geoportal-lt", "non-commercial", "EPSG:3346")}
UNKNOWN = ("unknown", "unknown", "EPSG:4326")
FIELD = "field_id string, wkt string, source string, license string, source_crs string, working_crs string"
#: The columns of a comparison table, in this order.
COMPARISON = (
    "request_id", "path_length", "swath_count", "swath_length_sum", "main_field_area", "transit_entry_leg_m", "transit_turn_total_m", "transit_turn_count", "transit_inter_cell_m",
    "transit_exit_leg_m", "transit_other_m", "working_crs", "route_algorithm",
)
_TEXT = {"request_id", "working_crs", "route_algorithm"}


def read_field_archives(spark: SparkSession, path: str) -> DataFrame:
    """Fields of zip archives of WKT files, ``reason`` telling why one is unfit (null if it is fit; never repaired).

    A file's stem is the field's id; its first two letters give the source, the licence and the coordinate system.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".wkt")):
                        field = name.rsplit("/", 1)[-1][:-4]
                        text = z.read(name).decode()
                        out.append((field, text.strip(), *PREFIXES.get(field[:2].upper(), UNKNOWN), unfit(text)))
            yield pd.DataFrame(out, columns=["field_id", "wkt", "source", "license", "source_crs", "reason"])

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInPandas(run, "field_id string, wkt string, source string, license string, source_crs string, reason string")
    return found.withColumn("working_crs", F.col("source_crs"))


def unfit(text: str) -> str | None:
    try:
        rings = geo.parse_polygon(text)
    except ValueError as e:
        return str(e)
    return None if all(map(geo.is_simple, rings)) else "a ring crosses itself"


def read_field_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Exported fields, one JSON object a line; a broken line or an unknown licence is an error, blank lines are not."""
    rows = spark.read.schema(FIELD).option("mode", "FAILFAST").json(path)
    known = F.col("license").isin(*LICENSES)
    return rows.withColumn("license", F.when(known, F.col("license")).otherwise(F.raise_error(F.concat(F.lit("unknown licence of "), F.coalesce("field_id", F.lit("?"))))))


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a run's checkpoint, plain or gzipped; a run key that is there twice is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    keys = rows.groupBy("run_key").agg(F.count("*").alias("times"))
    one = F.when(F.col("times") == 1, F.col("run_key")).otherwise(F.raise_error(F.concat(F.lit("repeated run key "), F.col("run_key"))))
    return rows.join(keys.select("run_key", one.alias("checked")), "run_key").withColumn("run_key", F.col("checked")).drop("checked")


def remaining(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Runs of the grid whose key isn't done yet."""
    return grid.join(done.select("run_key"), "run_key", "left_anti")


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """A comparison table: exactly the columns above in their order, no blank text, finite numbers, each id once."""
    head = spark.read.text(path).limit(1).first()
    if head is None or tuple(head[0].split(",")) != COMPARISON:
        raise ValueError("the columns are not those of a comparison table")
    schema = ", ".join(f"{c} {'string' if c in _TEXT else 'double'}" for c in COMPARISON)
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    for c in COMPARISON:
        bad = F.col(c).isNull() | (F.trim(c) == "" if c in _TEXT else F.isnan(c) | (F.abs(c) == float("inf")))
        rows = rows.withColumn(c, F.when(bad, F.raise_error(F.lit(f"bad value in {c}")).cast(dict(rows.dtypes)[c])).otherwise(F.col(c)))
    repeated = rows.groupBy("request_id").count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError("a request id is repeated")
    return rows


class FormatError(ValueError):
    """A routing file that breaks its format."""


_KEYWORD = re.compile(r"^\s*([A-Z_]+)\s*:\s*(.*?)\s*$")


def _sections(text: str) -> tuple[dict[str, str], dict[str, list[list[str]]]]:
    """Keyword values, and the lines of each section."""
    words: dict[str, str] = {}
    sections: dict[str, list[list[str]]] = {}
    current = None
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if line == "EOF":
            break
        m = _KEYWORD.match(line)
        if m and not line[0].isdigit():
            current = None
            if m[1] in words:
                raise FormatError(f"{m[1]} is repeated")
            words[m[1]] = m[2]
        elif line.endswith("_SECTION"):
            current = sections.setdefault(line, [])
        elif current is None:
            raise FormatError(f"unexpected line {line!r}")
        else:
            current.append(line.split())
    return words, sections


def parse_routing(text: str) -> dict:
    """A TSPLIB or CVRPLIB problem: name, kind, edge weights, capacity, depot, trucks and nodes (index, x, y, demand).

    EUC_2D and CEIL_2D only; the dimension must agree, nodes and demands must be unique and the same, a depot has no
    demand. A tour problem starts at the smallest index.
    """
    words, sections = _sections(text)
    for k in ("NAME", "TYPE", "DIMENSION", "EDGE_WEIGHT_TYPE"):
        if k not in words:
            raise FormatError(f"{k} is missing")
    if words["EDGE_WEIGHT_TYPE"] not in ("EUC_2D", "CEIL_2D"):
        raise FormatError(f"edge weights {words['EDGE_WEIGHT_TYPE']} are not known")
    try:
        nodes = [(int(a), float(b), float(c)) for a, b, c in sections.get("NODE_COORD_SECTION", [])]
        demands = [(int(a), float(b)) for a, b in sections.get("DEMAND_SECTION", [])]
        depots = [int(x[0]) for x in sections.get("DEPOT_SECTION", []) if x[0] != "-1"]
    except ValueError as e:
        raise FormatError(str(e)) from e
    ids = [n[0] for n in nodes]
    if len(ids) != len(set(ids)) or len(ids) != int(words["DIMENSION"]):
        raise FormatError("nodes are repeated, or are not as many as the dimension says")
    need = dict(demands)
    out = {"name": words["NAME"], "kind": words["TYPE"], "edge_weights": words["EDGE_WEIGHT_TYPE"], "capacity": None, "start": min(ids), "trucks": None}
    if words["TYPE"] == "CVRP":
        if len(need) != len(demands) or set(need) != set(ids):
            raise FormatError("demands are repeated, or are not those of the nodes")
        if len(depots) != 1 or need.get(depots[0]) != 0:
            raise FormatError("there is one depot, without demand")
        told = re.search(r"trucks:\s*(\d+)", words.get("COMMENT", ""), re.I)
        out |= {"capacity": float(words["CAPACITY"]), "start": depots[0], "trucks": int(told[1]) if told else None}
    width = len(str(max(ids)))
    out["nodes"] = [(f"n{i:0{width}d}", x, y, need.get(i, 0.0)) for i, x, y in nodes]
    out["start"] = f"n{out['start']:0{width}d}"
    return out


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    """``(name, kind, edge_weights, capacity, start, trucks, node_id, x, y, demand)`` of routing files, one row a node."""
    schema = "name string, kind string, edge_weights string, capacity double, start string, trucks long, node_id string, x double, y double, demand double"

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                p = parse_routing(text)
                out += [(*(p[k] for k in ("name", "kind", "edge_weights", "capacity", "start", "trucks")), *n) for n in p["nodes"]]
            frame = pd.DataFrame(out, columns=["name", "kind", "edge_weights", "capacity", "start", "trucks", "node_id", "x", "y", "demand"])
            yield frame.astype({"trucks": "Int64", "capacity": "float64"})

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


#: Coordinates within these are degrees; a projected x is at least so large somewhere.
DEGREES, LEAST_EASTING = (180.0, 90.0), 1.0e4


def crs_fault(x_low: Column, x_high: Column, y_low: Column, y_high: Column, geographic: Column) -> Column:
    """Why a field's bounds can't be in the declared kind of coordinates; null if they can.

    Only the plain ranges are looked at: metres declared as degrees, and degrees declared as metres.
    """
    x, y = F.greatest(F.abs(x_low), F.abs(x_high)), F.greatest(F.abs(y_low), F.abs(y_high))
    degrees = (x <= DEGREES[0]) & (y <= DEGREES[1])
    return F.when(geographic & (x > LEAST_EASTING), F.lit("metres declared as degrees")).when(~geographic & degrees, F.lit("degrees declared as metres"))


def license_of(field_id: Column) -> Column:
    """The licence that a field id's prefix gives."""
    out = F.lit(UNKNOWN[1])
    for prefix, (_, license, _) in PREFIXES.items():
        out = F.when(F.upper(F.substring(field_id, 1, 2)) == prefix, license).otherwise(out)
    return out


def license_census(fields: DataFrame) -> DataFrame:
    """For each licence of ``fields(license, reason)``: fields, those fit for analysis and for redistribution, quarantined ones,
    and whether it rules commerce out."""
    fit = F.col("reason").isNull()
    count = lambda c: F.sum(c.cast("long"))
    return fields.groupBy("license").agg(
        F.count("*").alias("n_fields"), count(fit & F.col("license").isin(*FOR_ANALYSIS)).alias("n_for_analysis"), count(fit & F.col("license").isin(*FOR_REDISTRIBUTION)).alias("n_for_redistribution"),
        count(~fit).alias("n_quarantined"), F.first(F.col("license") == "non-commercial").alias("non_commercial"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``(index, payload json, prev_hash, entry_hash)`` of a hash-chained log; a missing file is an empty log, blank lines are
    skipped, a broken line is an error."""
    schema = "index long, payload string, prev_hash string, entry_hash string"
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    value = F.try_parse_json("value")
    broken = F.raise_error(F.concat(F.lit("a broken line: "), "value"))
    rows = lines.where(F.trim("value") != "").select(F.when(value.isNull(), broken).otherwise(F.col("value")).alias("value"))
    field = lambda k: F.get_json_object("value", f"$.{k}")
    return rows.select(field("index").cast("long").alias("index"), field("payload").alias("payload"), field("prev_hash").alias("prev_hash"), field("entry_hash").alias("entry_hash"))


def read_configs(path: str) -> list:
    """The configurations of a JSON list of objects with a reason and an algorithm for each slot, as :class:`Config`; a missing
    reason, slot or name that the catalogue lacks is an error, as is a configuration that is there twice."""
    from ..plans.coverage import CATALOGUE, Config

    out: list[Config] = []
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    for place, entry in enumerate(entries):
        if not str(entry.get("reason") or "").strip():
            raise ValueError(f"configuration {place} has no reason")
        slots = {}
        for stage, known in CATALOGUE.items():
            if entry.get(stage) not in known:
                raise ValueError(f"configuration {place} has no known {stage}")
            slots[stage] = entry[stage]
        out.append(Config(**slots, params=dict(entry.get("params") or {})))
    if len({c.config_id for c in out}) != len(out):
        raise ValueError("a configuration is there twice")
    return out
