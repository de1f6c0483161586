"""Operators on tables of fields as WKT polygons: cells, unions and metres."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import overlays


def _area(rings: overlays.Polygon) -> float:
    return abs(geo.signed_area(rings[0])) - sum(abs(geo.signed_area(h)) for h in rings[1:])


def _rows(df: DataFrame, told: Callable, schema: str) -> DataFrame:
    """``(field_id, ...)`` of the rows that ``told(row)`` gives for each row of ``df(field_id, ...)``; it doesn't look at the id.

    The rows are few bytes and the work on them is not, so they are dealt out to all cores, and neighbours that differ in their
    id alone share the work.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    shape = [c for c in df.columns if c != "field_id"]

    def run(batches):
        before, found = None, []
        for pdf in batches:
            out = []
            for r in pdf[["field_id", *shape]].itertuples(index=False):
                now = [x.tolist() if hasattr(x, "tolist") else x for x in r[1:]]
                if now != before:
                    before, found = now, told(r)
                out += [(r.field_id, *x) for x in found]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(*shape).mapInPandas(run, schema)


def decomposed(fields: DataFrame) -> DataFrame:
    """``(field_id, cell_id, wkt, area)``: the boustrophedon cells of ``fields(field_id, wkt, obstacles array<string>)``,
    numbered from ``cell-0000``.

    Null obstacles are none; a null or unreadable polygon and a field without free space are errors. Other columns are not read.
    """

    def told(r):
        found = overlays.cells(geo.parse_polygon(r.wkt), [geo.parse_polygon(o) for o in (r.obstacles if r.obstacles is not None else [])])
        return [(f"cell-{k:04d}", geo.format_polygon(c), _area(c)) for k, c in enumerate(found)]

    return _rows(fields.select(F.col("field_id").cast("string").alias("field_id"), "wkt", "obstacles"), told, "field_id string, cell_id string, wkt string, area double")


def united(pieces: DataFrame) -> DataFrame:
    """``(field_id, part, wkt, n_holes, area)``: the union of each row's ``pieces(field_id, pieces array<string>)`` as polygons
    that don't overlap, with its area checked. Null or no pieces give no rows. Other columns are not read."""

    def told(r):
        found = overlays.union([geo.parse_polygon(p) for p in (r.pieces if r.pieces is not None else [])])
        return [(k, geo.format_polygon(p), len(p) - 1, _area(p)) for k, p in enumerate(found)]

    return _rows(pieces.select(F.col("field_id").cast("string").alias("field_id"), "pieces"), told, "field_id string, part long, wkt string, n_holes long, area double")


def metric(fields: DataFrame) -> DataFrame:
    """``(field_id, wkt, working_crs, area, reason)``: ``fields(field_id, wkt, source_crs)`` in metres, and the code of their system
    as ``EPSG:n``. A field whose coordinates can't be in the declared system, or whose system isn't known, keeps its text and has a
    reason instead of a system; so does an unreadable one. Other columns are not read."""

    def told(r):
        try:
            rings, code = overlays.to_metric(geo.parse_polygon(r.wkt or ""), int(str(r.source_crs).rpartition(":")[2]))
            return [(geo.format_polygon(rings), f"EPSG:{code}", _area(rings), None)]
        except ValueError as e:
            return [(r.wkt, None, None, str(e))]

    return _rows(fields.select(F.col("field_id").cast("string").alias("field_id"), "wkt", "source_crs"), told, "field_id string, wkt string, working_crs string, area double, reason string")
