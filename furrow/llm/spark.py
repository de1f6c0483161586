"""Small helpers of the operators: the shared folder, reliable checkpoints, groups of a sorted stream, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a session without that setting, as in tests on one machine, gets a folder of its own.
    """
    context = spark.sparkContext
    if not (folder := context.getCheckpointDir()):
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="furrow-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir() or folder
    return folder


def settle(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder; survives lost executors, cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed, but that its C allocator still holds, back to the system.

    Planning and compiling a hundred queries leaves some hundred MB of it, in as many arenas as there were threads. It changes
    nothing else and takes some 30 ms; False where the JVM has no such command.
    """
    context = spark.sparkContext
    jvm, new = context._jvm, context._gateway.new_array
    try:
        kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method, as the server's own class is in a package that is not open
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys in batches that are sorted by them, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = [0, *_changes(batch, keys), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _changes(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    n = batch.num_rows
    moved = None
    for k in keys:
        column = batch.column(k)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        moved = differs if moved is None else pc.or_(moved, differs)
    return [i + 1 for i in pc.indices_nonzero(moved).to_pylist()] if n > 1 else []


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of equal keys, of ``rows`` rows or one group, with the places where groups begin and the end."""
    held: list[pa.RecordBatch] = []
    count = 0

    def told(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, [0, *_changes(table.to_batches()[0], keys), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _changes(table.to_batches()[0], keys)
        if cut:
            yield told(table.slice(0, cut[-1]).to_batches())
            held = table.slice(cut[-1]).to_batches()
            count = table.num_rows - cut[-1]
    if held:
        yield told(held)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node that links reach.

    Each round replaces every node's links by links to its smallest neighbour (large star, then small star), so
    a chain of n nodes needs about log(n) rounds; no group is gathered in one task, since a round only needs the
    minimum of each node's neighbours. Runs until nothing changes.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = settle(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = settle(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )
