"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations alone.

A source's documents shall be taken target / size times on average. The whole part is the same for all; the
fractional copies are settled in pairs: mass, in words, moves from one document to the other, at random and with
unchanged expectations, until one of the two is taken a whole number of times, and the other goes on. Groups of
about 64 documents are settled side by side and leave one document each; these meet in further rounds, a reduction
tree of log64(n) levels, until one document a source is left, which is rounded. What that rounding adds or takes is evened
out among the documents of the last group, the longest that make up for it first, so that a source's words miss
its target by about its shortest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spark import settle

WEIGHTS, MOST, GROUP = (5, 2, 1), 3, 64
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: the number of words of each whole text, 0 for a null one."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, n, source_size, target)``: all words shared by weight, no source above ``most`` times its size.

    Sources by code point, null last, weigh ``weights`` in turn. A source above its bound stops there and the
    rest is shared by weight among the others, until none is above. With sources in the order of bound / weight
    those that stop come first, so one pass of running sums over the sources finds them.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1) % len(weights) + 1
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn.cast("int")))
    by = by.withColumn("bound", (F.col("source_size") * most).cast("double"))
    # ties in bound / weight stop together; the source's order makes the sums the same in every run
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    by = by.withColumn("level", level).withColumn("stops", F.col("bound") <= F.col("level") * F.col("weight"))
    share = F.min(F.when(~F.col("stops"), F.struct(F.col("bound") / F.col("weight"), "level"))).over(whole)["level"]
    return by.select("source", "n", "source_size", F.when(F.col("stops"), F.col("bound")).otherwise(share * F.col("weight")).alias("target"))


def _unit(*of) -> Column:
    """A number in [0, 1) that hangs on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _step(level: int):
    return lambda state, b: _pivot(state, b, level)


def _pivot(state: Column, b: Column, level: int) -> Column:
    """One step: the document left so far meets ``b``."""
    a = state["left"]
    size_a, size_b = a["size"].cast("double"), b["size"].cast("double")
    free_a, free_b = size_a - a["mass"], size_b - b["mass"]
    to_a, to_b = F.least(free_a, b["mass"]), F.least(a["mass"], free_b)
    gains = _unit(a["salt"], b["salt"], F.lit(level)) * (to_a + to_b) < to_b
    mass_a = F.when(gains, F.when(free_a <= b["mass"], size_a).otherwise(a["mass"] + b["mass"])).otherwise(F.when(a["mass"] <= free_b, F.lit(0.0)).otherwise(a["mass"] - free_b))
    mass_b = F.when(gains, F.when(b["mass"] <= free_a, F.lit(0.0)).otherwise(b["mass"] - free_a)).otherwise(F.when(free_b <= a["mass"], size_b).otherwise(b["mass"] + a["mass"]))
    met = F.array(a.withField("mass", mass_a), b.withField("mass", mass_b))
    settled = lambda x: (x["mass"] <= 0) | (x["mass"] >= x["size"])
    # the pair is bound to a name once, as the element of a one-element array
    step = F.transform(F.array(met), lambda pair: F.struct(F.try_element_at(F.filter(pair, lambda x: ~settled(x)), F.lit(1)).alias("left"), F.concat(state["done"], F.filter(pair, settled)).alias("done")))
    return F.when(a.isNull(), F.struct(b.alias("left"), state["done"].alias("done"))).otherwise(step[0])


def _evened(told: Column) -> Column:
    """All documents of a source's last group, settled: the one left is rounded, and others make up for it."""
    left = told["left"]
    up = left["mass"] * 2 >= left["size"]
    rounded = left.withField("mass", F.when(up, left["size"].cast("double")).otherwise(F.lit(0.0)))
    kind = F.array(rounded)
    start = F.struct(F.when(up, left["size"] - left["mass"]).otherwise(-left["mass"]).alias("over"), kind.alias("done"))

    def make_up(state: Column, d: Column) -> Column:
        over, size = state["over"], d["size"].cast("double")
        drop = (over > 0) & (d["mass"] > 0) & (size < over * 2)
        add = (over < 0) & (d["mass"] <= 0) & (size < over * -2)
        mass = F.when(drop, F.lit(0.0)).when(add, size).otherwise(d["mass"])
        return F.struct((over + mass - d["mass"]).alias("over"), F.concat(state["done"], F.array(d.withField("mass", mass))).alias("done"))

    return F.when(left.isNull(), told["done"]).otherwise(F.aggregate(F.sort_array(told["done"]), start, make_up)["done"])


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, group: int = GROUP) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` for each row of ``docs``; ``taken`` is copies * size.

    A document is taken at most ``most`` times, one without words counts no words and is taken 0 times. Null
    texts have no words; null sources are one source, the last; null ids are ids like any other. Rows that repeat
    an id are settled each; equal ones are counted and numbered first, so that many of them, say without an id, are
    spread over groups like others. The choice hangs on ids, sizes and sources alone, so reruns agree on any cluster.
    """
    sized = sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("equal"))
    sized = settle(sized.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("equal").cast("int"))).alias("nth")))
    aims = settle(targets(sized, weights, most))
    kinds, largest = aims.agg(F.count("*"), F.max("n")).first()
    # a table of sources is broadcast only where it has been counted to be small
    joined = sized.join(F.broadcast(aims) if kinds <= 10_000 else aims, sized["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn("base", F.floor("rate").cast("long"))
    joined = joined.withColumn("mass", (F.col("rate") - F.col("base")) * F.col("size")).withColumn("salt", F.xxhash64("doc_id", "size", "source", "nth"))
    fields = ["doc_id", "source", "n", "size", "source_size", "target", "base", "salt", "mass"]
    joined = joined.select(*fields)
    whole = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
    parts = [joined.where(whole)]
    rest = joined.where(~whole)
    level = 0
    left = largest or 0
    while left > 0:
        level += 1
        last = left <= 2 * group
        groups = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(F.col("n") / group**level)).cast("int")
        element = F.struct((-F.col("size")).alias("first"), *(F.col(c) for c in ("salt", "doc_id", "n", "size", "source_size", "target", "base", "mass")))
        gathered = rest.withColumn("at", F.pmod(F.xxhash64("salt", "doc_id", F.lit(level)), groups)).groupBy("source", "at").agg(F.sort_array(F.collect_list(element)).alias("found"))
        kind = gathered.schema["found"].dataType.elementType.simpleString()
        start = F.struct(F.lit(None).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done"))
        told = settle(gathered.select("source", F.aggregate("found", start, _step(level)).alias("s")))
        flat = lambda df, c: df.select("source", F.col(f"{c}.*")).select(*fields)
        parts.append(flat(told.select("source", F.explode(_evened(F.col("s")) if last else F.col("s.done")).alias("d")), "d"))
        rest = flat(told.where("s.left IS NOT NULL").select("source", F.col("s.left").alias("d")), "d")
        left = 0 if last else -(-left // group)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("mass") >= F.col("size")).cast("long")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
