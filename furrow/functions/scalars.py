"""Scalar formulas as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
#: Sides of the polygon that stands for a disc: 16 to a quarter turn.
DISC_SIDES = 4 * 16
#: Area of that polygon for radius 1.
DISC_AREA = 0.5 * DISC_SIDES * math.sin(TAU / DISC_SIDES)


def wrapped(angle: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(TAU)) - math.pi


def full_turn(angle: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(TAU))


def nearest_integer(x: Column) -> Column:
    """Half goes up, for numbers of at least 0."""
    return F.floor(x + 0.5)


def tsplib_distance(dx: Column, dy: Column, kind: str) -> Column:
    """Distance by the rounding of ``EUC_2D`` or ``CEIL_2D``."""
    d = F.sqrt(dx * dx + dy * dy)
    if kind == "EUC_2D":
        return nearest_integer(d)
    if kind == "CEIL_2D":
        return F.ceil(d)
    raise ValueError(f"unknown edge weight type {kind}")


def optimality_gap(value: Column, optimum: Column) -> Column:
    return F.when(optimum > 0, (value - optimum) / optimum).otherwise(F.raise_error(F.lit("an optimum is above 0")).cast("double"))


def row_crossings(dx: Column, dy: Column, direction: Column, spacing: Column) -> Column:
    """Rows that a straight move crosses: its share across the rows by their spacing."""
    return F.abs(-F.sin(direction) * dx + F.cos(direction) * dy) / spacing


def direction_cost(heading: Column, direction: Column, along: Column, across: Column, crossable: Column) -> Column:
    """Cost of a heading among rows; infinite across rows that can't be crossed, unless parallel."""
    off = F.abs(F.sin(heading - direction))
    return F.when(~crossable & (off > 1e-12), F.lit(float("inf"))).otherwise(along + (across - along) * off)


def dominates(left: list[Column], right: list[Column], rtol: float = 1e-12) -> Column:
    """Whether the left point is nowhere worse and somewhere better, beyond a relative tolerance; smaller is better."""
    no_worse, better = F.lit(True), F.lit(False)
    for a, b in zip(left, right):
        tolerance = rtol * F.greatest(F.abs(a), F.abs(b), F.lit(1e-300))
        no_worse = no_worse & (a <= b + tolerance)
        better = better | (a < b - tolerance)
    return no_worse & better


def scalarize(values: list[Column], references: list[Column], weights: list[Column]) -> Column:
    """Weighted Chebyshev distance from 0, each objective by its reference."""
    return F.greatest(*(w * (v / r) for v, r, w in zip(values, references, weights)))


# Dubins words between poses of equal turning radius, for the goal at (d, .) in units of the radius with start
# heading a and end heading b after turning the line between the poses into the x axis.


def _arc(cosine: Column, value: Column) -> Column:
    return F.when(cosine.between(-1.0, 1.0), value)


def dubins_words(dx: Column, dy: Column, start: Column, end: Column, radius: Column) -> dict[str, Column]:
    """Lengths of the six words; null where a word doesn't exist."""
    d = F.hypot(dx, dy) / radius
    line = F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.atan2(dy, dx))
    a, b = full_turn(start - line), full_turn(end - line)
    sa, sb, ca, cb, cab = F.sin(a), F.sin(b), F.cos(a), F.cos(b), F.cos(a - b)
    words = {}
    p2 = 2 + d * d - 2 * cab + 2 * d * (sa - sb)
    t = F.atan2(cb - ca, d + sa - sb)
    words["LSL"] = F.when(p2 >= 0, full_turn(t - a) + F.sqrt(F.greatest(p2, F.lit(0.0))) + full_turn(b - t))
    p2 = 2 + d * d - 2 * cab + 2 * d * (sb - sa)
    t = F.atan2(ca - cb, d - sa + sb)
    words["RSR"] = F.when(p2 >= 0, full_turn(a - t) + F.sqrt(F.greatest(p2, F.lit(0.0))) + full_turn(t - b))
    p2 = -2 + d * d + 2 * cab + 2 * d * (sa + sb)
    p = F.sqrt(F.greatest(p2, F.lit(0.0)))
    t = F.atan2(-ca - cb, d + sa + sb) - F.atan2(F.lit(-2.0), p)
    words["LSR"] = F.when(p2 >= 0, full_turn(t - a) + p + full_turn(t - b))
    p2 = -2 + d * d + 2 * cab - 2 * d * (sa + sb)
    p = F.sqrt(F.greatest(p2, F.lit(0.0)))
    t = F.atan2(ca + cb, d - sa - sb) - F.atan2(F.lit(2.0), p)
    words["RSL"] = F.when(p2 >= 0, full_turn(a - t) + p + full_turn(b - t))
    c = (6 - d * d + 2 * cab + 2 * d * (sa - sb)) / 8
    p = full_turn(TAU - F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))))
    t = full_turn(a - F.atan2(ca - cb, d - sa + sb) + p / 2)
    words["RLR"] = _arc(c, t + p + full_turn(a - b - t + p))
    c = (6 - d * d + 2 * cab + 2 * d * (sb - sa)) / 8
    p = full_turn(TAU - F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))))
    t = full_turn(-a + F.atan2(cb - ca, d + sa - sb) + p / 2)  # the mirror image of the word above
    words["LRL"] = _arc(c, t + p + full_turn(b - a - t + p))
    return {k: v * radius for k, v in words.items()}


def dubins_length(dx: Column, dy: Column, start: Column, end: Column, radius: Column) -> Column:
    return F.least(*dubins_words(dx, dy, start, end, radius).values())


def objective_cost(value: Column, direction: Column) -> Column:
    """An objective as a cost: a value to maximise changes its sign; a direction other than "minimize" or "maximize" is an error."""
    other = F.raise_error(F.concat(F.lit("unknown direction "), direction)).cast("double")
    return F.when(direction == "minimize", value).when(direction == "maximize", -value).otherwise(other)
