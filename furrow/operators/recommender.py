"""Configuration choice: extremely randomised trees that predict a configuration's regret at each preference.

Own trees in numpy, one model for each configuration; they follow the published method (a random cut point for each
feature, the best by variance, at least two rows a leaf), not any library's random numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The reference's protocol.
TREES, LEAF, SEED = 192, 2, 20260822
#: Distinct rows of all trees that are grown together, at most, so that a level stays in a core's cache.
ROWS = 1 << 15


@dataclass
class Forest:
    """The nodes of several trees; the first ``roots`` nodes are their roots."""

    roots: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The sum of the trees' predictions; rows walk down all trees side by side."""
        n = len(x)
        at = np.repeat(np.arange(self.roots), n)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            inner = at[live]
            goes = x[live % n, self.feature[inner]] <= self.cut[inner]
            at[live] = inner = np.where(goes, self.left[inner], self.right[inner])
            live = live[self.feature[inner] >= 0]
        out = np.zeros((n, self.value.shape[1]))
        for tree in at.reshape(self.roots, n):
            out += self.value[tree]
        return out


#: A node of more rows is multiplied alone; smaller ones are many at a time, in stacks of about equal sizes and this many rows.
ALONE, STACK = 192, 1 << 14
_STEPS = np.array([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, ALONE])


def _kinds(y: np.ndarray) -> np.ndarray:
    return np.unique(y, axis=0, return_inverse=True)[1].reshape(-1)


def _ordered(a: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, whose least and largest are found faster; and such integers as doubles."""
    back = a.dtype == np.int64
    i = a if back else (a + 0.0).view(np.int64)  # no -0
    i = i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return i.view(np.float64) if back else i


def _sums_beyond(beyond: np.ndarray, y: np.ndarray, rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each node (its first place and number of places in ``rows``) and feature the sum of ``y`` over its rows that are
    ``beyond``."""
    out = np.empty((len(start), beyond.shape[1], y.shape[1]))
    for k in np.flatnonzero(size > ALONE):
        part = slice(start[k], start[k] + size[k])
        out[k] = beyond[part].T.astype(float) @ y.take(rows[part], axis=0)
    small = np.flatnonzero(size <= ALONE)
    step = np.searchsorted(_STEPS, size[small])
    for s in np.unique(step):
        nodes, wide = small[step == s], _STEPS[s]
        for k in range(0, len(nodes), at_once := max(1, STACK // int(wide))):
            of = nodes[k : k + at_once]
            at = start[of, None] + np.arange(wide)
            inside = np.arange(wide) < size[of, None]
            at = np.minimum(at, len(rows) - 1)
            out[of] = np.matmul((beyond.take(at, axis=0) & inside[..., None]).transpose(0, 2, 1).astype(float), y.take(rows.take(at), axis=0))
    return out


def grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, trees: int, leaf: int = LEAF, weight: np.ndarray | None = None, kind: np.ndarray | None = None) -> Forest:
    """Trees over all rows of several outputs, a level of all trees at a time; each node tries a cut of each feature.
    No leaf has fewer than ``leaf`` rows; nodes of equal rows or equal outputs are leaves. A row of weight n stands for n equal
    ones; ``kind`` numbers its outputs, equal ones alike. Among cuts that are equally good, but for rounding, the first
    feature's is taken."""
    n, weight = len(x), np.ones(len(x)) if weight is None else np.asarray(weight, float)
    mean = (y * weight[:, None]).sum(0) / weight.sum()
    kind = _kinds(y) if kind is None else kind
    y = np.ascontiguousarray(np.column_stack([(y - mean) * weight[:, None], weight]))  # rows in one piece, as they are taken
    used = np.flatnonzero(x.min(0) < x.max(0))
    draws, x = x.shape[1], _ordered(np.ascontiguousarray(x[:, used], float))
    rows, ids = np.tile(np.arange(n), trees), np.arange(trees)
    start, total = ids * n, np.repeat(y.sum(0)[None], trees, 0)
    levels, count = [], trees

    def close(nodes: np.ndarray, rows: np.ndarray, size: np.ndarray) -> None:
        """Nodes that become leaves get their rows' mean, summed anew."""
        if len(nodes):
            sums = np.add.reduceat(y.take(rows, axis=0), np.cumsum(size) - size)
            levels[-1][3][nodes] = sums[:, :-1] / sums[:, -1:] + mean

    while len(ids):
        size = np.diff(start, append=len(rows))
        chance = r.random((draws, len(ids)))[used].T  # one for each feature and node, those that are alike everywhere too
        kinds = kind[rows]
        open_ = (np.minimum.reduceat(kinds, start) < np.maximum.reduceat(kinds, start)) & (total[:, -1] >= 2 * leaf) & (len(used) > 0)
        feature, cut, child = np.full(len(ids), -1), np.zeros(len(ids)), np.full(len(ids), -1)
        levels.append((feature, cut, child, np.zeros((len(ids), y.shape[1] - 1))))
        stay = np.repeat(open_, size)
        close(np.flatnonzero(~open_), rows[~stay], size[~open_])
        # from here on only nodes that may be split
        best = np.flatnonzero(open_)
        if not len(best):
            break
        rows, of, told = rows[stay], total[best], size[best]
        start = np.cumsum(told) - told
        v = x.take(rows, axis=0)
        low, high = _ordered(np.minimum.reduceat(v, start)), _ordered(np.maximum.reduceat(v, start))
        cuts = np.ascontiguousarray(low + (high - low) * chance[best])
        beyond = np.greater(v, np.repeat(_ordered(cuts), told, axis=0), order="C")
        first, split = np.zeros(len(best), int), np.zeros(len(best), bool)
        halves = np.zeros((len(best), 2, y.shape[1]))
        # a cut of two rows parts them or doesn't; all that do are equally good
        two = np.flatnonzero(told == 2)
        one, other = start[two], start[two] + 1
        apart = beyond[one] != beyond[other]
        first[two] = apart.argmax(1)
        one, other = (np.where(beyond[one, first[two]], b, a) for a, b in ((one, other), (other, one)))
        halves[two, 0], halves[two, 1] = y.take(rows[one], axis=0), y.take(rows[other], axis=0)
        split[two] = apart.any(1) & (halves[two, :, -1] >= leaf).all(1)
        more = np.flatnonzero(told != 2)
        if len(more):
            part = _sums_beyond(beyond, y, rows, start[more], told[more])
            many, rest = part[..., -1], of[more, None, :] - part
            good = (many >= leaf) & (rest[..., -1] >= leaf)
            square = lambda a: np.einsum("nfo,nfo->nf", a[..., :-1], a[..., :-1])
            gain = np.where(good, square(part) / np.maximum(many, 1) + square(rest) / np.maximum(rest[..., -1], 1), -1.0)
            first[more] = (gain >= gain.max(1, keepdims=True) * (1 - 1e-12)).argmax(1)
            each = np.arange(len(more)), first[more]
            split[more] = good[each]
            halves[more, 0], halves[more, 1] = rest[each], part[each]
        each = np.arange(len(best))
        feature[best[split]], cut[best[split]] = used[first[split]], cuts[each, first][split]
        child[best[split]] = count + 2 * np.arange(split.sum())
        # rows of a node that is split go to its children, in order
        stay = np.repeat(split, told)
        close(best[~split], rows[~stay], told[~split])
        right = beyond[np.arange(len(rows)), np.repeat(first, told)][stay]
        rows, told = rows[stay], told[split]
        start = np.cumsum(told) - told
        over = np.add.reduceat(right, start, dtype=np.int64) if len(start) else told
        before = np.cumsum(right) - right  # how many went right before
        before -= np.repeat(before[start], told)
        place = np.arange(len(rows)) - np.repeat(start, told)
        to = np.repeat(start, told) + np.where(right, np.repeat(told - over, told) + before, place - before)
        moved = np.empty_like(rows)
        moved[to] = rows
        rows = moved
        start = np.column_stack([start, start + told - over]).reshape(-1)
        total = halves[split].reshape(-1, y.shape[1])
        ids = np.arange(count, count + len(start))
        count += len(ids)
    feature, cut, child, value = (np.concatenate(c) for c in zip(*levels))
    return Forest(trees, feature, cut, child, child + 1, value)


def _order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.lexsort([*y.T[::-1], *x.T[::-1]])


def _news(x: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(1)
    return new


def _merged(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct row of ``x``, of rows in the order of :func:`_order`, with the mean of its outputs, their number, and
    whether they differ. No cut tells rows of equal features apart, so trees need no more of them."""
    new = _news(x)
    start = np.flatnonzero(new)
    many, mixed = np.add.reduceat(weight, start), np.logical_or.reduceat(_news(y) & ~new, start)
    mean = np.where(mixed[:, None], np.add.reduceat(y * weight[:, None], start) / many[:, None], y[start])
    return x[start], mean, many, mixed


def _predicted(x, y, weight, mixed, asked, trees: int, seed: int, leaf: int) -> np.ndarray:
    """The mean of the trees' predictions, none below 0, for rows as :func:`_merged` gives them."""
    r = np.random.default_rng(seed)
    kind = _kinds(y)
    kind[mixed] = kind.max() + 1 + np.arange(mixed.sum())  # outputs that differ are like no others
    at_once = max(1, ROWS // len(x))
    total = sum(grow(x, y, r, min(at_once, trees - k), leaf, weight, kind).predict(asked) for k in range(0, trees, at_once))
    return np.maximum(0.0, total / trees)


def fit_predict(train_x, train_y, test_x, trees: int = TREES, seed: int = SEED, leaf: int = LEAF, weight: np.ndarray | None = None) -> np.ndarray:
    """Mean of the trees' predictions, none below 0. Rows of weight n stand for n equal ones; rows of equal features are learnt
    from together, and predicted once. The order of rows doesn't matter."""
    given = np.ones(len(train_x)) if weight is None else np.asarray(weight, float)
    x, y = np.asarray(train_x, float), np.asarray(train_y, float)
    order = _order(x, y)
    asked, back = np.unique(test_x, axis=0, return_inverse=True)
    return _predicted(*_merged(x[order], y[order], given[order]), asked, trees, seed, leaf)[back.reshape(-1)]


def _places(spark: SparkSession, n: int) -> list[int]:
    """Numbers of which each goes to another one of n partitions by hash."""
    limit = 64 * n
    while True:
        part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        found = spark.range(limit).groupBy(part.alias("part")).agg(F.min(F.col("id").cast("int")).alias("least")).collect()
        if len(found) == n:
            return sorted(r.least for r in found)
        limit *= 4


#: Shares of a configuration's rows that are merged each in a task.
SHARES = 16


def cross_predict(table: DataFrame, features: list[str], outputs: list[str], trees: int = TREES, seed: int = SEED, held: list[int] | None = None) -> DataFrame:
    """``(config_id, instance_id, fold, predicted...)``: each configuration's model of the other folds' applicable rows
    predicts a fold's rows; ``table`` has the flag ``applicable``, and a choice is made among the applicable ones. Rows
    without all outputs are predicted, not learnt from; a null feature counts as 0. ``held`` names the folds to predict.

    A configuration's rows of equal features, which no tree can tell apart, meet in one of ``SHARES`` tasks and go on as one
    row a model; a model's task gets those, and gives a prediction for each distinct row of its fold, not for each row."""
    plain = [(F.col(c) + 0.0).alias(c) for c in features]  # -0 becomes 0
    kept = table.fillna(0.0, features).select("config_id", "instance_id", F.col("fold").cast("long").alias("fold"), "applicable", *plain, *outputs)
    told = F.col("applicable")
    for o in outputs:
        told &= F.col(o).isNotNull() & ~F.isnan(o)
    named = [(r.config_id, r.fold) for r in kept.select("config_id", "fold").where("config_id IS NOT NULL AND fold IS NOT NULL").distinct().collect()]  # one a model
    models = sorted(m for m in named if held is None or m[1] in held)
    if not models:
        return kept.select("config_id", "instance_id", "fold", *outputs).limit(0)
    place = dict(zip(models, _places(table.sparkSession, len(models))))
    doubles = lambda names: ", ".join(f"{c} double" for c in names)
    columns = ["place", "asked", "weight", "mixed", *features, *outputs]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[features].to_numpy(float), rows[outputs].to_numpy(float)
        order, config = _order(x, y), rows["config_id"].iloc[0]
        x, y, fold, told = x[order], y[order], rows["fold"].to_numpy()[order], rows["told"].to_numpy(bool)[order]
        new = _news(x)
        at, same, parts = x[new], np.cumsum(new) - 1, []
        for k in (m[1] for m in models if m[0] == config):
            learns = told & (fold != k)
            weight, mean, mixed, asked = np.zeros(len(at)), np.zeros((len(at), len(outputs))), np.zeros(len(at), bool), np.zeros(len(at), bool)
            asked[same[fold == k]] = True
            if learns.any():
                of = np.unique(same[learns])
                _, mean[of], weight[of], mixed[of] = _merged(x[learns], y[learns], np.ones(learns.sum()))
            part = pd.DataFrame(np.column_stack([at, mean]), columns=[*features, *outputs]).assign(place=place[config, k], asked=asked, weight=weight, mixed=mixed)
            parts.append(part.loc[asked | (weight > 0), columns])
        return pd.concat(parts, ignore_index=True)

    of_place = {v: k for k, v in place.items()}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(features)
        train, test = rows[rows["weight"] > 0], rows[rows["asked"]]
        if train["weight"].sum() < 2 or not len(test):
            return pd.DataFrame(columns=["config_id", "fold", *features, *outputs])
        x, y, asked = (d[c].to_numpy(float) for d, c in ((train, features), (train, outputs), (test, features)))
        p = _predicted(x, y, train["weight"].to_numpy(float), train["mixed"].to_numpy(bool), asked, trees, seed, LEAF)
        config, fold = of_place[rows["place"].iloc[0]]
        return pd.DataFrame(np.column_stack([asked, p]), columns=[*features, *outputs]).assign(config_id=config, fold=fold)[["config_id", "fold", *features, *outputs]]

    rows = kept.where(F.col("config_id").isin(*{m[0] for m in models})).select("config_id", "fold", F.coalesce(told, F.lit(False)).alias("told"), *features, *outputs)
    shared = rows.groupBy("config_id", F.pmod(F.xxhash64(*features), F.lit(SHARES)).alias("share"))
    merged = shared.applyInPandas(merge, f"place int, asked boolean, weight double, mixed boolean, {doubles([*features, *outputs])}")
    # a task for each model, since the rows are few and the work on them is not
    found = merged.repartition(len(models), "place").groupBy("place").applyInPandas(run, f"config_id string, fold long, {doubles([*features, *outputs])}")
    names = kept.select("config_id", "instance_id", "fold", *features)
    return names.join(found, ["config_id", "fold", *features]).select("config_id", "instance_id", "fold", *outputs)
