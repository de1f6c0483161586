"""Toxicity: a logistic classifier over word stems, regularised by counterfactuals.

Features are the words of a text and their prefixes of 3 to 6 letters, present or not. A feature is used if its
share among toxic texts, at least three of them, differs from that among others by ``least_z`` standard errors; the words
for groups of people that training texts hold are always used. Weights are fitted by AdaGrad on the logistic loss plus
``penalty`` times the squared change of a sentence's logit between a labelled sentence and its counterfactuals: a
sentence that names groups has each name swapped for another of its kind, or taken out; of a text that names none
one sentence is given a name, and that name is swapped. So a mention of a group alone moves the score as little as
possible, although a name may share stems with insults, as "transgender" does with "trash".
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import by_class
from .spark import settle

#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"), ("immigrant", "refugee", "native"), ("disabled", "deaf", "blind"), ("elderly", "young"),
)
TRAIN_ROWS, THRESHOLD, PENALTY = 6_000, 0.5, 1.0
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_ROOM = 300_000


def _names(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in range(3, min(6, len(word)) + 1))]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Model:
    """``features`` to a place in ``weights``; the last weight is the intercept."""

    features: dict[str, int]
    weights: np.ndarray

    def scorer(self):
        """A function from a text to its score; it keeps a bounded cache of words."""
        features, weights = self.features, self.weights
        cache: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in words_of(text):
                hit = cache.get(word)
                if hit is None:
                    if len(cache) >= _ROOM:
                        cache.clear()
                    cache[word] = hit = tuple(features[n] for n in _names(word) if n in features)
                found.update(hit)
            return _sigmoid(float(weights[-1] + sum(weights[i] for i in sorted(found))))

        return score


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def counterfactuals(words: set[str], identities=IDENTITIES) -> list[set[str]]:
    """The words with their identity terms swapped, and with them removed; none if there are no such terms."""
    swap = {t: group[(i + 1) % len(group)] for group in identities for i, t in enumerate(group)}
    if not any(w in swap for w in words):
        return []
    return [{swap.get(w, w) for w in words}, {w for w in words if w not in swap}]


def sentence_pairs(text: str | None, identities=IDENTITIES) -> Iterator[tuple[set[str], set[str]]]:
    """The words of labelled sentences beside those of their counterfactuals, as the module says; none for a text without
    words. Which sentence is given which name depends on the text alone."""
    if not text:
        return
    swap = {t: group[(i + 1) % len(group)] for group in identities for i, t in enumerate(group)}
    sentences = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    named = False
    for w in sentences:
        for other in counterfactuals(w, identities):
            named = True
            yield w, other
    if sentences and swap and not named:
        names, seed = sorted(swap), zlib.crc32(text.encode("utf-8", "surrogatepass"))
        w, name = sentences[seed % len(sentences)], names[seed // 7 % len(names)]
        given, swapped = w | {name}, w | {swap[name]}
        yield w, given
        yield given, swapped


def _places(words: Iterable[str], features: dict[str, int]) -> set[int]:
    return {features[n] for w in words for n in _names(w) if n in features}


def _changes(text: str | None, features: dict[str, int], identities) -> list[list[int]]:
    """The distinct changes of features by the counterfactuals: k + 1 for one that goes, -k - 1 for one that comes."""
    found = set()
    for w, other in sentence_pairs(text, identities):
        before, after = _places(w, features), _places(other, features)
        found.add(tuple(sorted([k + 1 for k in before - after] + [-k - 1 for k in after - before])))
    return [list(c) for c in sorted(found) if c]


def _identity_names(identities) -> list[str]:
    return sorted({t + "$" for group in identities for t in group})


def _descend(places: list, toxic: list[int], changes: list, width: int, penalty: float, epochs: int, seed: int) -> np.ndarray:
    """The weights, the intercept last, of rows of features and of signed changes."""
    y = np.array(toxic, np.float32)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    x = np.zeros((len(y), width), np.uint8)
    x[:, -1] = 1
    for k, p in enumerate(places):
        x[k, list(p)] = 1
    change = np.zeros((len(changes), width), np.float32)
    for k, c in enumerate(changes):
        c = np.array(c, np.int64)
        change[k, np.abs(c) - 1] = np.sign(c)
    w = np.zeros(width, np.float64)
    w[-1] = math.log((n1 + 0.5) / (n0 + 0.5))
    gathered = np.full(width, 1e-6)
    r = np.random.default_rng(seed)
    weight = np.where(y == 1, min(3.0, (n0 / n1) ** 0.5), 1.0)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), 256):
            k = order[at : at + 256]
            part = x[k].astype(np.float64)
            off = (1 / (1 + np.exp(-np.clip(part @ w, -30, 30))) - y[k]) * weight[k]
            g = part.T @ off / len(k) + 1e-4 * w
            g[-1] -= 1e-4 * w[-1]
            if len(change) and penalty:
                c = change[r.integers(0, len(change), min(256, len(change)))]
                g += 2 * penalty * c.T @ (c @ w) / len(c)
            gathered += g * g
            w -= 0.3 * g / np.sqrt(gathered)
    return w


def _base_rate(n1: int, n0: int) -> Model:
    prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else math.log(0.5 / 9.5)
    return Model({}, np.array([min(prior, -2.0) if not n1 else prior]))


def fit(texts: list[str | None], toxic: list[int], *, identities=IDENTITIES, penalty: float = PENALTY, least_z: float = 4.0, most_features: int = 2048, epochs: int = 40, seed: int = 5) -> Model:
    """Fits on texts in memory. With no text, or none of either kind, every score is the smoothed base rate. Of more than
    ``most_features`` features those that differ most are used."""
    n1 = sum(map(bool, toxic))
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return _base_rate(n1, n0)
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for text, label in zip(texts, toxic):
        seen[bool(label)].update({n for w in words_of(text) for n in _names(w)})
    z = {n: _z(a, seen[0][n], n1, n0) for n, a in seen[1].items() if a >= 3}
    chosen = sorted((n for n in z if abs(z[n]) >= least_z), key=lambda n: (-abs(z[n]), n))[:most_features]
    chosen += [n for n in _identity_names(identities) if n in seen[0] or n in seen[1]]
    features = {n: i for i, n in enumerate(sorted(set(chosen)))}
    places = [_places(words_of(t), features) for t in texts]
    changes = [c for t in texts for c in _changes(t, features, identities)]
    return Model(features, _descend(places, [int(bool(v)) for v in toxic], changes, len(features) + 1, penalty, epochs, seed))


def _z(a: int, b: int, n1: int, n0: int) -> float:
    p = (a + b) / (n1 + n0)
    return (a / n1 - b / n0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, folds: int = 5, held: int = 0, identities=IDENTITIES, penalty: float = PENALTY, least_z: float = 4.0, most_features: int = 2048, epochs: int = 40, seed: int = 5) -> Model:
    """Fits as :func:`fit` does on about ``train_rows`` labelled documents (a documented bound), none of the held-out fold.

    Texts are counted and turned into features where they lie; the driver gets the features chosen and, for each
    document of the sample, the places of its features. A document's fold is crc32(doc_id as text) mod ``folds``. Rows
    with a null id or label are not used; of several labels of a document the largest counts, and each row that
    repeats its id is used. Where one of the labels is sampled more densely, the intercept is set back. Empty tables give the
    base rate. Columns are read by name, so others don't matter.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna()
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = by_class(usable, "doc_id", "toxic", train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = settle(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "rate"))
    sizes = {r.toxic: (r.n, r.rate) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()}
    n1, n0 = (sizes.get(k, (0, 1.0))[0] for k in (1, 0))
    if not n1 or not n0:
        return _base_rate(n1, n0)
    always = _identity_names(identities)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                seen: tuple[Counter, Counter] = Counter(), Counter()
                for text, label in zip(batch.column(0).slice(at, 256), batch.column(1).slice(at, 256).to_pylist()):
                    seen[label].update({n for w in words_of(text.as_py()) for n in _names(w)})
                names = list(seen[0] | seen[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][n] for n in names], pa.int64()), pa.array([seen[0][n] for n in names], pa.int64())], ["name", "a", "b"])

    counts = sample.select("text", "toxic").mapInArrow(count, "name string, a long, b long").groupBy("name").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = settle(counts.where((F.col("a") >= 3) | F.col("name").isin(always)))
    p = (F.col("a") + F.col("b")) / (n1 + n0)
    z = F.abs((F.col("a") / n1 - F.col("b") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0)))
    top = counts.where("a >= 3").select("name", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "name").limit(most_features)
    names = sorted({r["name"] for r in top.collect()} | {r["name"] for r in counts.where(F.col("name").isin(always)).collect()})
    features = {n: i for i, n in enumerate(names)}

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            places = [sorted(_places(words_of(t), features)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(places, pa.list_(pa.int32())), pa.array([_changes(t, features, identities) for t in texts], pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "toxic", "places", "changes"],
            )

    shaped = sorted(tuple(r) for r in sample.select("text", "doc_id", "toxic").mapInArrow(shape, "doc_id long, toxic int, places array<int>, changes array<array<int>>").collect())
    weights = _descend([r[2] for r in shaped], [r[1] for r in shaped], [c for r in shaped for c in r[3]], len(features) + 1, penalty, epochs, seed)
    weights[-1] -= math.log(sizes[1][1] / sizes[0][1])
    return Model(features, weights)


def scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, score)`` of each row's whole text; null and empty texts get the score of a text without features. Each of
    repeated rows is scored, a null id stays null, an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, all columns as they were; null texts stay if a text without
    features does."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        place = names.index("text")
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < threshold for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, schema)
