"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's words (runs of letters, lower-cased) give character 2- to 4-grams with word ends marked, hashed into
buckets in vectorised numpy; the mean of the buckets' vectors goes through a linear softmax. Both are trained by stochastic gradient
descent in numpy. A temperature is fitted on a part left out of training; the rejection threshold is the
calibrated score below which only ``reject_share`` of that part's right predictions lie, and at most 0.5. A text most
of whose subwords were never seen in training, such as one in another script, is rejected, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import by_class

TRAIN_ROWS, BUCKETS, DIMENSIONS, UNKNOWN = 2_000, 1 << 16, 16, "und"
#: Code points of a text that are looked at together; a longer text is cut at a blank.
_PART = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _PART:
        cut = text.rfind(" ", at, at + _PART)
        cut = cut + 1 if cut > at else at + _PART
        yield text[at:cut]
        at = cut
    yield text[at:]


def grams(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of a text's subwords, with repeats, for each part of a long text; none if it has no letter."""
    for part in _parts(text or ""):
        codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        if not letter.any():
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # what follows a word becomes its end mark, 0
        c = np.concatenate([[0], np.where(letter, codes, 0)[keep], [0]]).astype(np.uint32)
        if not c[-2]:
            c = c[:-1]
        inner = c != 0
        step = np.uint32(0x9E3779B1)
        h2 = c[:-1] * step + c[1:]
        h3 = h2[:-1] * step + c[2:]
        h4 = h3[:-1] * step + c[3:] if len(c) > 3 else c[:0]
        found = np.concatenate([h2 + np.uint32(2), h3[inner[1:-1]] + np.uint32(3), h4[inner[1:-2] & inner[2:-1]] + np.uint32(4)])
        found ^= found >> np.uint32(15)
        found *= np.uint32(0x2C1B3C6D)
        found ^= found >> np.uint32(12)
        yield found % np.uint32(buckets)


@dataclass(frozen=True)
class Model:
    """``table``: each bucket's contribution to each language's logit; ``seen``: whether training had it; scores
    below ``threshold`` and shares of seen subwords below ``least_seen`` are rejected."""

    languages: tuple[str, ...]
    table: np.ndarray
    intercept: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    least_seen: float = 0.5

    def predictor(self):
        """A function from a text to (language, calibrated score, accepted)."""
        table = self.table

        def predict(text: str | None) -> tuple[str, float, bool]:
            total, count, known = np.zeros(len(self.languages)), 0, 0
            for found in grams(text, len(table)):
                total += table[found].sum(0)
                count += len(found)
                known += int(self.seen[found].sum())
            if not count or not self.languages:
                return UNKNOWN, 0.0, False
            logits = (total / count + self.intercept) / self.temperature
            e = np.exp(logits - logits.max())
            best = int(e.argmax())
            score = float(e[best] / e.sum())
            return self.languages[best], score, score >= self.threshold and known >= self.least_seen * count

        return predict


def _shares(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets of a text's subwords and the share of each; nothing for a text without letters."""
    found = list(grams(text, buckets))
    if not found:
        return None
    places, times = np.unique(np.concatenate(found), return_counts=True)
    return places.astype(np.int64), (times / times.sum()).astype(np.float32)


def fit(texts: list[str | None], languages: list[str], *, buckets: int = BUCKETS, **options) -> Model:
    """Fits on texts in memory; every tenth is left out for calibration. Texts without letters are not used."""
    shares = [(s, v) for s, v in zip((_shares(t, buckets) for t in texts), languages) if s is not None]
    return _descend([s for s, _ in shares], [v for _, v in shares], buckets=buckets, **options)


def _descend(x: list, y: list[str], *, buckets: int, dimensions: int = DIMENSIONS, epochs: int = 4, rate: float = 0.3, reject_share: float = 0.001, seed: int = 3) -> Model:
    known = tuple(sorted(set(y)))
    if not known:
        return Model((), np.zeros((buckets, 0)), np.zeros(0), np.zeros(buckets, bool))
    target = np.array([known.index(v) for v in y])
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 0.1, (buckets, dimensions)).astype(np.float32)
    seen = np.zeros(buckets, bool)
    out, bias = np.zeros((dimensions, len(known)), np.float32), np.zeros(len(known), np.float32)
    left_out = np.arange(len(x)) % 10 == 9 if len(x) >= 50 else np.zeros(len(x), bool)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in r.permutation(np.flatnonzero(~left_out)):
            places, share = x[k]
            hidden = share @ vectors[places]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[k]] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            vectors[places] -= step * share[:, None] * back * len(places) ** 0.5
            seen[places] = True
    vectors[~seen] = 0  # a subword that was never seen says nothing
    table = (vectors @ out).astype(np.float64)
    check = np.flatnonzero(left_out) if left_out.any() else np.arange(len(x))
    logits = np.stack([x[k][1] @ table[x[k][0]] + bias for k in check])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    def loss(t: float) -> float:
        return -np.log(np.maximum(probabilities(t)[np.arange(len(check)), target[check]], 1e-12)).mean()

    temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss)
    p = probabilities(temperature)
    right = np.sort(p.max(1)[p.argmax(1) == target[check]])
    threshold = min(0.5, float(np.quantile(right, reject_share))) if len(right) else 0.0
    return Model(known, table, bias.astype(np.float64), seen, temperature, threshold)


def train(docs: DataFrame, *, train_rows: int = TRAIN_ROWS, folds: int = 4, held: int = 2, buckets: int = BUCKETS, **options) -> Model:
    """Fits on about ``train_rows`` documents (a documented bound) with a language, none of the held-out fold.

    Every language has its share of the sample, or a like number of rows if that is more. Texts are turned into shares of
    buckets where they lie; the driver gets these. A document's fold is crc32(doc_id as text) mod ``folds``; rows with a null
    id, language or text aren't used, repeated rows are each used, an empty table gives a model of no languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_shares(t.as_py(), buckets) for t in batch.column(2)]
            keep = pa.array([f is not None for f in found])
            places, shares = ([f[k] for f in found if f is not None] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(places, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["doc_id", "lang", "places", "shares"])

    chosen = by_class(usable, "doc_id", "lang", train_rows).select("doc_id", "lang", "text")
    shaped = chosen.mapInArrow(shape, "doc_id long, lang string, places array<int>, shares array<float>").toArrow().combine_chunks()
    order = sorted(range(shaped.num_rows), key=lambda i: (shaped["doc_id"][i].as_py(), shaped["lang"][i].as_py(), shaped["places"][i].values.to_numpy().tobytes()))
    x = [(shaped["places"][i].values.to_numpy().astype(np.int64), shaped["shares"][i].values.to_numpy()) for i in order]
    return _descend(x, [shaped["lang"][i].as_py() for i in order], buckets=buckets, **options)


def predictions(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, lang_pred, score, accepted)`` of each row's whole text.

    A null text and one without letters get ``und``, score 0, and are not accepted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.predictor()
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is accepted, all columns as they were."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.predictor()
        place = names.index("text")
        for batch in batches:
            yield batch.filter(pa.array([predict(t.as_py())[2] for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, schema)
