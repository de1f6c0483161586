"""Classifiers: what is fitted where the rows lie equals what is fitted in memory; counterfactuals act on the given tables."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import langid, queries, sampling, toxicity

SF = "/root/testdata/sf0.01"


def logit(p):
    return math.log(p / (1 - p))


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("toxic IS NOT NULL").select("doc_id", "text", "toxic").collect()
    return docs, labels, [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]


def test_trained_where_rows_lie_as_in_memory(labelled):
    docs, labels, rows = labelled
    model = toxicity.train(docs, labels)
    rows = sorted(rows, key=lambda r: r.doc_id)
    want = toxicity.fit([r.text for r in rows], [r.toxic for r in rows])
    assert model.features == want.features and np.allclose(model.weights, want.weights, atol=1e-9)


def test_counterfactuals_act_on_the_given_tables(labelled):
    docs, labels, _ = labelled
    free, tied = (toxicity.train(docs, labels, penalty=p) for p in (0.0, toxicity.PENALTY))
    plain = "The committee met on Monday, and a neighbour spoke of the"
    move = lambda m: max(abs(logit(m.scorer()(f"{plain} {t}")) - logit(m.scorer()(plain))) for g in toxicity.IDENTITIES for t in g)
    assert move(free) > 0.3 and move(tied) < 0.001  # "transgender" and an insult share a stem
    a, b = ({r.id: r.score for r in toxicity.scores(docs, m).collect()} for m in (free, tied))
    assert sum(abs(a[i] - b[i]) > 1e-4 for i in a) > 10
    held = [(r.doc_id, r.toxic) for r in labels.where("toxic IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    found = lambda s: [sum(s[i] >= 0.5 for i, t in held if t == k) for k in (0, 1)]
    assert found(b)[1] >= found(a)[1] and found(b)[0] <= found(a)[0]


def test_sentence_pairs():
    pairs = list(toxicity.sentence_pairs("Hello there. The women spoke!"))
    assert pairs == [({"the", "women", "spoke"}, {"the", "men", "spoke"}), ({"the", "women", "spoke"}, {"the", "spoke"})]
    (before, given), (again, swapped) = toxicity.sentence_pairs("Nobody is named here. Or here.")
    assert given - before and again == given and len(swapped - before) == 1 and swapped != given
    assert not list(toxicity.sentence_pairs(None)) and not list(toxicity.sentence_pairs(" 12 !"))


def test_samples_hold_rare_classes(spark):
    d = spark.range(10_000).select("id", F.when(F.col("id") % 1000 == 3, "rare").otherwise("common").alias("kind"))
    got = {r["kind"]: (r["n"], r["rate"]) for r in sampling.by_class(d, "id", "kind", 400).groupBy("kind").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()}
    assert got["rare"] == (10, 1.0) and 300 < got["common"][0] < 500 and got["common"][1] == pytest.approx(0.04)
    assert sampling.by_class(d.limit(0), "id", "kind", 400).count() == 0 and sampling.by_class(d, "id", "kind", 20_000).count() == 10_000


def test_languages_trained_where_rows_lie(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.lang, r.text) for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    model, want = langid.train(docs), langid.fit([r[2] for r in rows], [r[1] for r in rows])
    assert model.languages == want.languages and model.threshold == pytest.approx(want.threshold)
    got = {r.doc_id: r for r in queries.op3_langid(spark, SF).collect()}
    held = [(r.doc_id, r.lang, r.text) for r in docs.where("lang IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _, _ in held) and sum(got[i].lang_pred == lang for i, lang, _ in held) / len(held) > 0.97
    predict = model.predictor()
    assert all(got[i][2:4] == predict(t)[:2] for i, _, t in held[:50])


def test_toxicity_query(spark, labelled):
    docs, _, rows = labelled
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, SF).collect()}
    rows = sorted(rows, key=lambda r: r.doc_id)
    score = toxicity.fit([r.text for r in rows], [r.toxic for r in rows]).scorer()
    texts = docs.collect()
    assert len(got) == len(texts)
    for r in texts:
        assert got[r.doc_id].score == pytest.approx(score(r.text), abs=1e-6) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
