"""Every registered query over the driver's smallest tables: against SQL where there is some, else against brute force."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import bpe, html_extract, ngram_lm, queries
from furrow.llm.elias_fano import EliasFano

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def words(text):
    return [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in WORDS.findall(text or "")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    df, other = queries.QUERIES[name](spark, DATA), c.execute(queries.SQL[name])
    names = [d[0] for d in other.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert sorted(tuple(repr(r[k]) for k in order) for r in df.collect()) == sorted(tuple(repr(r[names.index(k)]) for k in order) for r in other.fetchall())


def test_fingerprints(spark, documents):
    def shingles(text):
        w = words(text)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, DATA).collect()}
    ids = sorted(documents)
    prints = {}
    for k, i in enumerate(ids):
        text, after = documents[i].text or "", documents[ids[(k + 1) % len(ids)]].text or ""
        half = len(text) // 2
        other = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        for near, x, y in ((r.near_edited, text, other), (r.near_next, text, after)):
            j = jaccard(shingles(x), shingles(y))
            assert abs(near - j) <= 5 * math.sqrt(max(j * (1 - j), 1e-6) / 128) + 1 / 64
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint


def test_html(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op5_html_extract(spark, DATA).collect()
    assert len(got) == len(pages) and all(r.text == html_extract.extract(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_bpe(spark, documents):
    import tiktoken

    path, pattern = queries.vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in queries.op7_bpe(spark, DATA).collect():
        text = documents[r.doc_id].text or ""
        ids = theirs.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def brute_scores(rows, held, mu):
    token = lambda t: [*words(t), None]
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            one.update(token(t))
            two.update(zip([None, *token(t)], token(t)))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + v + 1)
    for i, t in rows:
        w = token(t)
        base = sum(math.log10(p(y)) for y in w)
        yield i, len(w), sum(one[y] > 0 for y in w), n, base, sum(math.log10((two[h, y] + mu * p(y)) / (one[h] + mu)) for h, y in zip([None, *w], w))


def hashed(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_language_model(spark, documents):
    got = {r.doc_id: r for r in queries.op8_ngram_lm(spark, DATA).collect()}
    assert len(got) == len(documents)
    for i, n, known, total, base, score in brute_scores([(i, r.text) for i, r in documents.items()], hashed, ngram_lm.MU):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (hashed(i), n, known, total)
        assert r.base_score == pytest.approx(base) and abs(r.score - score) < 1e-4 * n


def test_a_hot_context_over_several_files(spark):
    rows = [(k, " ".join(f"the w{(k * 31 + j * 7) % 97}" for j in range(40))) for k in range(60)] + [(900, None), (901, "the"), (902, "new THE w1")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r.id: r for r in ngram_lm.fold_scores(d, held, words_a_file=16, pairs_a_file=200).collect()}
    model = ngram_lm.train(d.where(~held), words_a_file=16, pairs_a_file=200)
    assert model.files > 8 and sum(model.folder.has(f) for f in model.pair_files) > 8
    apart = {r.id: r for r in ngram_lm.scores(d, model, held).collect()}
    for i, n, known, total, base, score in brute_scores(rows, hashed, model.mu):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total) and abs(got[i].score - score) < 1e-4 * n
        assert apart[i].score == pytest.approx(got[i].score) and apart[i].base_score == pytest.approx(base)
    model.remove()
    assert not model.folder.has("words-0")


def test_pointers_bound_the_search(tmp_path):
    """Successors are shifted by what comes before them, so only the bounds of a context tell whose a value is."""
    from furrow.llm.files import Folder

    folder = Folder(str(tmp_path))
    c, w = np.array([0, 0, 1, 1, 4]), np.array([2, 5, 0, 3, 5])
    folder.put("pairs-0", ngram_lm._pairs_level(c, w, np.array([1, 2, 3, 4, 5]), np.array([9, 9, 9, 9, 9]), 64.0))
    model = ngram_lm.Model(folder, 20, 6, 0)
    successor = ngram_lm.Level(folder, "pairs-0").sequence("successor").decode().tolist()
    assert successor == [2, 5, 5, 8, 13]  # 5 is a successor of context 0, and word 0 after context 1
    there = {(a, b) for a, b in zip(c.tolist(), w.tolist())}
    every = [(a, b) for a in range(6) for b in range(6)]
    for asked in (every, every[:1], every[11:12]):
        codes, step = model.answer_pairs(0, np.array([a for a, _ in asked]), np.array([b for _, b in asked]))
        assert [int(x) != 65535 for x in codes] == [p in there for p in asked]
    codes, step = model.answer_pairs(0, c, w)
    assert np.allclose(10.0 ** (-codes.astype(float) * step), np.array([1, 2, 3, 4, 5]) / 73, rtol=1e-3)


def test_bounded_searches():
    r = np.random.default_rng(5)
    for n, top in ((3000, 1 << 40), (3000, 5000), (1, 9), (2000, 10)):
        v = np.sort(r.integers(0, top, n).astype(np.uint64))
        head, arrays = EliasFano.arrays(v)
        e = EliasFano(head["n"], head["bits"], **arrays)
        for few in (5, 2000):  # by random access, and decoded first
            lo = r.integers(0, n + 1, few)
            hi = np.minimum(n, lo + r.integers(0, 50, few))
            x = np.where(r.random(few) < 0.5, v[np.minimum(lo, n - 1)], r.integers(0, top, few).astype(np.uint64))
            want = [next((k for k in range(a, b) if v[k] == y), -1) for a, b, y in zip(lo, hi, x)]
            assert e.within(x, lo, hi).tolist() == want


def test_mixing(spark, documents):
    sizes = {i: len(words(r.text)) for i, r in documents.items()}
    source = Counter()
    for i, r in documents.items():
        source[r.source] += sizes[i]
    order = sorted((s for s in source if s is not None)) + [None] * (None in source)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, rest = {}, set(order), float(sum(source.values()))
    while left:
        shares = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if shares[s] > 3 * source[s] + 1e-9}
        if not full:
            target |= shares
            break
        for s in full:
            target[s] = 3.0 * source[s]
            rest -= target[s]
        left -= full
    taken = Counter()
    for r in queries.op10_mixing(spark, DATA).collect():
        s = documents[r.doc_id].source
        assert r["size"] == sizes[r.doc_id] and r.source_size == source[s] and r.target == pytest.approx(target[s])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        taken[s] += r.taken
    longest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in order)


def test_archives_round_trip(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op9_warc(spark, DATA).collect()}
    for p in pages:
        raw = (p.html or "").encode()
        assert (got[p.page_id].payload_bytes, got[p.page_id].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
