import base64
import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.llm import bpe, fingerprints, html_extract, langid, minmax_dedup, ngram_lm, toxicity, words
from furrow.llm.elias_fano import EliasFano

DOCS = "doc_id long, text string, id int, bucket string, lang string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x", "en") for i, t in rows], DOCS)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", " ", "\t", "\x0b", " ", "\x1c", "zz"]), max_size=40))
def test_words(parts):
    text = "".join(parts).encode()
    h, w = words.word_hashes(text), text.lower().split()
    assert len(h) == len(w) and len(set(h.tolist())) == len(set(w)) and len(set(zip(w, h.tolist()))) == len(set(w))


def test_long_words():
    a, b = b"x" * 5000 + b"y", b"x" * 5000 + b"z"
    h = words.word_hashes(a + b" " + b + b" " + a.upper())
    assert h[0] == h[2] != h[1]


def test_permutations_estimate():
    p = words.Permutations(256)
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    assert abs((p.lowest(x[:2000]) == p.lowest(x[1000:])).mean() - 1 / 3) < 0.1
    low, high = p.extremes(x)
    assert (low == p.lowest(x)).all() and (high >= low).all()


def test_edited_texts(spark):
    rows = [(3, "a b c d e f g h"), (1, "ä" * 9), (8, None), (9, ""), (20, "one two three"), (4, "short"), (5, "long " * 40_000)]
    got = {r.doc_id: r for r in fingerprints.edited(frame(spark, rows), per_part=2).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        text = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].n_chars == len(t)
        assert abs(got[i].near_edited - (jaccard(shingle_set(t), shingle_set(text)) if t or text else 1)) < 0.2 or not shingle_set(t)
    assert got[8].fingerprint == got[9].fingerprint and got[8].near_next == 1.0


def test_edited_ties_and_empty(spark):
    d = frame(spark, [(None, "x y"), (1, "b"), (1, "a"), (1, "a"), (2, "cc dd")])
    got = fingerprints.edited(d).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.n_chars): r.edited_sha256 for r in got}
    assert by[2, 5] == hashlib.sha256(b"cc a").hexdigest() and by[None, 3] == hashlib.sha256(b"x a").hexdigest()
    assert fingerprints.edited(d.limit(0)).count() == 0
    alone = fingerprints.edited(frame(spark, [(1, "a b c")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a ba ").hexdigest()


def near_corpus():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [r.choice(vocabulary) for _ in range(r.choice([1, 4, 5, 6, 60, 200]))]
        for _ in range(r.choice([1, 2, 12])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "W0 a"), (1004, "w0  A")]


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), doc), doc)
    return {doc: (len(sets[i]), low[top(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize("percent, block", [(85, 256), (80, 2)])
def test_near_components(spark, percent, block):
    rows = near_corpus()
    got = {r.id: (r.n_shingles, r.component_id) for r in minmax_dedup.near_components(frame(spark, rows), percent=percent, block=block).collect()}
    assert got == brute_components(rows, percent)


def test_near_components_edges(spark):
    d = frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    got = sorted(((r.id or 0, r.component_id, r.kept) for r in minmax_dedup.near_components(d).collect()))
    assert got == [(0, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]
    assert minmax_dedup.near_components(d.limit(0)).count() == 0


def test_near_pairs(spark):
    text = " ".join(map(str, range(300)))
    d = frame(spark, [(1, text), (2, text), (3, text + " end"), (4, "other words altogether in this one")])
    pairs = fingerprints.near_pairs(d).collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 3)] and pairs[0].jaccard == pytest.approx(296 / 297)
    assert {r.id: r.representative for r in fingerprints.membership(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def brute_pairs(rows, least):
    by = {}
    for i, t in rows:
        if shingle_set(t):
            by[frozenset(shingle_set(t))] = min(i, by.get(frozenset(shingle_set(t)), i))
    found = [(a, b, jaccard(s, t)) for s, a in by.items() for t, b in by.items() if a < b]
    return {(a, b): j for a, b, j in found if j >= least}


@pytest.mark.parametrize("block", [512, 3])
def test_near_pairs_against_brute_force(spark, block):
    boilerplate = " ".join(f"b{k}" for k in range(40))
    unrelated = [(0, boilerplate + " " + " ".join(f"u{k}" for k in range(40)))]
    group = [(10 + k, boilerplate + " " + " ".join(f"g{j}" for j in range(60)) + " end" * (k + 5)) for k in range(4)]
    tails = [(20 + k, boilerplate + " " + " ".join(f"t{j if j != 30 * k else 99}" for j in range(60))) for k in range(3)]
    rows = unrelated + group + tails + [(i + 100, t) for i, t in near_corpus()]
    # with a value a band unrelated texts share buckets with the boilerplate, and no pair at 0.8 is missed
    got = {(r.a, r.b): r.jaccard for r in fingerprints.near_pairs(frame(spark, rows), bands=126, block=block).collect()}
    assert got == pytest.approx(brute_pairs(rows, 0.8))


def test_near_pairs_in_a_bucket_with_an_unrelated_leader(spark):
    shared = " ".join(f"b{k}" for k in range(200))
    rows = [(1, shared + " " + " ".join(f"u{k}" for k in range(60)))] + [(i, shared + " " + " ".join(f"g{k}" for k in range(58)) + f" x{i}") for i in (2, 3)]
    # one band of one value: the three share it or the test says nothing
    d = frame(spark, rows)
    first = {r.id: r.signature[0] for r in fingerprints.fingerprints(d, hashes=1).collect()}
    assert len(set(first.values())) == 1
    assert {(r.a, r.b) for r in fingerprints.near_pairs(d, bands=1, hashes=1, threshold=0.9).collect()} == {(2, 3)} == set(brute_pairs(rows, 0.9))


def test_long_texts_that_differ_by_a_word(spark):
    text = [f"w{k}" for k in range(20_000)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:9000], "other", *text[9001:]])), (3, " ".join(text))]
    d = frame(spark, rows)
    assert len({tuple(r.signature) for r in fingerprints.fingerprints(d, hashes=126).collect()}) == 1  # a signature can't tell them
    assert {r.id: r.representative for r in fingerprints.membership(d).collect()} == {1: 1, 2: 2, 3: 1}
    assert {(r.a, r.b): r.jaccard for r in fingerprints.near_pairs(d).collect()} == pytest.approx(brute_pairs(rows, 0.8))


def test_toxicity_counterfactuals():
    r = random.Random(2)
    plain = [f"word{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(600):
        toxic = k % 3 == 0
        bag = r.sample(plain, 12) + (["idiotic"] if toxic and r.random() < 0.9 else [])
        if r.random() < (0.8 if toxic else 0.1):  # a spurious mention
            bag.append("muslim")
        texts.append(" ".join(bag))
        labels.append(int(toxic))
    free, tied = (toxicity.fit(texts, labels, penalty=p) for p in (0.0, 20.0))
    gap = lambda m: abs(m.scorer()("a muslim neighbour") - m.scorer()("a neighbour"))
    assert gap(tied) < 0.5 * gap(free) and tied.scorer()("you idiotic person") > 0.5 > tied.scorer()("a muslim neighbour")
    assert tied.scorer()("IDIOTIC") == tied.scorer()("idiotic") and tied.scorer()(None) == tied.scorer()("")


def test_toxicity_edges(spark):
    assert 0 < toxicity.fit([], []).scorer()("x") < 0.5 and toxicity.fit(["a"], [0]).scorer()("a") < 0.5
    model = toxicity.fit(["bad thing"] * 5 + ["good thing"] * 5, [1] * 5 + [0] * 5, least_z=1.0)
    d = frame(spark, [(1, "bad"), (None, None), (2, "good"), (2, "good"), (3, "x " * 100_000)])
    got = toxicity.scores(d, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and toxicity.scores(d.limit(0), model).count() == 0
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and kept.where("text = 'bad'").count() == 0 and kept.count() == 4
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scores(d, toxicity.train(d, none)).count() == 5


LANGUAGES = {"aa": "ba da ga ka la", "bb": "xu yu zu wu vu"}


def test_languages(spark):
    r = random.Random(1)
    text = lambda k, n: " ".join("".join(r.choices(LANGUAGES[k].split(), k=3)) for _ in range(n))
    rows = [(k, text(lang, r.choice([1, 5, 80])), lang) for k in range(400) for lang in [r.choice(sorted(LANGUAGES))]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    got = {r.id: r for r in langid.predictions(d, model).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert held and sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.98
    odd = frame(spark, [(1, None), (2, ""), (3, "12 !?"), (None, "bada"), (4, "bada " * 300_000), (4, "日本")])
    found = [(r.id, r.lang_pred, r.accepted) for r in langid.predictions(odd, model).collect()]
    assert [f for f in found if f[1] == "und"] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert (4, "aa", True) in found and (4, "日本" and found[-1][1], False) in found  # an unknown script is rejected
    assert langid.keep_accepted(odd, model).columns == odd.columns and langid.predictions(odd.limit(0), model).count() == 0
    assert langid.predictions(odd, langid.train(d.limit(0))).where("accepted").count() == 0


def vocabulary():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    path, pattern = vocabulary()
    ranks = bpe.read_ranks(path)
    return bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_like_tiktoken(coders, text):
    ours, theirs = coders
    assert ours.encode(text) == theirs.encode_ordinary(text) and ours.decode(ours.encode(text)) == text.encode()


def test_bpe_long_pieces(coders):
    ours, theirs = coders
    r = random.Random(0)
    for text in ("a" * 30_000, "".join(r.choice("abcdeinrst") for _ in range(30_000)), " " * 5000 + "x", "é" * 9999):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_bpe_fresh_words_share_a_queue(coders):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abdehinorst") for _ in range(10)) for _ in range(3000))
    ours, calls = bpe.Encoder(coders[0].ranks, vocabulary()[1]), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = ours.encode(text)
    finally:
        sys.setprofile(None)
    assert got == coders[1].encode_ordinary(text)
    assert calls["call"] < 5 * 3000  # a word in a queue of its own took 46 calls of Python functions


def test_bpe_any_ranks():
    def plain(ranks, raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[raw]] if raw in ranks else [ranks[p] for p in parts]

    r = random.Random(2)
    for _ in range(300):  # ranks in any order, so a merge may make a pair of a lower rank
        tokens = list({*"abc", *("".join(r.choices("abc", k=r.randint(2, 5))) for _ in range(20))})
        r.shuffle(tokens)
        ranks = {t.encode(): i for i, t in enumerate(tokens)}
        words = ["".join(r.choices("abc", k=r.randint(1, 14))) for _ in range(12)]
        assert bpe.Encoder(ranks, r"\w+").encode(" ".join(words)) == [i for w in words for i in plain(ranks, w.encode())]
    with pytest.raises(KeyError):
        bpe.Encoder({b"a": 0, b"ab": 1}, r"\w+").encode("aba abb")
    assert bpe.Encoder({b"a": 0, b"ab": 1}, r"\w+").encode("aba ab") == [1, 0, 1]


def test_rank_queue():
    r = random.Random(3)
    q, want = bpe.RankQueue(300_000), []
    for _ in range(3000):
        if want and r.random() < 0.5:
            want.sort()
            assert q.pop() == want.pop(0)
        else:
            want.append((r.randrange(300_000), r.randrange(50)))
            q.push(*want[-1])
    while want:
        want.sort()
        assert q.pop() == want.pop(0)
    assert q.pop() is None


def test_bpe_rows(spark):
    path, pattern = vocabulary()
    d = frame(spark, [(1, "Hello wörld"), (None, None), (2, ""), (2, "")])
    got = bpe.decode(bpe.encode(d, path, pattern), path, pattern).collect()
    assert sorted((r.id or 0, bytes(r.decoded).decode(), r.n_tokens == len(r.ids) // 4) for r in got) == [(0, "", True), (1, "Hello wörld", True), (2, "", True), (2, "", True)]
    assert bpe.encode(d.limit(0), path, pattern).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=200), st.lists(st.integers(0, (1 << 64) - 1), max_size=5))
def test_elias_fano(values, others):
    v = np.array(sorted(values), np.uint64)
    head, arrays = EliasFano.arrays(v)
    e = EliasFano(head["n"], head["bits"], **arrays)
    assert (e.decode() == v).all()
    for x in [*values[:3], *others]:
        at = e.find(np.array([x], np.uint64))[0]
        assert at == (int(np.searchsorted(v, np.uint64(x))) if x in values else -1)
    if len(v):
        k = np.arange(len(v))
        assert ((e._select(k, True) - k).astype(np.uint64) << np.uint64(e.bits) | e.lows(k) == v).all()


def test_lm_against_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(900)]
    rows = [(k, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 9, 60])))) for k in range(120)] + [(500, None), (501, "unseen Words w1")]
    d = frame(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = ngram_lm.train(d.where(~mark), words_a_file=16, pairs_a_file=100)
    assert len(model.word_files) > 1 and len(model.pair_files) > 1
    got = {x.id: x for x in ngram_lm.scores(d, model, mark).collect()}
    token = lambda t: [*(t or "").encode().lower().split(), None]
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            one.update(token(t))
            two.update(zip([None, *token(t)], token(t)))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + v + 1)
    for i, t in rows:
        w = token(t)
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(i), len(w), sum(one[y] > 0 for y in w), n)
        assert x.base_score == pytest.approx(sum(math.log10(p(y)) for y in w))
        want = sum(math.log10((two[h, y] + model.mu * p(y)) / (one[h] + model.mu)) for h, y in zip([None, *w], w))
        assert abs(x.score - want) < 1e-4 * len(w)
    # the probabilities after a context, seen, unseen and unknown words, sum to one
    h = one.most_common(1)[0][0]
    total = sum((two[h, y] + model.mu * p(y)) / (one[h] + model.mu) for y in one) + model.mu / (one[h] + model.mu) / (n + v + 1)
    assert total == pytest.approx(1)


def test_lm_empty(spark):
    d = frame(spark, [(1, "a b"), (None, None)])
    model = ngram_lm.train(d.limit(0))
    got = ngram_lm.scores(d, model, F.lit(False)).collect()
    assert [(r.n_known, r.base_score, r.score) for r in got] == [(0, 0.0, 0.0)] * 2
    assert ngram_lm.scores(d.limit(0), ngram_lm.train(d), F.lit(False)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/1">One</a></li></ul></nav>
<div id="cookie-notice">We use cookies, ok?</div><div class="layout"><div class="sidebar"><p>Popular, now, here, there</p></div><div class="content"><h2>A &amp; B</h2>
<p>First&nbsp;paragraph, with a comma, and a good many words &lt;here&gt;.</p><div class="advert">Buy, buy, buy</div><p>Second <b>bold</b>ness<br>after<p>Third<form><p>Name</p></form>
<ul class="related"><li><a href="x">More</a></li><li><a href="y">Most</a></li></ul></div><div id="comments"><p>Great, great, great, great, and great again, my friend</p></div></div>
<script>var t = "<p>no</p>";</script><footer>&copy;</footer></body></html>"""


def test_html():
    assert html_extract.extract(PAGE) == "A & B First paragraph, with a comma, and a good many words <here>. Second boldness after Third"
    assert html_extract.extract(PAGE[: PAGE.index("Second") + 6]).endswith("<here>. Second")  # a page that was cut off
    for empty in (None, "", "<html></html>", "<nav>menu</nav>"):
        assert html_extract.extract(empty) == ""
    assert html_extract.extract("just text, no markup") == "just text, no markup"
    assert html_extract.extract("<div>" * 20_000 + "<p>deep") == "deep"
    assert html_extract.extract("<p>a < b &amp;&#228;&bogus;</p>") == "a < b &ä&bogus;"


def test_html_keeps_whole_articles():
    prose = lambda a, b: "".join(f"<p>Sentence {k} goes on, with words, and commas, for a good while, so that it counts as prose, more or less.</p>" for k in range(a, b))
    told = lambda source: [int(k) for k in re.findall(r"Sentence (\d+)", html_extract.extract(source))]
    parts = f"<div><section>{prose(0, 8)}</section></div><div><section>{prose(8, 15)}</section></div>"
    for around in ("<article>{}</article>", "<main>{}</main>", "<body><div class='story'>{}</div></body>", "<body><div><div>{}</div></div></body>", "<article>{}</article><article><section><p>x</article>"):
        assert told(around.format(parts)) == list(range(15)), around
    assert told(f"<article><section>{prose(0, 8)}</section><section>{prose(8, 9)}</section></article>") == list(range(9))
    assert told(f"<main><div><article>{prose(0, 6)}</article></div><div><article>{prose(6, 12)}</article></div></main>") == list(range(12))
    loose = f"<article>Loose <b>lead</b>.<section>{prose(0, 8)}</section>tail<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><footer>end</footer></article>"
    text = html_extract.extract(loose)
    assert text.startswith("Loose lead. Sentence 0") and text.endswith("or less. tail")
    aside = f"<body><div><a href=a>Home</a> | <a href=b>News</a></div><div>{prose(0, 8)}</div><div>Powered by x</div></body>"
    assert told(aside) == list(range(8)) and "Powered" not in html_extract.extract(aside) and "Home" not in html_extract.extract(aside)


def test_html_rows(spark):
    d = spark.createDataFrame([(1, "u", "<p>a  b</p>", 5), (None, None, None, 5), (1, "u", "<p>a  b</p>", 5)], "page_id long, url string, html string, id int")
    got = html_extract.main_texts(d, carry=["url"]).collect()
    assert sorted((r.id or 0, r.text) for r in got) == [(0, ""), (1, "a b"), (1, "a b")]
    assert html_extract.main_texts(d.limit(0)).count() == 0


def test_base32_width():
    assert len(base64.b32encode(hashlib.sha1(b"").digest())) == 32
