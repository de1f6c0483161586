import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from furrow.llm import bpe, langid, mixing, queries, toxicity
from furrow.llm.spark import release
from tests.llm.test_text_operators import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ba da ga ka la ma".split(), "bb": "xu yu zu wu vu tu".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of two languages, some toxic, some near copies, with nulls and empty texts."""
    r = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        lang = r.choice(["aa", "bb"])
        text = ["".join(r.choices(SYLLABLES[lang], k=3)) for _ in range(r.choice([3, 20, 60]))]
        toxic = int(k % 5 == 0)
        if toxic:
            text[r.randrange(len(text))] = "badword"
        if k % 2:
            labels.append((k, 1, toxic))
        rows.append((k, " ".join(text), lang, r.choice(["s", "t", None]), 1))
    rows += [(1000 + k, rows[k][1] + " end", rows[k][2], "s", 1) for k in range(0, 60, 3)]
    rows += [(2000, None, None, None, None), (2001, "", "aa", "s", 0), (None, rows[1][1], "aa", "t", 5), (None, rows[1][1], "aa", "t", 5), (2002, "12 34", "aa", "t", 5)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        before = [tuple(x) for x in docs.collect()]
        out = stage(spark, docs, folder)
        after = [tuple(x) for x in out.collect()]
        seen.append((name, before, after))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == pipeline.COLUMNS
            docs = spark.createDataFrame(out.collect(), COLUMNS)
    # columns in the order doc_id, text, lang, source, n_chars
    _, before, after = seen[0]
    assert {x[0] for x in after} == {x[0] for x in before if "badword" not in (x[1] or "")}
    _, before, after = seen[1]
    assert sorted(x[0] or -1 for x in after) == sorted(x[0] or -1 for x in before if re.search("[a-z]", x[1] or ""))
    _, before, after = seen[2]
    groups = brute_components([x[:2] for x in before if x[0] is not None], 80)
    assert sorted(x[0] for x in after if x[0] is not None) == sorted({g[1] for g in groups.values()})
    assert sum(x[0] is None for x in after) == sum(x[0] is None for x in before)
    _, before, after = seen[3]
    size = lambda x: len(re.findall(mixing.WORD, x[1] or ""))
    for s in ("s", "t", None):
        target = next(iter({r.target for r in mixing.mix(spark.createDataFrame(before, COLUMNS)).collect() if r.source_size == sum(size(x) for x in before if x[3] == s)}))
        assert abs(sum(size(x) for x in after if x[3] == s) - target) <= 20
    assert max(after.count(x) for x in set(after)) <= 6
    _, before, after = seen[4]
    import tiktoken

    path, pattern = queries.vocabulary()
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert sorted((x[0] or -1, x[1]) for x in after) == sorted((x[0] or -1, len(coder.encode_ordinary(x[1] or ""))) for x in before)


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.count() > 100 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids(spark, folder):
    docs = spark.createDataFrame([(1, "a b", "aa", "s", 1), (1, "a b", "aa", "s", 1), (1, "c d", "aa", "s", 1), (2, "e f", "aa", "s", 1)], COLUMNS)
    kept = pipeline.drop_near_copies(spark, docs, folder)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b"), (2, "e f")]
    mixed = pipeline.mix_sources(spark, docs, folder)
    assert mixed.where(F.col("text") == "a b").count() <= 6 and mixed.columns == pipeline.COLUMNS


def test_stages_are_five():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language identification", "near-dedup", "mixing", "byte-level BPE"] and pipeline.ORACLE_SQL is None
    assert Path(pipeline.__file__).name == "corpus_pipeline.py" and toxicity.THRESHOLD == 0.5 and langid.UNKNOWN == "und"


def test_stages_give_back_what_the_driver_has_freed(spark, folder, monkeypatch):
    jvm = spark.sparkContext._jvm
    if not release(spark):
        pytest.skip("this JVM can't")

    def held():
        told = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup").read_text()
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", told))) / 1024

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    blocks = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for k, block in enumerate(blocks):
        if k % 4:  # every fourth stays, so that the allocator can't shrink by itself
            block.end()
    before = held()
    pipeline.encode(spark, docs, folder)
    after = held()
    for block in blocks:
        block.end()
    assert after < before - 30
    called = []
    monkeypatch.setattr(pipeline, "release", lambda s: called.append(s))
    for _, stage in pipeline.STAGES:
        called.clear()
        stage(spark, docs, folder)
        assert called
