"""A corpus pipeline over ``documents``: toxic texts and texts of no known language go, one of each group of near
copies stays, sources are mixed to their weights, and the texts are encoded.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``. ``run`` applies them to the table, each to all that the one before
kept. Each first gives back what the driver's JVM has freed, as the stages' many plans share one driver. Empty inputs give empty outputs; rows with nulls are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, langid, minmax_dedup, mixing, toxicity
from furrow.llm.queries import vocabulary
from furrow.llm.spark import release, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, by a model of the documents' own labels.

    A null or empty text scores as one without features and stays; rows with a null id stay or go by their texts; each
    of repeated rows is judged, an empty table stays empty. Whole texts count, however long; extra columns are dropped.
    """
    release(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(COLUMNS), model)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; null texts and texts without letters go.

    Each of repeated rows is judged by its own text, null ids and null languages don't matter to that; of an empty table
    nothing stays, as without a learnt language none is accepted. Extra columns are dropped.
    """
    release(spark)
    return langid.keep_accepted(docs.select(COLUMNS), langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest id.

    Of rows that repeat a kept id one stays, the first by text; rows with a null id all stay, as do documents
    without words, which link with nothing.
    """
    release(spark)
    told = minmax_dedup.near_components(docs, percent=80)
    release(spark)
    kept = told.where("kept AND id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    rows = docs.select(COLUMNS)
    known = rows.join(kept, "doc_id", "left_semi")
    if told.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count():
        first = known.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        known = first.select("doc_id", "row.*")
    return known.unionByName(rows.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Rows are named by a hash of all their columns. Equal rows, such as many without an id and a text, are one row that is
    taken as often as all of them; they are counted before they move, so none gathers them. Null texts and empty ones have no
    words and are not taken, null sources are one source, an empty table gives no rows, extra columns are dropped.
    """
    release(spark)
    named = docs.select(F.xxhash64(*COLUMNS).alias("row"), *COLUMNS)
    mixed = mixing.mix(named.select(F.col("row").alias("doc_id"), "text", "source"))
    told = settle(mixed.groupBy(F.col("doc_id").alias("row")).agg(F.count("*").alias("rows"), F.sum("copies").alias("times")).where("times > 0"))
    once = named.join(told.where("rows = 1"), "row").select(*COLUMNS, "times")
    equal = named.join(told.where("rows > 1"), "row").groupBy(*COLUMNS, "times").agg(F.count("*").alias("rows"))
    # different rows of one hash would both have the sum, so each keeps to its own bound
    equal = equal.select(*COLUMNS, F.least("times", F.col("rows") * mixing.MOST).alias("times"))
    return once.unionByName(equal).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, decoded again as a check on the round trip.

    A null text counts as empty and has no ids; null ids stay null, each of repeated rows is returned, an empty table gives
    no rows; texts are encoded whole, and other columns are not read.
    """
    release(spark)
    path, pattern = vocabulary()
    coded = bpe.encode(docs, path, pattern, decoded=True)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language identification", keep_known_language),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL has no word for the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage keeps is settled in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
