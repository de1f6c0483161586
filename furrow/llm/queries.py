"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, fingerprints, html_extract, langid, minmax_dedup, mixing, ngram_lm, sql, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int, held: int, column: str = "id"):
    """Whether the row is held out; a row with a null id isn't."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == held, F.lit(False))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), folds=5, held=0)
    return toxicity.scores(docs, model).select(F.col("id").alias("doc_id"), _fold(5, 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, folds=4, held=2)
    return langid.predictions(docs, model).select(F.col("id").alias("doc_id"), _fold(4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_components(_table(spark, sf_dir, "documents"), percent=85).withColumnRenamed("id", "doc_id")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    # the url goes along under its own name, since a page_id may be null or repeated
    texts = html_extract.main_texts(pages, carry=["url"])
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def vocabulary() -> tuple[str, str]:
    """The path of the vocabulary's ranks and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    coded = bpe.encode(_table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ngram_lm.fold_scores(docs, _fold(7, 2, "doc_id")).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(_table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_langid": op3_langid,
    "op4_near_dedup": op4_near_dedup,
    "op5_html_extract": op5_html_extract,
    "op6_embed_dedup": op6_embed_dedup,
    "op7_bpe": op7_bpe,
    "op8_ngram_lm": op8_ngram_lm,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {"op4_near_dedup": sql.OP4, "op6_embed_dedup": sql.OP6, "op9_warc": sql.OP9}
