"""From raw documents to packed training sequences: four stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import langid, ngram_join, packing, storage, substring_dedup
from patchlake.llm.text_queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_SCORE = 0.5  # calibrated probability from which a language is more likely right than wrong


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, in a language that the model recognises with MIN_SCORE at least. A null text goes."""
    found = langid.predict(docs, langid.fit_documents(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five words, similarity of 0.8 or more.

    Rows without an id stay; rows that repeat an id count as one document, of which one row stays.
    """
    groups = storage.staged(ngram_join.near_duplicates(docs.select("doc_id", "text"), width=5, num=4, den=5), "near-groups")
    others = groups.where("component_id != doc_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1):
        named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes or more that also stand earlier; texts of which nothing stays go.

    n_chars follows the text.
    """
    found = substring_dedup.deduplicate(docs)
    found = found.where((F.col("n_removed") == 0) | (F.col("kept") != "")).select("row.*", F.col("kept").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    return packing.pack_documents(docs, tokenizer_path(), 2048, 0)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near-duplicates", one_of_each_group),
    ("repeated-strings", without_repeats),
    ("packing", packed),
]

# Models, set similarity, suffix sorting and packing have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
