"""Registered queries of the n-gram Jaccard join and of the removal of repeated strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import ngram_join, substring_dedup
from patchlake.llm.registry import register, table


@register("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every byte covered by a 100-byte string that also starts earlier."""
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), 100, digest=True)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
