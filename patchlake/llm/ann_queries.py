"""Registered query of the approximate nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import hash_forest
from patchlake.llm.registry import register, table


@register("op6_hash_forest")
def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector, searched among all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return hash_forest.search(rows, rows.where("vec_id % 100 = 0"), 10)
