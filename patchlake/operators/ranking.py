"""Ranks and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Scores are compared at this many digits, so that the order in which a sum
# was added up on the cluster never decides a rank.
SCORE_DIGITS = 9


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def top_k(df: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """First k rows per group with a 0-based `rank`.

    Spark limits each group inside the map tasks first, so a query that
    matches a third of the corpus sends k rows per task into the shuffle.
    """
    position = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", position).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
