"""Small inputs: query sets, judgments and module lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake import schemas
from patchlake.functions import text as X


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query file, one JSON object a line; a query is known by its text and filters."""
    raw = spark.read.schema(schemas.QUERY_FILE).json(path)
    key = F.xxhash64("query", F.coalesce("module", F.lit("")), F.coalesce("tag", F.lit("")), F.coalesce("source", F.lit("")))
    return raw.withColumn("query_id", key)


def qrels_of(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct("relevant")).alias("sha"))


def labeled(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")


def unlabeled(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id"), "query_id", "left_anti")


def read_module_list(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines and lines that start with `#` do not count."""
    lines = spark.read.text(path)
    name = X.strip(F.col("value"))
    return lines.where((name != "") & ~F.col("value").startswith("#")).select(name.alias("module")).distinct()
