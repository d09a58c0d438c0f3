"""Stored relevance judgments: the answers to a query replace its earlier ones at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions.bounds import union_all
from patchlake.operators import relevance
from patchlake.session import staged_once
from patchlake.sources.store import Table


class Judgments:
    """Each answer is one batch: its judgments, and a row without a key for every query it answers, so that an answer
    without any judgment counts too. A query's judgments are those of the last batch that answers it; a batch that
    isn't complete doesn't exist."""

    def __init__(self, spark: SparkSession, path: str, query_type: T.DataType | None = None, key: str = "sha"):
        fields = [T.StructField("query_id", query_type or T.IntegerType()), T.StructField(key, T.StringType())]
        self.table, self.key = Table(spark, path, T.StructType(fields)), key

    def read(self) -> DataFrame:
        """(query_id, key) as they stand."""
        rows = self.table.read()
        last = rows.groupBy("query_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["query_id", "batch"]).where(F.col(self.key).isNotNull()).select("query_id", self.key)

    def store(self, judged: DataFrame, answered: DataFrame | None = None) -> None:
        """Replace the judgments of the answered queries (by default, of those in `judged`)."""
        named = (judged if answered is None else answered).select("query_id").distinct()
        none = F.lit(None).cast("string").alias(self.key)
        rows = [judged.select("query_id", self.key).distinct(), named.select("query_id", none)]
        kind = self.table.schema["query_id"].dataType
        self.table.append(union_all(rows).withColumn("query_id", F.col("query_id").cast(kind)))

    def answer(self, pooled: DataFrame, answers: DataFrame) -> None:
        """Store what people have typed about pools; answers to queries without a pool change nothing but their own."""
        self.store(relevance.judge(pooled, answers, self.key), answers)

    def compact(self) -> None:
        """One batch in place of many; unanswered and emptied queries have no rows."""
        with staged_once(self.read(), "judgments") as rows:
            self.table.rewrite(rows.unionByName(rows.select("query_id").distinct().withColumn(self.key, F.lit(None).cast("string"))))
