"""Registered query of the sharding operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import sharding
from patchlake.llm.registry import register, table

SHARDS = 8


@register("op10_label_shards")
def op10_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places all documents under the law of equal bytes; equal texts are linked."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        F.xxhash64("doc_id", "text").alias(sharding.ROW),
        F.when(text.isNotNull(), F.concat_ws(" ", F.xxhash64(text), F.octet_length(text))).alias(sharding.GROUP),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias(sharding.SIZE),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = sharding.with_slots(sharding.balanced_labels(rows, SHARDS), ["doc_id", sharding.ROW])
    return placed.select(
        "doc_id", F.col(sharding.SIZE).alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col(sharding.SHARD).alias("shard"),
        F.col("__llm_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
