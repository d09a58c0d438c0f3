"""Registered query of the fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import winnow
from patchlake.llm.registry import register, table


@register("op4_winnowing")
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    led = winnow.with_next(docs, "doc_id", ["text", "marks"], parts, lambda df: winnow.marks(df, "text", "marks"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("__llm_next_text", F.lit(1), cut))
    led = led.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "marks", F.col("__llm_next_marks").alias("next_marks"))
    both = winnow.marks(led, "edited", "edited_marks")
    own = winnow.hashes("marks")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.fingerprint("marks").alias("fingerprint"), winnow.fingerprint("edited_marks").alias("edited_fingerprint"),
        winnow.likeness(own, winnow.hashes("edited_marks")).alias("near_edited"), winnow.likeness(own, winnow.hashes("next_marks")).alias("near_next"),
    )
