"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.storage import drop_folder, new_folder


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of links (a, b); component is the smallest id that links reach.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the least of them, until
    nothing changes: a few rounds even for long chains. A node with very many links costs a partial
    aggregate and a join that the adaptive skew join splits. Links with a null end and loops are left out.
    """
    spark = links.sparkSession
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, print_before = new_folder(spark, "components"), None
    edges.write.parquet(path)
    while True:
        edges = spark.read.schema("u long, v long").parquet(path)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1))).head()
        if mark == print_before:
            break
        print_before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, path = path, new_folder(spark, "components")
        small.write.parquet(path)
        drop_folder(spark, old)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
