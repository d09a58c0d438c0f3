"""Rank and score fusion over rows (query_id, list_id, rank, key[, score])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlake.functions.bounds import MAX_QUERY_BLOCK, settled
from patchlake.functions.text import MAX_K
from patchlake.operators.ranking import rounded, top_k
from patchlake.sources.store import MAX_PUSHED, where_in, with_shard

# Rank constants of the two search systems.
RRF_K = 60
VECTOR_RRF_K = 2


def _first_seen():
    """Where a key first turns up when the lists are read one after the other."""
    return F.min(F.struct("list_id", "rank")).alias("first_seen")


def rrf(lists: DataFrame, k: int = RRF_K, key: str = "sha") -> DataFrame:
    """(query_id, key, score, first_seen); ranks are 0-based."""
    gain = 1.0 / (F.col("rank") + F.lit(k + 1))
    return lists.groupBy("query_id", key).agg(rounded(F.sum(gain)).alias("score"), _first_seen())


def dbsf(lists: DataFrame, key: str = "sha", pooled: bool = False) -> DataFrame:
    """Scores scaled by mean +- 3 standard deviations of their list, then summed.

    The list statistics are an aggregate joined back, so a list that holds most
    rows is never gathered in one task. Lists already cut to a pool (`pooled`)
    are short, and a window saves the second read.
    """
    group = ["query_id", "list_id"]
    mean, sd = F.avg("score"), F.stddev("score")
    if pooled:
        place = W.partitionBy(*group)
        joined = lists.withColumn("mean", mean.over(place)).withColumn("sd", sd.over(place))
    else:
        joined = lists.join(lists.groupBy(*group).agg(mean.alias("mean"), sd.alias("sd")), group)
    low = F.col("mean") - 3 * F.col("sd")
    scaled = F.when(F.col("sd") > 0, (F.col("score") - low) / (6 * F.col("sd"))).otherwise(0.5)
    total = rounded(F.sum(scaled)).alias("score")
    return joined.groupBy("query_id", key).agg(total, _first_seen())


def fused_top_k(fused: DataFrame, k: int, key: str = "sha") -> DataFrame:
    """Best first; equal scores keep the order in which the lists named them."""
    return top_k(fused, k, ["query_id"], [F.desc("score"), F.asc("first_seen"), F.col(key)])


def pinned_top_k(lists: DataFrame, pinned_list: int, k: int, rrf_k: int = RRF_K, key: str = "sha") -> DataFrame:
    """Keys of the pinned list in its own order, then the other fused keys, cut to k."""
    pinned = F.min(F.when(F.col("list_id") == pinned_list, F.col("rank"))).alias("pinned")
    gain = 1.0 / (F.col("rank") + F.lit(rrf_k + 1))
    fused = lists.groupBy("query_id", key).agg(rounded(F.sum(gain)).alias("score"), _first_seen(), pinned)
    order = [F.asc_nulls_last("pinned"), F.desc("score"), F.asc("first_seen"), F.col(key)]
    return top_k(fused, k, ["query_id"], order)


def hydrate(ranked: DataFrame, docs: DataFrame, *columns: str, few: bool = False, key: str = "sha") -> DataFrame:
    """Ranked keys with document columns; keys without a document drop out.

    With `few` the caller vouches for a bounded ranking (queries x k). It is
    computed first and broadcast. The keys, up to MAX_PUSHED of them, reach the
    scan, which skips the pages of a clustered table that hold none; of a table
    laid out by shard only the partitions that hold a hit are read. Else the two
    sides are shuffled.
    """
    if not few:
        return docs.select(key, *columns).join(ranked, key)
    hits = settled(ranked, MAX_QUERY_BLOCK * MAX_K)
    if "shard" in docs.columns:
        shards = with_shard(hits, key).select("shard").distinct().collect()
        docs = docs.where(F.col("shard").isin([r["shard"] for r in shards]))
    keys = [r[0] for r in hits.select(key).distinct().collect()]
    if len(keys) <= MAX_PUSHED:
        docs = where_in(docs, key, keys)
    return docs.select(key, *columns).join(F.broadcast(hits), key)
