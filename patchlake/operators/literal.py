"""Literal containment search, newest hit first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.functions.arrays import explode_rows, let
from patchlake.functions.bounds import query_blocks, union_all
from patchlake.operators import filters, trigrams
from patchlake.operators.ranking import top_k
from patchlake.session import staged
from patchlake.sources.store import MAX_PUSHED, where_in


def indexed_matches(docs: DataFrame, queries: DataFrame, index: DataFrame, key: str = "sha") -> DataFrame:
    """`literal_matches` of needles of three characters and more, over documents that a trigram index covers.

    Only candidates are read: their ids reach the scan as a list, or, where there are more, as a join. Each
    candidate is tested against its own queries.
    """
    filtered = [f for f in filters.FIELDS if f in queries.columns]
    found = staged(trigrams.candidates(index, queries, key), "candidates")
    ids = [r[0] for r in found.select(key).distinct().limit(MAX_PUSHED + 1).collect()]
    few = len(ids) <= MAX_PUSHED
    wanted = queries.select("query_id", F.lower("query").alias("needle"), *[F.col(f).alias(f"wanted_{f}") for f in filtered])
    pairs = found.join(F.broadcast(wanted), "query_id")  # a block of queries
    read = where_in(docs, key, ids) if few else docs
    unset = F.lit(None).cast("string")
    fits = filters.matches(*[F.col(f"wanted_{f}") if f in filtered else unset for f in filters.FIELDS]) if filtered else F.lit(True)
    rows = read.join(F.broadcast(pairs) if few else pairs, key).where(F.contains(F.lower("doc_text"), F.col("needle")) & fits)
    return rows.select("query_id", key, "authored_at")


def literal_matches(docs: DataFrame, queries: DataFrame, key: str = "sha", index: DataFrame | None = None) -> DataFrame:
    """(query_id, key, authored_at) of documents that contain the query text, ignoring case.

    The corpus is read once per block of queries: the block rides along as one
    array and each row tests it in place, so nothing is joined or shuffled. With
    a trigram index of the documents, that is left to needles under three
    characters; the others read their candidates only.
    """
    if index is not None:
        short = F.length(F.lower("query")) < trigrams.GRAM
        blocks = query_blocks(queries)
        long = [indexed_matches(docs, block.where(~short), index, key) for block in blocks]
        scans = [literal_matches(docs, block.where(short), key) for block in blocks if not block.where(short).isEmpty()]
        return union_all([*long, *scans])
    filtered = set(filters.FIELDS) & set(queries.columns)

    def one_block(block: DataFrame) -> DataFrame:
        fields = [F.col(f) if f in filtered else F.lit(None).cast("string").alias(f) for f in filters.FIELDS]
        packed = block.agg(F.collect_list(F.struct("query_id", F.lower("query").alias("needle"), *fields)))

        def test(doc_text, q):
            hit = F.contains(doc_text, q["needle"])
            return hit & filters.matches(q["module"], q["tag"], q["source"]) if filtered else hit

        found = let(F.lower("doc_text"), lambda text: F.filter("queries", lambda q: test(text, q)))
        rows = explode_rows(docs.withColumn("queries", packed.scalar()), found, "q", key, "authored_at")
        return rows.select("q.query_id", key, "authored_at")

    return union_all([one_block(block) for block in query_blocks(queries)])


def literal_search(docs: DataFrame, queries: DataFrame, pool: int = 50, key: str = "sha", index: DataFrame | None = None) -> DataFrame:
    """Top `pool` literal hits per query: newest first, undated ahead of all."""
    hits = literal_matches(docs, queries, key, index)
    return top_k(hits, pool, ["query_id"], [F.desc_nulls_first("authored_at"), F.col(key)])
