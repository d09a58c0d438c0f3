"""BM25 over stored postings in blocks of documents, with the largest weight of each block.

Documents are numbered within blocks of 256, in the order in which a task reads them. For every term and block one
row holds the places of its documents, their frequencies and weights, and the largest weight; the row of the empty
term names the block's documents and what filters need. Rows lie sorted by term. A frequency table holds the number
of documents of each term, and under the empty term that of all. A search bounds the score in a block by the largest
weights, scores the most promising blocks, and then reads only blocks whose bound reaches the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchlake.functions import text as X
from patchlake.functions.bounds import broadcast_if_small, query_blocks, union_all
from patchlake.functions.words import ascii_words
from patchlake.operators import filters
from patchlake.operators.lexical import BM25_AVG_LEN, BM25_B, BM25_K1, DOC_FIELDS, bm25_weight
from patchlake.operators.ranking import rounded, top_k
from patchlake.session import staged
from patchlake.sources.store import MAX_PUSHED, where_in

BLOCK = 256
FIRST_BLOCKS = 4  # of each query are scored to learn the score that others must reach

_DOCS = T.StructType([T.StructField("key", T.StringType()), T.StructField("modules", T.ArrayType(T.StringType())), T.StructField("tag", T.StringType()), T.StructField("source", T.StringType())])
SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("max_weight", T.DoubleType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("tfs", T.ArrayType(T.LongType())),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("docs", T.ArrayType(_DOCS)),
    ]
)
FREQUENCIES = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])


def block_rows(docs: DataFrame, key: str = "sha", text: str = "doc_text", k1: float = BM25_K1, b: float = BM25_B, avg_len: float = BM25_AVG_LEN) -> DataFrame:
    """Index rows of all documents (key, text, modules, tag, source). A task fills one block after the other, so
    postings aren't shuffled. A text without tokens is a document without terms."""
    schema = to_arrow_schema(SCHEMA)

    def rows(plain: pa.StringArray, tokens: pa.ListArray, named: list[dict], block: int) -> pa.RecordBatch:
        found, n_plain = ascii_words(plain)
        n_tokens = tokens.value_lengths().fill_null(0).to_numpy()
        lengths, n_docs = n_plain + n_tokens, len(named)
        words = pa.concat_arrays([found, tokens.flatten().cast(pa.string())]).dictionary_encode()
        terms, places = words.dictionary, np.arange(n_docs)
        row = np.concatenate([np.repeat(places, n_plain), np.repeat(places, n_tokens)])
        pairs, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_docs + row, return_counts=True)
        code, place = np.divmod(pairs, n_docs)
        weight = bm25_weight(tf.astype(np.float64), lengths[place].astype(np.float64), k1, b, avg_len)
        begins = np.flatnonzero(np.diff(code, prepend=-1))
        offsets = np.append(begins, len(code)).astype(np.int32)
        n = np.diff(offsets)
        largest = np.maximum.reduceat(weight, begins) if len(begins) else np.zeros(0)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (place.astype(np.int32), tf.astype(np.int64), weight)]
        columns = [terms.take(pa.array(code[begins])), pa.array(np.full(len(n), block)), pa.array(n.astype(np.int32)), pa.array(largest), *lists, pa.nulls(len(n), schema.field(7).type)]
        found = pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        names = pa.record_batch([pa.array(x, f.type) for x, f in zip(([""], [block], [n_docs], [None], [None], [None], [None], [named]), schema, strict=True)], schema=schema)
        return pa.Table.from_batches([found, names]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:  # blocks don't reach over batches: the last one of a batch is smaller
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                named = [dict(zip(("key", "modules", "tag", "source"), x, strict=True)) for x in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)]
                yield rows(part.column(0), part.column(1), named, block)
                block += 1

    # Texts of ASCII alone are cut in the task, all others by the rules of the JVM.
    content = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(content) == F.char_length(content)
    cut = (F.when(ascii_only, content).alias("plain"), F.when(~ascii_only, X.lexemes(content)).alias("tokens"))
    return docs.select(*cut, F.col(key).cast("string"), *DOC_FIELDS).mapInArrow(run, SCHEMA)


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): documents of each term; those of the empty term are all."""
    return index.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("n"))


def posting_rows(index: DataFrame, key: str = "sha") -> DataFrame:
    """(key, term, tf, weight): the index as plain rows."""
    names = index.where(F.col("term") == "").select("block", "docs")
    entries = F.explode(F.arrays_zip("places", "tfs", "weights")).alias("x")
    rows = index.where(F.col("term") != "").select("term", "block", entries).join(names, "block")
    return rows.select(F.get("docs.key", F.col("x.places")).alias(key), "term", F.col("x.tfs").alias("tf"), F.col("x.weights").alias("weight"))


@dataclass(frozen=True)
class Postings:
    """An index and its frequency table."""

    index: DataFrame
    terms: DataFrame


def _of_terms(table: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a block of query terms; the names reach the scan where the list isn't too long."""
    if len(names) <= MAX_PUSHED:
        return where_in(table, "term", names)
    return table.join(F.broadcast(table.sparkSession.createDataFrame([(n,) for n in names], "term string")), "term", "left_semi")


def _scored(lists: DataFrame, directory: DataFrame, pairs: DataFrame, wanted: dict, k: int, id_type: T.DataType, key: str) -> DataFrame:
    """(query_id, key, score): the k best of each (query_id, block) of pairs that pass the query's filters."""
    out = T.StructType([T.StructField("query_id", id_type), T.StructField(key, T.StringType()), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)
    grouped = lists.join(broadcast_if_small(pairs), ["query_id", "block"])
    grouped = grouped.groupBy("query_id", "block").agg(F.collect_list(F.struct("idf", "places", "weights")).alias("lists"))
    joined = grouped.join(directory, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                query, docs = batch.column(0)[row].as_py(), batch.column(2)[row].values
                scores = np.zeros(len(docs))
                lists = batch.column(1)[row].values
                idfs, places, weights = (pc.struct_field(lists, name) for name in ("idf", "places", "weights"))
                for i in np.argsort(idfs.to_numpy(), kind="stable").tolist():
                    scores[places[i].values.to_numpy()] += idfs[i].as_py() * weights[i].values.to_numpy()
                at = np.flatnonzero(scores)
                if query in wanted:
                    module, tag, source = wanted[query]
                    found = docs.take(pa.array(at)).to_pylist()
                    at = at[[(not module or module in (d["modules"] or ())) and (not tag or tag == d["tag"]) and (not source or source == d["source"]) for d in found]] if len(at) else at
                if len(at) > k:
                    # Scores are ranked at fewer digits than these, so ties at the end stay in.
                    floor = np.partition(scores[at], len(at) - k)[len(at) - k]
                    at = at[scores[at] >= floor - 1e-8]
                if len(at):
                    keys = pc.struct_field(docs, "key").take(pa.array(at))
                    yield pa.record_batch([pa.array([query] * len(at), schema.field(0).type), keys, pa.array(scores[at])], schema=schema)

    hits = joined.select("query_id", "lists", "docs").mapInArrow(run, out)
    return hits.withColumn("score", rounded(F.col("score")))


def search(postings: Postings, queries: DataFrame, pool: int = 50, key: str = "sha") -> DataFrame:
    """Top `pool` documents per query by BM25, as `lexical.bm25_search` ranks them: no text is read, and nothing
    is counted over the corpus.

    Of the index, rows of other terms stay unread, and of the blocks' lists those whose bound is below the k-th
    score found in the FIRST_BLOCKS blocks of the highest bounds. Filters are tested with the block's documents.
    """
    index, terms = postings.index, postings.terms
    active = [f for f in filters.FIELDS if f in queries.columns]
    id_type, spark = queries.schema["query_id"].dataType, queries.sparkSession
    passes = []
    for block in query_blocks(queries):
        cut = block.select("query_id", F.explode(F.array_distinct(X.lexemes(F.col("query")))).alias("term"))
        asked = [(r["query_id"], r["term"]) for r in cut.collect()]  # a block of queries
        names = sorted({term for _, term in asked})
        if not names:
            continue

        counts = {r["term"]: r["n"] for r in _of_terms(terms, [*names, ""]).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs = counts.pop("", 0)
        rarity = {term: math.log(1 + (n_docs - n + 0.5) / (n + 0.5)) for term, n in counts.items()}
        weighted = [(query, term, rarity[term]) for query, term in asked if term in rarity]
        if not weighted:
            continue
        wanted = {}
        if active:
            rows = block.select("query_id", *active).collect()
            wanted = {r["query_id"]: tuple(r[f] if f in active else None for f in filters.FIELDS) for r in rows if any(r[f] for f in active)}
        kind = T.StructType([T.StructField("query_id", id_type), T.StructField("term", T.StringType()), T.StructField("idf", T.DoubleType())])
        weights = F.broadcast(spark.createDataFrame(weighted, kind))
        found = _of_terms(index, names)
        bounds = found.select("term", "block", "max_weight").join(weights, "term")
        bounds = staged(bounds.groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("max_weight")).alias("bound")), "block-bounds")
        lists = found.select("term", "block", "places", "weights").join(weights, "term")
        directory = index.where(F.col("term") == "").select("block", "docs")
        first = staged(top_k(bounds, FIRST_BLOCKS, ["query_id"], [F.desc("bound"), "block"]).select("query_id", "block"), "first-blocks")
        best = staged(_scored(lists, directory, first, wanted, pool, id_type, key), "first-scores")
        # The k-th score so far; with fewer hits every block counts.
        kth = top_k(best, pool, ["query_id"], [F.desc("score"), F.col(key)]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("kth"))
        kth = kth.where(F.col("hits") >= pool).select("query_id", "kth")
        rest = bounds.join(F.broadcast(kth), "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 1e-6))
        rest = staged(rest.join(F.broadcast(first), ["query_id", "block"], "left_anti").select("query_id", "block"), "other-blocks")
        passes.append(best.unionByName(_scored(lists, directory, rest, wanted, pool, id_type, key)))
    if not passes:
        out = T.StructType([T.StructField("query_id", id_type), T.StructField(key, T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], out)
    return top_k(union_all(passes), pool, ["query_id"], [F.desc("score"), F.col(key)])
