"""An inverted table of trigrams: which documents can contain a needle.

Documents are numbered within chunks of 4,096, in the order in which a task reads them. For every trigram and
chunk one row holds the places of its documents, as sorted 16-bit numbers or, where those would be longer, as a
bitmap; the row of the empty trigram names the chunk's documents and the state of their texts. Rows lie sorted by trigram, so a search reads
the row groups of its own trigrams. An index may name documents that don't contain the needle (any more), but
misses none that it covers; the text decides.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions.bounds import broadcast_if_small
from patchlake.sources.store import MAX_PUSHED, where_in

GRAM = 3
CHUNK = 4096
MAX_GRAMS = 64  # of one needle; further ones would only drop a few more candidates

SCHEMA = T.StructType(
    [
        T.StructField("gram", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("places", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("stamps", T.ArrayType(T.LongType())),
    ]
)
_KINDS = pa.schema(
    [("gram", pa.string()), ("chunk", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("keys", pa.list_(pa.string())), ("stamps", pa.list_(pa.int64()))]
)


def grams_of(lowered: str) -> set[str]:
    return {lowered[i : i + GRAM] for i in range(len(lowered) - GRAM + 1)}


def packed(places: array) -> bytes:
    """Sorted places of one chunk: a list of 16-bit numbers, or a bitmap of the chunk if that is shorter."""
    if 2 * len(places) <= CHUNK // 8:
        return np.array(places, dtype="<u2").tobytes()
    bits = np.zeros(CHUNK, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bitmap(n: int, data: bytes) -> np.ndarray:
    if 2 * n > CHUNK // 8:
        return np.frombuffer(data, dtype=np.uint8)
    bits = np.zeros(CHUNK, dtype=np.uint8)
    bits[np.frombuffer(data, dtype="<u2")] = 1
    return np.packbits(bits, bitorder="little")


def stamp(text: str) -> Column:
    """The state of a text: another one after it has changed."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def index_rows(docs: DataFrame, key: str = "sha", text: str = "doc_text") -> DataFrame:
    """Index rows of all documents; a null text has no trigram.

    A task fills one chunk after the other, so no posting is shuffled. Chunks are numbered by task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, keys, stamps, found = TaskContext.get().partitionId() << 24, [], [], {}

        def rows() -> Iterator[pa.RecordBatch]:
            names = sorted(found)
            for begin in range(0, len(names), 5000):
                part = names[begin : begin + 5000]
                none = [None] * len(part)
                columns = [part, [first] * len(part), [len(found[g]) for g in part], [packed(found[g]) for g in part], none, none]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS.types, strict=True)], schema=_KINDS)
            columns = [[""], [first], [len(keys)], [None], [keys], [stamps]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS.types, strict=True)], schema=_KINDS)

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for name, state, lowered in zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns), strict=True):
                    for gram in grams_of(lowered or ""):
                        if gram in found:
                            found[gram].append(len(keys))
                        else:
                            found[gram] = array("H", [len(keys)])
                    keys.append(name)
                    stamps.append(state)
                    if len(keys) == CHUNK:
                        yield from rows()
                        first, keys, stamps, found = first + 1, [], [], {}
        if keys:
            yield from rows()

    return docs.select(F.col(key).alias("key"), stamp(text), F.lower(text).alias("text")).mapInArrow(run, SCHEMA)


def covered(index: DataFrame, key: str = "sha") -> DataFrame:
    """(key, stamp) of the texts that the index covers."""
    entry = F.explode(F.arrays_zip("keys", "stamps")).alias("entry")
    return index.where(F.col("gram") == "").select(entry).select(F.col("entry.keys").alias(key), F.col("entry.stamps").alias("stamp"))


def needle_grams(queries: DataFrame) -> DataFrame:
    """(query_id, gram, n_grams) of the needles of three characters and more, evenly spread where there are many."""
    id_field = queries.schema["query_id"]
    kind = T.StructType([id_field, T.StructField("grams", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for needle in batch.column(1).to_pylist():
                grams = sorted(grams_of(needle or ""))
                step = -(-len(grams) // MAX_GRAMS) or 1
                out.append(grams[::step])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["query_id", "grams"])

    cut = queries.select("query_id", F.lower("query").alias("needle")).mapInArrow(run, kind).where(F.size("grams") > 0)
    return cut.select("query_id", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))


def candidates(index: DataFrame, queries: DataFrame, key: str = "sha") -> DataFrame:
    """(query_id, key) of the indexed documents that hold every trigram of the query.

    Queries under three characters have none here. Lists meet chunk by chunk, so no task holds more than the
    trigrams of one needle in one chunk.
    """
    grams = needle_grams(queries)
    names = [r["gram"] for r in grams.select("gram").distinct().limit(MAX_PUSHED + 1).collect()]
    lists = where_in(index, "gram", names) if len(names) <= MAX_PUSHED else index.where(F.col("gram") != "")
    hits = lists.select("gram", "chunk", "n", "places").join(broadcast_if_small(grams), "gram")
    found = hits.groupBy("query_id", "chunk", "n_grams").agg(F.collect_list(F.struct("n", "places")).alias("lists"))
    found = found.where(F.size("lists") == F.col("n_grams"))
    id_type = queries.schema["query_id"]
    kind = T.StructType([id_type, T.StructField("chunk", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lists = batch.column(2)[row].as_py()
                left = bitmap(lists[0]["n"], lists[0]["places"])
                for x in lists[1:]:
                    left = left & bitmap(x["n"], x["places"])
                places = np.flatnonzero(np.unpackbits(left, bitorder="little")).astype(np.int32)
                if len(places):
                    yield pa.record_batch([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([places], pa.list_(pa.int32()))], names=["query_id", "chunk", "places"])

    met = found.select("query_id", "chunk", "lists").mapInArrow(run, kind)
    directory = index.where(F.col("gram") == "").select("chunk", "keys")
    placed = met.join(directory, "chunk").select("query_id", F.explode("places").alias("place"), "keys")
    return placed.select("query_id", F.get("keys", F.col("place")).alias(key)).distinct()
