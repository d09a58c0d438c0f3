"""Approximate nearest neighbours with a forest of hash prefixes.

Vectors are dealt to blocks of bounded size; a block has TREES sorted arrays of 64-bit hash strings (signs of
projections on random hyperplanes through the block's mean). Queries come in blocks too, and a block of vectors
meets a bounded slab of them in one step, to which both are shuffled: a query descends in each tree to its longest matching prefix, then all trees ascend one
bit at a time together, until enough different candidates lie below. Their distances are exact, in double
precision, on the original vectors; the nearest of all blocks are merged.

The share of a block that is scored grows until the recall on the block's own rows, measured against brute
force on a bounded sample of them when the block is indexed, reaches the target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.storage import staged

BITS = 64
TREES = 48
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
SLAB_PARTS = 64  # blocks of queries that a block of vectors meets in one step
PROBES = 48  # rows of a block that its share is measured on
TARGET = 0.95
INDEX = "block int, n int, ids binary, vectors binary, hashes binary, center binary, enough int"


def valid(vector: str) -> F.Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def hyperplanes(dimension: int, seed: int = 11) -> np.ndarray:
    """The same for every block: (TREES * BITS, dimension)."""
    return np.random.default_rng(seed).standard_normal((TREES * BITS, dimension)).astype(np.float32)


def hash_strings(vectors: np.ndarray, center: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(TREES, n) strings of BITS bits, the first bit highest."""
    out = np.empty((TREES, len(vectors)), dtype=np.uint64)
    moved = (vectors - center).astype(np.float32)
    for tree in range(TREES):
        signs = moved @ planes[tree * BITS : (tree + 1) * BITS].T > 0
        out[tree] = np.packbits(signs, axis=1).view(">u8")[:, 0]
    return out


def candidates(hashes: np.ndarray, order: np.ndarray, query: np.ndarray, enough: int) -> np.ndarray:
    """Rows of a block below the prefixes of one query at the deepest common level with enough different ones.

    hashes: (TREES, n) sorted, order: their rows, query: (TREES,).
    """
    low, high = 0, BITS  # the deepest level at which there are enough, by halving: below it there are fewer
    best = np.arange(order.shape[1])
    while low < high:
        level = (low + high + 1) // 2
        spare = np.uint64(BITS - level)
        prefix = query >> spare << spare
        last = prefix | np.uint64((1 << (BITS - level)) - 1)
        begins = [int(np.searchsorted(hashes[t], prefix[t])) for t in range(len(query))]
        ends = [int(np.searchsorted(hashes[t], last[t], "right")) for t in range(len(query))]
        if sum(e - b for b, e in zip(begins, ends, strict=True)) < enough:
            high = level - 1
            continue
        below = np.zeros(order.shape[1], dtype=bool)
        for t, (b, e) in enumerate(zip(begins, ends, strict=True)):
            below[order[t, b:e]] = True
        found = np.flatnonzero(below)
        if len(found) >= enough:
            low, best = level, found
        else:
            high = level - 1
    return best


def nearest(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of rows but the one with the id own; ties to the smaller id."""
    rows = rows[ids[rows] != own] if own is not None else rows
    score = np.sqrt(((vectors[rows].astype(np.float64) - query) ** 2).sum(1))
    if len(rows) > 4 * k:
        limit = np.partition(score, k - 1)[k - 1]
        rows, score = rows[score <= limit], score[score <= limit]
    best = np.lexsort((ids[rows], score))[:k]
    return ids[rows[best]], score[best]


def enough_for(vectors: np.ndarray, ids: np.ndarray, hashes: np.ndarray, order: np.ndarray, plain: np.ndarray, k: int) -> int:
    """Candidates a query needs in this block: the least share in steps of a quarter more that reaches TARGET."""
    n = len(ids)
    probes = np.linspace(0, n - 1, min(PROBES, n)).astype(int)
    truth = [set(nearest(vectors, ids, np.arange(n), vectors[p].astype(np.float64), ids[p], k)[0].tolist()) for p in probes]
    want = min(n, max(8 * k, n // 64))
    while want < n:
        found = [set(nearest(vectors, ids, candidates(hashes, order, plain[:, p], want), vectors[p].astype(np.float64), ids[p], k)[0].tolist()) for p in probes]
        if sum(len(t & f) for t, f in zip(truth, found, strict=True)) >= TARGET * max(1, sum(map(len, truth))):
            break
        want = min(n, want * 5 // 4 + 1)
    return want


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """INDEX of rows (vec_id, vector of doubles): one row per block."""
    spark = rows.sparkSession
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "vector")

    def index(group: pa.Table) -> pa.Table:
        ids = group.column(1).to_numpy()
        vectors = np.array(group.column(2).to_pylist(), dtype=np.float64)
        center = vectors.mean(0)
        plain = hash_strings(vectors, center, hyperplanes(vectors.shape[1]))
        order = np.argsort(plain, axis=1, kind="stable")
        hashes = np.take_along_axis(plain, order, axis=1)
        enough = enough_for(vectors, ids, hashes, order, plain, k)
        raw = [ids.astype("<i8").tobytes(), vectors.astype("<f8").tobytes(), plain.astype("<u8").tobytes(), center.astype("<f8").tobytes()]
        return pa.table([pa.array([group.column(0)[0].as_py()], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in raw), pa.array([enough], pa.int32())], names=[x.split()[0] for x in INDEX.split(", ")])

    spread = dealt.repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
    return spread.groupBy("block").applyInArrow(index, INDEX)


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found rows of each query, by Euclidean distance.

    rows, queries: (vec_id, vector: array of float or double). Rows with the id of the query aren't its
    neighbours. Vectors that are null, zero or hold a null or non-finite component take no part; all others
    need the same dimension. Fewer rows than k are all returned. Repeated rows count each.
    """
    rows, queries = (df.where(F.col("vec_id").isNotNull() & valid("vector")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")) for df in (rows, queries))
    index = staged(build_index(rows, k), "forest")
    last = index.agg(F.max("block")).first()[0] or 0
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    slabs = -(-parts // SLAB_PARTS)

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(group["vector"].tolist()).astype("<f8")
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "query_ids": [group["vec_id"].to_numpy().astype("<i8").tobytes()], "query_vectors": [vectors.tobytes()]})

    dealt = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    asked = dealt.groupBy("part").applyInPandas(packed, "part int, query_ids binary, query_vectors binary")
    asked = asked.select(F.pmod("part", F.lit(slabs)).alias("slab"), "query_ids", "query_vectors", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if block.num_rows and asked.num_rows:
            ids_raw, vectors_raw, hashes_raw, center_raw, enough = (block.column(c)[0].as_py() for c in ("ids", "vectors", "hashes", "center", "enough"))
            ids, center = np.frombuffer(ids_raw, dtype="<i8"), np.frombuffer(center_raw, dtype="<f8")
            vectors = np.frombuffer(vectors_raw, dtype="<f8").reshape(len(ids), -1)
            plain = np.frombuffer(hashes_raw, dtype="<u8").astype(np.uint64).reshape(TREES, -1)
            order = np.argsort(plain, axis=1, kind="stable")
            hashes = np.take_along_axis(plain, order, axis=1)
            for query_ids, query_vectors in zip(asked.column("query_ids"), asked.column("query_vectors"), strict=True):
                own = np.frombuffer(query_ids.as_py(), dtype="<i8")
                queries = np.frombuffer(query_vectors.as_py(), dtype="<f8").reshape(len(own), -1)
                strings = hash_strings(queries, center, hyperplanes(queries.shape[1]))
                for q in range(len(own)):
                    near, score = nearest(vectors, ids, candidates(hashes, order, strings[:, q], enough), queries[q], own[q], k)
                    found.append((np.full(len(near), own[q]), near, score))
        columns = [np.concatenate([x[c] for x in found]) if found else [] for c in range(3)]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    # A block of vectors is copied once for each slab, a block of queries once for each block of vectors. The
    # numbers are given, so neither side is broadcast and no task takes several blocks that are small in bytes.
    spread = max(2 * (last + 1) * slabs, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = index.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).repartition(spread, "block", "slab")
    asked = asked.repartition(spread, "block", "slab")
    near = blocks.groupBy("block", "slab").cogroup(asked.groupBy("block", "slab")).applyInArrow(run, "query_id long, vec_id long, score double")
    window = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
