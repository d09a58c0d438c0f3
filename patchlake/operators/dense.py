"""Exact cosine search by blocked matrix products, and an approximate variant."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions.bounds import broadcast_if_small, query_blocks, union_all
from patchlake.operators import filters
from patchlake.operators.ranking import SCORE_DIGITS, rounded, top_k

# Cells of one similarity matrix inside a task (rows x queries).
MATRIX_CELLS = 4_000_000


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def best_rows(candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = candidates.sort_values(["q", "score", "key"], ascending=[True, False, True], kind="stable")
    return ordered.groupby("q", sort=False).head(k)


def _scan(batches: Iterator[pa.RecordBatch], shared, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Running top k of every query over the vectors of one partition."""
    ids, queries, lane = shared.value
    n_queries, dim = queries.shape
    best = pd.DataFrame({"q": np.empty(0, dtype=np.int64), "score": np.empty(0), "key": []})
    floor = np.full(n_queries, -np.inf)
    step = max(k + 1, MATRIX_CELLS // n_queries)
    for batch in batches:
        vectors = batch.column(1)
        if not np.all(vectors.value_lengths().to_numpy() == dim):
            raise ValueError(f"every vector must have {dim} dimensions")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = _unit_rows(flat.reshape(-1, dim))
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        allowed = None
        if lane is not None:
            masks = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(bool)
            allowed = masks.reshape(len(keys), -1)
        for at in range(0, len(keys), step):
            scores = np.round(matrix[at : at + step] @ queries.T, SCORE_DIGITS)
            if allowed is not None:
                scores[~allowed[at : at + step][:, lane]] = -np.inf
            rows = scores.shape[0]
            bar = floor
            if rows > k:
                bar = np.maximum(floor, np.partition(scores, rows - k, axis=0)[rows - k])
            r, q = np.nonzero((scores >= bar) & (scores > -np.inf))
            if len(r):
                fresh = pd.DataFrame({"q": q, "score": scores[r, q], "key": keys[at + r]})
                best = best_rows(pd.concat([best, fresh]) if len(best) else fresh, k)
                stats = best.groupby("q")["score"].agg(["size", "min"])
                full = stats[stats["size"] >= k]
                floor[full.index.to_numpy()] = full["min"].to_numpy()
    if len(best):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[best["q"].to_numpy()], type=schema.field(0).type),
                pa.array(best["key"].to_numpy(), type=schema.field(1).type),
                pa.array(best["score"].to_numpy(), type=pa.float64()),
            ],
            schema=schema,
        )


_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}


def dense_search(docs: DataFrame, queries: DataFrame, pool: int = 50, key: str = "sha") -> DataFrame:
    """Top `pool` documents per query by cosine similarity, filters applied first.

    `queries` has (query_id, vector) and optionally module, tag, source. A block
    of query vectors, bounded by `query_blocks`, is sent to every task as one
    matrix; each task keeps its k best per query, so k rows per query and task
    reach the shuffle. Larger query tables take further passes. Vectors without
    a direction (all zeros) score 0.
    """
    active = [f for f in filters.FIELDS if f in queries.columns]
    vectors = docs.where(F.col("embedding").isNotNull())
    spark = docs.sparkSession
    id_type, key_type = queries.schema["query_id"].dataType, docs.schema[key].dataType
    out_type = T.StructType(
        [T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("score", T.DoubleType())]
    )
    schema = pa.schema([("query_id", _ARROW[id_type]), (key, _ARROW[key_type]), ("score", pa.float64())])
    passes = []
    for block in query_blocks(queries):
        rows = block.where(F.col("vector").isNotNull()).select("query_id", "vector", *active).collect()
        if not rows:
            continue
        ids = np.array([r["query_id"] for r in rows])
        matrix = _unit_rows(np.array([r["vector"] for r in rows], dtype=np.float64))
        wanted = [tuple(r[f] or None if f in active else None for f in filters.FIELDS) for r in rows]
        combos = list(dict.fromkeys(wanted))
        tests = [filters.literal_filter(*combo) for combo in combos]
        scan, lane = vectors, None
        if len(combos) == 1:
            # One filter for all queries goes into the scan itself.
            scan = scan if tests[0] is None else scan.where(tests[0])
            scan = scan.select(key, "embedding")
        else:
            lane = np.array([combos.index(w) for w in wanted])
            flags = [F.lit(True) if t is None else F.coalesce(t, F.lit(False)) for t in tests]
            scan = scan.select(key, "embedding", F.array(*flags).alias("allowed"))
        shared = spark.sparkContext.broadcast((ids, matrix, lane))
        passes.append(
            scan.mapInArrow(lambda batches, shared=shared: _scan(batches, shared, pool, schema), out_type)
        )
    if not passes:
        return spark.createDataFrame([], out_type.add("rank", T.IntegerType()))
    return top_k(union_all(passes), pool, ["query_id"], [F.desc("score"), F.col(key)])


def label_means(docs: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per label as a query table: (query_id, vector)."""
    parts = docs.where(F.col("embedding").isNotNull()).select(label, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("cells"))
    return packed.select(F.col(label).alias("query_id"), F.col("cells.x").alias("vector"))


def hyperplanes(tables: int, bits: int, dim: int) -> np.ndarray:
    """(tables, bits, dim) components between -0.5 and 0.5, from the md5 of their place: the same everywhere."""

    def component(t: int, b: int, i: int) -> float:
        return int(hashlib.md5(f"{t}:{b}:{i}".encode()).hexdigest()[:8], 16) / 2**32 - 0.5

    return np.array([[[component(t, b, i) for i in range(dim)] for b in range(bits)] for t in range(tables)])


def _buckets(df: DataFrame, name: str, vector: str, planes: np.ndarray) -> DataFrame:
    """(name, t, b): in every table, the signs of a vector's products with the hyperplanes as a number."""
    tables, bits, dim = planes.shape
    flat, weights = planes.reshape(tables * bits, dim), 1 << np.arange(bits)
    kind = _ARROW[df.schema[name].dataType]
    schema = T.StructType([df.schema[name], T.StructField("t", T.IntegerType()), T.StructField("b", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
                signs = (values @ flat.T > 0).reshape(batch.num_rows, tables, bits)
                numbers = (signs * weights).sum(2).astype(np.int32).ravel()
                names = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), tables)))
                places = np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)
                yield pa.record_batch([names.cast(kind), pa.array(places), pa.array(numbers)], names=[name, "t", "b"])

    return df.where(F.col(vector).isNotNull()).select(name, vector).mapInArrow(run, schema)


def lsh_search(docs: DataFrame, queries: DataFrame, pool: int = 50, key: str = "sha", *, bits: int = 5, tables: int = 16) -> DataFrame:
    """Approximate cosine search: only documents that share a bucket with the query are scored.

    A bucket is the signs on `bits` fixed hyperplanes; more bits score fewer documents, more tables find more.
    Ids alone go through the join on (table, bucket), and each found pair is scored once. Vectors fetched for
    it meet the queries, which are broadcast up to a bound. Recall is measured against `dense_search`.
    """

    def unit(column: str):
        norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        return F.transform(column, lambda x: x.cast("double") / norm)

    first = queries.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
    planes = hyperplanes(tables, bits, first[0] if first else 1)
    wanted = broadcast_if_small(_buckets(queries, "query_id", "vector", planes))
    pairs = _buckets(docs, key, "embedding", planes).join(wanted, ["t", "b"]).select("query_id", key).distinct()
    stored = docs.where(F.col("embedding").isNotNull()).select(key, unit("embedding").alias("unit"))
    probe = broadcast_if_small(queries.select("query_id", unit("vector").alias("q_unit")))
    score = F.aggregate(F.zip_with("unit", "q_unit", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = stored.join(pairs, key).join(probe, "query_id").select("query_id", key, rounded(score).alias("score"))
    return top_k(scored, pool, ["query_id"], [F.desc("score"), F.col(key)])
