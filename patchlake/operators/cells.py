"""Approximate cosine search over vectors laid out by k-means cells.

The centers are fitted on all vectors, or on a sample of SAMPLE_ROWS by a hash of the key where there are more. Sums
are made of whole numbers, so a fit doesn't depend on how the vectors are spread. Vectors are stored in the
partition of their nearest center; a query reads the partitions of its nearest `probes` centers. How many those are
is measured: the fewest that hold the wanted share of the true neighbours of a set of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions.bounds import query_blocks, union_all
from patchlake.operators import filters
from patchlake.operators.dense import _ARROW, _unit_rows, dense_search
from patchlake.operators.ranking import SCORE_DIGITS, top_k

SAMPLE_ROWS = 1_000_000
ROUNDS = 8
SCALE = 1 << 20  # components of unit vectors are summed as multiples of its inverse
NOWHERE = -1  # the cell of vectors without a direction; every query probes it


@dataclass(frozen=True)
class Cells:
    """Stored vectors (key, embedding, cell and fields of filters), their centers, and how many a query probes."""

    vectors: DataFrame
    centers: np.ndarray
    probes: int


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    if not np.all(column.value_lengths().to_numpy() == dim):
        raise ValueError(f"every vector must have {dim} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(matrix: np.ndarray, centers: np.ndarray) -> np.ndarray:
    unit = _unit_rows(matrix)
    cells = np.argmax(np.round(unit * SCALE) @ centers.T, axis=1).astype(np.int32)
    cells[~unit.any(axis=1)] = NOWHERE
    return cells


def fit(vectors: DataFrame, n_cells: int, key: str = "sha", rounds: int = ROUNDS) -> np.ndarray:
    """(cells, dim) unit centers by Lloyd's rounds: each is one pass that sends a sum per task and cell.

    The first centers are the vectors whose keys have the smallest md5. A cell without vectors keeps its center;
    there are never more cells than vectors.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select(key, "embedding")
    n = rows.count()
    if n > SAMPLE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < SAMPLE_ROWS * (1 << 30) // n)
    first = rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n_cells).select("embedding").collect()
    if not first:
        return np.zeros((0, 1))
    centers = _unit_rows(np.array([r["embedding"] for r in first], dtype=np.float64))
    dim = centers.shape[1]
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            centers = shared.value
            sums = np.zeros(centers.shape, dtype=np.int64)
            for batch in batches:
                matrix = _matrix(batch.column(0), dim)
                cells = _nearest(matrix, centers)
                moved = cells >= 0
                np.add.at(sums, cells[moved], np.round(_unit_rows(matrix[moved]) * SCALE).astype(np.int64))
            used = np.flatnonzero(sums.any(axis=1)).astype(np.int32)
            yield pa.record_batch([pa.array(np.repeat(used, dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(used))), pa.array(sums[used].ravel())], names=["cell", "i", "x"])

        sums = np.zeros(centers.shape)
        for cell, i, x in rows.select("embedding").mapInArrow(run, "cell int, i int, x long").groupBy("cell", "i").agg(F.sum("x")).collect():  # one row per component of the centers
            sums[cell, i] = x
        moved = sums.any(axis=1)
        centers[moved] = _unit_rows(sums[moved])
    return centers


def placed(vectors: DataFrame, centers: np.ndarray, key: str = "sha") -> DataFrame:
    """(key, embedding, fields of filters that exist, cell) of all vectors."""
    fields = [f for f in ("modules", "tag", "source") if f in vectors.columns]
    rows = vectors.where(F.col("embedding").isNotNull()).select(key, "embedding", *fields)
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _nearest(_matrix(batch.column(1), shared.value.shape[1]), shared.value)
            yield pa.record_batch([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def probed(queries: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each query all cells, the nearest center first; equal ones by number."""
    return np.argsort(-np.round(_unit_rows(queries) @ centers.T, SCORE_DIGITS), axis=1, kind="stable")


def measured_probes(vectors: DataFrame, centers: np.ndarray, queries: DataFrame, k: int = 10, target: float = 0.9, key: str = "sha") -> int:
    """The fewest probes that find the share `target` of the exact k nearest of the queries (query_id, vector).

    One exact search and the cells of its hits; the queries are a bounded set.
    """
    if not len(centers):
        return 0
    hits = dense_search(vectors, queries.select("query_id", "vector"), k, key).select("query_id", key)
    cells = vectors.select(key, "cell").join(F.broadcast(hits), key).select("query_id", "cell").collect()  # queries x k
    wanted = {r["query_id"]: r["vector"] for r in queries.where(F.col("vector").isNotNull()).select("query_id", "vector").collect()}
    ids = list(wanted)
    if not cells:
        return 1
    order = probed(np.array([wanted[i] for i in ids], dtype=np.float64), centers)
    place = {i: {int(cell): p for p, cell in enumerate(row)} for i, row in zip(ids, order, strict=True)}
    depth = np.sort([place[r["query_id"]].get(r["cell"], 0) for r in cells])
    return int(depth[int(np.ceil(target * len(depth))) - 1]) + 1


def search(cells: Cells, queries: DataFrame, pool: int = 50, key: str = "sha") -> DataFrame:
    """Approximate `dense_search`: only vectors in the probed cells of a query are scored for it, filters applied
    first. Partitions that no query of a block probes stay unread; scores are exact."""
    active = [f for f in filters.FIELDS if f in queries.columns]
    vectors, centers, spark = cells.vectors, cells.centers, queries.sparkSession
    id_type, key_type = queries.schema["query_id"].dataType, vectors.schema[key].dataType
    out = T.StructType([T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("score", T.DoubleType())])
    passes = []
    for block in query_blocks(queries):
        rows = block.where(F.col("vector").isNotNull()).select("query_id", "vector", *active).collect()
        if not rows or not len(centers):
            continue
        matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
        order = probed(matrix, centers)[:, : cells.probes]
        by_cell = {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)} | {NOWHERE: np.arange(len(rows))}
        combos = [tuple(r[f] or None if f in active else None for f in filters.FIELDS) for r in rows]
        distinct = list(dict.fromkeys(combos))
        lane = np.array([distinct.index(c) for c in combos])
        tests = [filters.literal_filter(*c) for c in distinct]
        flags = F.array(*[F.lit(True) if t is None else F.coalesce(t, F.lit(False)) for t in tests])
        scan = vectors.where(F.col("cell").isin(sorted(by_cell))).select(key, "embedding", "cell", flags.alias("allowed"))
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), _unit_rows(matrix), by_cell, lane))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, wanted, by_cell, lane = shared.value
            for batch in batches:
                unit = _unit_rows(_matrix(batch.column(1), wanted.shape[1]))
                cell = batch.column(2).to_numpy()
                allowed = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(batch.num_rows, -1)
                for c in np.unique(cell).tolist():
                    at, asked = np.flatnonzero(cell == c), by_cell[c]
                    scores = np.round(unit[at] @ wanted[asked].T, SCORE_DIGITS)
                    scores[~allowed[at][:, lane[asked]]] = -np.inf
                    bar = np.partition(scores, len(at) - pool, axis=0)[len(at) - pool] if len(at) > pool else -np.inf
                    r, q = np.nonzero((scores >= bar) & (scores > -np.inf))
                    if len(r):
                        keys = batch.column(0).take(pa.array(at[r])).cast(_ARROW[key_type])
                        yield pa.record_batch([pa.array(ids[asked[q]], _ARROW[id_type]), keys, pa.array(scores[r, q])], names=["query_id", key, "score"])

        passes.append(scan.mapInArrow(run, out))
    if not passes:
        return spark.createDataFrame([], out.add("rank", T.IntegerType()))
    return top_k(union_all(passes), pool, ["query_id"], [F.desc("score"), F.col(key)])
