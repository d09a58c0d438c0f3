"""Size checks in front of every broadcast, and query tables cut into blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# A broadcast side may hold this many narrow rows; beyond it the join shuffles
# and AQE splits what is skewed.
MAX_BROADCAST_ROWS = 100_000
# Groups of an aggregate, and queries of one pass, that may come to the driver.
MAX_GROUPS = 10_000
MAX_QUERY_BLOCK = 2_048


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows. Partitions are read a few at
    a time and reading stops as soon as the answer is known."""
    return len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


def settled_or_none(df: DataFrame, max_rows: int) -> DataFrame | None:
    """Run `df` once: its rows as a local table, or None when there are too many."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def settled(df: DataFrame, max_rows: int = 2 * MAX_BROADCAST_ROWS) -> DataFrame:
    """Run a result whose size its inputs bound, as a local table."""
    table = settled_or_none(df, max_rows)
    if table is None:
        raise ValueError(f"more than {max_rows} rows where a bounded result was expected")
    return table


def settled_if_small(df: DataFrame, max_rows: int = MAX_GROUPS) -> DataFrame:
    """A small result as a broadcast table, a large one unchanged.

    For aggregates with few groups, where counting first would run them twice.
    """
    table = settled_or_none(df, max_rows)
    return df if table is None else F.broadcast(table)


def keys_if_few(df: DataFrame, key: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """The `key` column of `df` as a local table, or None when there are too many.

    Reading stops once there are; a huge `df` with many rows costs little.
    """
    rows = df.select(key).take(max_rows + 1)
    if len(rows) > max_rows:
        return None
    table = pa.table({key: pa.array([r[0] for r in rows], to_arrow_type(df.schema[key].dataType))})
    return df.sparkSession.createDataFrame(table)


def query_blocks(queries: DataFrame, max_rows: int = MAX_QUERY_BLOCK) -> list[DataFrame]:
    """The query table as pieces of about `max_rows` rows, one pass each.

    The usual small table is computed once and becomes local. A large one is cut
    into hash slices of the query ids, so no query is lost or repeated.
    """
    table = settled_or_none(queries, max_rows)
    if table is not None:
        return [table]
    n = -(-queries.count() * 2 // max_rows)
    slot = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return [queries.where(slot == i) for i in range(n)]


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
