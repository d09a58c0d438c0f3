"""Shards by balanced label propagation.

Rows that share a group are linked. Every round joins the rows with their group's votes (bytes by shard) and
moves them towards the shard that has most of the group, under quotas: the room for linked rows below the
capacity, and what leaves a shard makes room there. Quotas are kept through a histogram of the moves by a hash, cut where the quota is
reached, so that nothing but (shards x shards x steps) sums reaches the driver. Groups move whole, as their
hash is the group's; a group larger than a share of a shard moves row by row. At the end, rows move from
shards above the mean to shards below it, unlinked rows first, until sizes are near equal.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.storage import drop_folder, new_folder

STEPS = 4096  # of the move hash; a quota is met to one step

ROW, GROUP, SIZE, SHARD = "__llm_row", "__llm_group", "__llm_size", "__llm_shard"


def _steps(key: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(STEPS)).cast("int")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _cuts(moves: DataFrame, quota: dict[tuple[int, int], float]) -> list[tuple[int, int, int]]:
    """(from, to, cut): rows whose step is below the cut move."""
    sums: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for source, target, step, size in moves.groupBy(SHARD, "__llm_to", "__llm_step").agg(F.sum(SIZE)).collect():  # bounded: shards^2 x STEPS
        sums[source, target][step] = size
    cuts = []
    for pair, by_step in sums.items():
        left, cut = quota.get(pair, 0), 0
        for step in sorted(by_step):
            if by_step[step] > left:
                break
            left -= by_step[step]
            cut = step + 1
        if cut:
            cuts.append((*pair, cut))
    return cuts


def _apply(moves: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    limit = F.lit(0)
    for source, target, cut in cuts:
        limit = F.when((F.col(SHARD) == source) & (F.col("__llm_to") == target), cut).otherwise(limit)
    return moves.withColumn(SHARD, F.when(F.coalesce(F.col("__llm_step") < limit, F.lit(False)), F.col("__llm_to")).otherwise(F.col(SHARD)))


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = dict(rows.groupBy(SHARD).agg(F.sum(SIZE)).collect())
    return [found.get(k, 0) or 0 for k in range(shards)]


def _quotas(demand: dict[tuple[int, int], int], loads: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """How much each pair may move: as if moves were made in turn, none of them beyond the capacity, until no more
    fits. What leaves a shard makes room there, so exchanges and longer cycles get through."""
    left, quota, now = dict(demand), defaultdict(float), list(loads)
    for _ in range(200):
        moved = 0.0
        for pair in sorted(left, key=lambda x: (-left[x], x)):
            size = min(left[pair], max(0.0, capacity - now[pair[1]]))
            left[pair] -= size
            quota[pair] += size
            now[pair[0]] -= size
            now[pair[1]] += size
            moved += size
        if moved <= 0:
            break
    return quota


def balanced_labels(rows: DataFrame, shards: int, rounds: int = 8, slack: float = 0.02) -> DataFrame:
    """rows (ROW, GROUP, SIZE; GROUP null: unlinked) with SHARD, sizes of the shards near equal.

    A group is worth moving where it has more than one row; the copies of a hot group are split among shards
    where it is larger than a shard. No rows: no shards.
    """
    many = rows.where(F.col(GROUP).isNotNull()).groupBy(GROUP).agg(F.count("*").alias("__llm_n"), F.sum(SIZE).alias("__llm_bytes")).where("__llm_n > 1")
    total = rows.agg(F.sum(SIZE)).head()[0] or 0
    capacity = total / shards * (1 + slack)
    # Rows of a group too large to move at once have a step of their own.
    own = F.col("__llm_bytes").isNull() | (F.col("__llm_bytes") > capacity / 16)
    state = rows.join(many.drop("__llm_n"), GROUP, "left").withColumn("__llm_linked", F.col("__llm_bytes").isNotNull())
    state = state.withColumn("__llm_key", F.when(own, F.xxhash64(ROW)).otherwise(F.xxhash64(GROUP))).drop("__llm_bytes")
    state = state.withColumn(SHARD, F.pmod(F.xxhash64(F.lit("first"), ROW), F.lit(shards)).cast("int"))
    state, path = _write(state, "shard-state")
    for turn in range(rounds):
        votes = state.where("__llm_linked").groupBy(GROUP, SHARD).agg(F.sum(SIZE).alias("__llm_votes"))
        # The fullest shard of the group; of equally full ones that of a hash, so that no shard is preferred.
        goal = votes.groupBy(GROUP).agg(F.max_by(SHARD, F.struct("__llm_votes", F.xxhash64(GROUP, SHARD))).alias("__llm_to"))
        moves = state.join(goal, GROUP, "left").withColumn("__llm_step", _steps(F.col("__llm_key"), f"round{turn}"))
        wanted = moves.where(F.col("__llm_to") != F.col(SHARD))
        demand = {(a, b): size for a, b, size in wanted.groupBy(SHARD, "__llm_to").agg(F.sum(SIZE)).collect()}
        if not demand:
            break
        # Unlinked rows can go anywhere later on, so only linked ones take room now.
        cuts = _cuts(wanted, _quotas(demand, _loads(state.where("__llm_linked"), shards), capacity))
        if not cuts:
            break
        old = path
        state, path = _write(_apply(moves, cuts).select(*state.columns), "shard-state")
        drop_folder(rows.sparkSession, old)
    for only_free in (True, False):
        loads = _loads(state, shards)
        mean = total / shards
        over, under = [max(0.0, x - mean) for x in loads], [max(0.0, mean - x) for x in loads]
        if sum(over) <= 0:
            break
        # Each source deals its surplus to the targets in proportion to what they lack.
        target = F.lit(None).cast("int")
        edge, share = 0.0, F.pmod(F.xxhash64(F.lit("to"), "__llm_key"), F.lit(1 << 20)) / float(1 << 20)
        for k, lack in enumerate(under):
            edge += lack / sum(under)
            target = F.coalesce(target, F.when(F.lit(lack > 0) & (share < edge), k))
        if only_free:
            target = F.when(~F.col("__llm_linked"), target)
        moves = state.withColumn("__llm_to", target).withColumn("__llm_step", _steps(F.col("__llm_key"), f"level{only_free}"))
        wanted = moves.where(F.col("__llm_to").isNotNull() & F.col(SHARD).isin([k for k, x in enumerate(over) if x > 0]))
        quota = {(a, b): over[a] * under[b] / sum(under) for a in range(shards) for b in range(shards)}
        old = path
        state, path = _write(_apply(moves, _cuts(wanted, quota)).select(*state.columns), "shard-state")
        drop_folder(rows.sparkSession, old)
    return state.drop("__llm_linked", "__llm_key")


def with_slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """placed with __llm_slot, gapless from 0 in every shard.

    Rows are numbered in many small parts of a shard and moved by the counts of the parts before.
    """
    spark = placed.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.withColumn("__llm_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = placed.groupBy(SHARD, "__llm_part").count().collect()  # bounded: shards x parts
    begin, offsets = defaultdict(int), []
    for shard, part, n in sorted(counts):
        offsets.append((shard, part, begin[shard]))
        begin[shard] += n
    table = spark.createDataFrame(offsets, f"{SHARD} int, __llm_part int, __llm_begin long")
    number = F.row_number().over(Window.partitionBy(SHARD, "__llm_part").orderBy(*order))
    return placed.withColumn("__llm_number", number).join(F.broadcast(table), [SHARD, "__llm_part"]).withColumn("__llm_slot", F.col("__llm_begin") + F.col("__llm_number") - 1).drop("__llm_part", "__llm_number", "__llm_begin")
