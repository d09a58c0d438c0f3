"""Keyed table maintenance: resume, upsert, vector fill, pending work, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions import text as X
from patchlake.functions.bounds import MAX_BROADCAST_ROWS, keys_if_few

# Columns a conflicting row refreshes; all others keep their first value.
REFRESHED = ("source", "subject", "body", "modules", "files", "n_files", "diff_text", "doc_text")
# Fixed value: characters per token in size estimates.
CHARS_PER_TOKEN = 4


def new_rows(incoming: DataFrame, stored: DataFrame, source: str | None = None, key: str = "sha") -> DataFrame:
    """Incoming rows whose key is not stored yet (for one source, or at all)."""
    done = stored.where(F.col("source") == source) if source else stored
    return incoming.join(done.select(key), key, "left_anti")


def new_wide_rows(incoming: DataFrame, stored: DataFrame, source: str | None = None, key: str = "sha", keys: DataFrame | None = None) -> DataFrame:
    """`new_rows` for rows that carry texts: decided on keys, so texts are not shuffled.

    A small batch probes the stored keys as a broadcast. A large one compares
    keys only, and when few are stored, or few are new, those are broadcast to pick the rows.
    `keys` are those of the incoming rows where they lie ready.
    """
    done = (stored.where(F.col("source") == source) if source else stored).select(key)
    keys = incoming.select(key) if keys is None else keys.select(key)
    batch = keys_if_few(keys, key, MAX_BROADCAST_ROWS)
    if batch is not None:
        known = done.join(F.broadcast(batch), key, "left_semi")
        return incoming.join(F.broadcast(known), key, "left_anti")
    known = keys_if_few(keys.join(done, key, "left_semi"), key, MAX_BROADCAST_ROWS)
    if known is not None:
        return incoming.join(F.broadcast(known), key, "left_anti")
    fresh = keys_if_few(keys.join(done, key, "left_anti"), key, MAX_BROADCAST_ROWS)
    if fresh is not None:
        return incoming.join(F.broadcast(fresh), key, "left_semi")
    return incoming.join(done, key, "left_anti")


def distinct_wide_rows(rows: DataFrame, key: str = "sha") -> DataFrame:
    """One row per key, for rows that carry texts; copies of a key hold the same.

    Keys are counted first. Only rows whose key repeats are grouped, folding
    copies before the shuffle; all others stay where they are.
    """
    repeated = rows.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    few = keys_if_few(repeated, key, MAX_BROADCAST_ROWS)
    if few is None:
        return rows.dropDuplicates([key])
    once = rows.join(F.broadcast(few), key, "left_anti")
    return once.unionByName(rows.join(F.broadcast(few), key, "left_semi").dropDuplicates([key]))


def folded(rows: DataFrame, arrival: str, refreshed: tuple[str, ...] = REFRESHED, key: str = "sha") -> DataFrame:
    """One row per key, as if the rows were upserted in order of arrival; arrival is dropped.

    The last copy gives the refreshed columns, the first one all others. Only rows whose key repeats are
    grouped, and copies fold together before the shuffle; all others stay where they are.
    """
    last = [c for c in rows.columns if c in refreshed]
    first = [c for c in rows.columns if c not in (*refreshed, key, arrival)]

    def fold(copies: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(*last), arrival).alias("newest")
        oldest = F.min_by(F.struct(*first), arrival).alias("oldest")
        grouped = copies.groupBy(key).agg(newest, oldest)
        return grouped.select(*[F.col(c if c == key else f"newest.{c}" if c in last else f"oldest.{c}").alias(c) for c in rows.columns if c != arrival])

    repeated = rows.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    few = keys_if_few(repeated, key, MAX_BROADCAST_ROWS)
    if few is None:
        return fold(rows)
    once = rows.join(F.broadcast(few), key, "left_anti").drop(arrival)
    return once.unionByName(fold(rows.join(F.broadcast(few), key, "left_semi")))


def resume_counts(incoming: DataFrame, stored: DataFrame, source: str | None = None, key: str = "sha") -> DataFrame:
    """(kept, skipped) of a resumed run as one row."""
    done = stored.where(F.col("source") == source) if source else stored
    seen = incoming.select(key).join(done.select(key, F.lit(True).alias("seen")).distinct(), key, "left")
    return seen.agg(
        F.count_if(F.col("seen").isNull()).alias("kept"), F.count_if(F.col("seen").isNotNull()).alias("skipped")
    )


def last_per_key(updates: DataFrame, arrival: str, key: str = "sha") -> DataFrame:
    """The last arriving row of each key.

    An aggregate, not a window: copies of a key fold together before the
    shuffle, so a key that holds a third of all rows sends one row per task.
    """
    payload = F.struct(*[c for c in updates.columns if c not in (key, arrival)])
    return updates.groupBy(key).agg(F.max_by(payload, arrival).alias("row")).select(key, "row.*")


def upsert(
    stored: DataFrame,
    updates: DataFrame,
    now: Column,
    *,
    refreshed: tuple[str, ...] = REFRESHED,
    refresh_tag: bool = False,
    clear_stale_vectors: bool = False,
    key: str = "sha",
) -> DataFrame:
    """`stored` after the updates (unique by key).

    A known key refreshes only `refreshed` (a new NULL overwrites); a new key
    inserts the whole row. `stored` may be just the partitions that hold a known
    key; they meet the updates in a full outer join.
    """
    if refresh_tag:
        refreshed = (*refreshed, "tag")
    columns = [c for c in stored.columns if c != key]
    types = {f.name: f.dataType for f in stored.schema}

    def incoming(name: str) -> Column:
        if name == "indexed_at":
            return now
        if name in updates.columns:
            return F.col(f"new.{name}").cast(types[name])
        return F.lit(None).cast(types[name])

    def updated(name: str) -> Column:
        if name == "embedding" and clear_stale_vectors:
            same_text = F.col("old.doc_text").eqNullSafe(F.col("new.doc_text"))
            return F.when(same_text, F.col("old.embedding"))
        return F.col(f"new.{name}") if name in refreshed and name in updates.columns else F.col(f"old.{name}")

    old = stored.withColumn("had", F.lit(True)).alias("old")
    new = updates.withColumn("got", F.lit(True)).alias("new")

    def merged(name: str) -> Column:
        kept = F.when(F.col("new.got"), updated(name)).otherwise(F.col(f"old.{name}"))
        return F.when(F.col("old.had"), kept).otherwise(incoming(name)).alias(name)

    return old.join(new, key, "full_outer").select(key, *[merged(c) for c in columns])


def fill_vectors(commits: DataFrame, vectors: DataFrame, key: str = "sha") -> DataFrame:
    """`commits` with the vectors of an append-only (key, embedding) table filled in."""
    found = vectors.select(key, F.col("embedding").alias("found"))
    joined = commits.join(found, key, "left")
    if "embedding" not in commits.columns:
        return joined.withColumnRenamed("found", "embedding")
    return joined.withColumn("embedding", F.coalesce("found", "embedding")).drop("found")


def pending(commits: DataFrame, limit: int | None = None, key: str = "sha") -> DataFrame:
    """Rows without a vector; with a limit, the oldest ones (undated last)."""
    waiting = commits.where(F.col("embedding").isNull())
    if limit is None:
        return waiting
    return waiting.orderBy(F.asc_nulls_last("committed_at"), key).limit(limit)


def corpus_stats(commits: DataFrame, price_per_million: float, *by: str) -> DataFrame:
    """Row, vector, fix and size counts with the token and cost estimate."""
    chars = F.coalesce(F.sum(F.length("doc_text")), F.lit(0))
    counts = commits.groupBy(*by).agg(
        F.count("*").alias("commits"),
        F.count("embedding").alias("embedded"),
        F.count_if(F.col("tag") == "FIX").alias("fixes"),
        chars.alias("chars"),
    )
    tokens = F.col("chars") / CHARS_PER_TOKEN
    return counts.withColumn("est_tokens", tokens).withColumn("est_cost", tokens / 1e6 * price_per_million)


def usage(batches: DataFrame, price_per_million: float) -> DataFrame:
    """Tokens and cost of embedded rows (a `tokens` column, as the embed job writes)."""
    total = F.coalesce(F.sum("tokens"), F.lit(0))
    return batches.agg(total.alias("tokens"), (total / 1e6 * price_per_million).alias("cost"))


def points(commits: DataFrame, source: str | None = None, key: str = "sha") -> DataFrame:
    """Embedded rows as (point id, vector, payload, text) for the search index."""
    rows = commits.where(F.col("embedding").isNotNull())
    if source:
        rows = rows.where(F.col("source") == source)
    payload = F.struct(
        F.col(key).alias("sha"),
        "source",
        "tag",
        "subject",
        "modules",
        "n_files",
        X.format_iso_time(F.col("authored_at")).alias("authored_at"),
        X.format_iso_time(F.col("committed_at")).alias("committed_at"),
    )
    return rows.select(
        X.point_id(F.col(key)).alias("point_id"),
        F.col("embedding").cast("array<float>").alias("dense"),
        payload.alias("payload"),
        "doc_text",
    )
