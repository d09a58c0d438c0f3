"""Incremental ingest: the batch jobs run per micro-batch of a growing log folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchlake.functions.rules import Rules
from patchlake.operators import embed
from patchlake.plans.jobs import Corpus
from patchlake.sources.changelog import batch_arrival, parse_records, stream_log


def stream_commits(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parsed commits of the files that have not been read yet."""
    return parse_records(stream_log(spark, path, max_files))


# The state store with bounded memory, which writes what a batch changes and not the whole state.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def state_on_disk(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in files; the default keeps all of it in the executors' heap.
    A stream that goes on from a checkpoint stays with the store it began with."""
    for name, value in DISK_STATE.items():
        spark.conf.set(name, value)


def distinct_commits(commits: DataFrame, delay: str) -> DataFrame:
    """First copy of each commit, where copies are read within `delay` of each other.

    The watermark bounds the state. It runs on the time of reading, so a log in any order of dates loses
    nothing; copies further apart pass, and the stored-id check of the sink catches them. The state lies on disk
    (`state_on_disk`), since it holds every id that was read within the delay.
    """
    state_on_disk(commits.sparkSession)
    dated = commits.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", delay)
    return dated.dropDuplicatesWithinWatermark(["sha"]).drop("seen_at")


def ingest(
    corpus: Corpus,
    commits: DataFrame,
    rules: Rules,
    source: str | None,
    checkpoint: str,
    *,
    resume: bool = True,
    embedder: embed.Embedder | None = None,
) -> StreamingQuery:
    """Store (and embed) each micro-batch durably; a replayed batch replaces itself.

    With `resume` stored ids are skipped and new rows appended; without it each
    batch is upserted, which repeats without effect because rows are keyed.
    Copies of an id within a batch fold in order of arrival: by file name, then
    by place in the file.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        # The checkpoint is part of the key: a new one starts from 0 again and must not meet old batches.
        replay = f"{checkpoint}/{batch_id}"
        if "arrival" in batch.columns:
            batch = batch_arrival(batch)
        corpus.build(batch, rules, source, replay=replay, resume=resume)
        if embedder is not None:
            corpus.embed(embedder, replay=replay)

    return (
        commits.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
