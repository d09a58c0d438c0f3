"""Parquet tables that grow by numbered batches and are rewritten by versions.

`<table>/v000001/` holds the current rows, partitioned; an append takes the next
free batch number and lands in `batch=` partitions of its own. A replay key names
a batch instead: writing under the same key again replaces exactly that batch.
A rewrite goes to the next version folder and counts from the moment Spark has
committed it, so no job reads and overwrites the same path; versions before the
last one are then removed.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions.bounds import broadcast_if_small
from patchlake.session import drop_path, staged_once

# Fixed value: 256 shards of hexadecimal ids.
SHARD_CHARS = 2
# Values of a list that a scan tests against the statistics of its row groups and pages.
MAX_PUSHED = 10_000
# Values that Spark hands to Parquet as one chain of comparisons; a chain of thousands overflows the stack.
MAX_CHAIN = 256
# Bytes of a row group, and bytes and rows of a page, of a clustered table: a scan skips these units.
ROW_GROUP, PAGE, PAGE_ROWS = 8 << 20, 128 << 10, 256


def pushed_lists(spark: SparkSession) -> None:
    """Lets lists of up to MAX_CHAIN values reach the row groups and pages whole; `one_of` makes longer ones of these."""
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(MAX_CHAIN))


def one_of(column: str, values: list) -> Column:
    """True for the values of a list, as a balanced tree of short lists that reaches the scan at any length."""
    ordered = sorted(value for value in values if value is not None)
    tests = [F.col(column).isin(ordered[i : i + MAX_CHAIN]) for i in range(0, len(ordered), MAX_CHAIN)] or [F.lit(False)]
    while len(tests) > 1:
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of at most MAX_PUSHED values; the whole list reaches the scan, so that row groups
    and pages of a clustered table without any of them stay unread."""
    if len(values) > MAX_PUSHED:
        raise ValueError(f"more than {MAX_PUSHED} values")
    pushed_lists(df.sparkSession)
    return df.where(one_of(column, values))


class Table:
    """With `cluster`, the rows of every file lie sorted by these columns, in small row groups."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: tuple[str, ...] = (), cluster: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.by, self.cluster = spark, path.rstrip("/"), schema, by, cluster

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if n[:1] == "v" and n[1:].isdigit())

    def _folder(self, version: int) -> str:
        return f"{self.path}/v{version:06d}"

    @property
    def _stored_schema(self) -> T.StructType:
        known = set(self.schema.fieldNames())
        extra = [T.StructField(name, T.StringType()) for name in self.by if name not in known]
        return T.StructType([*self.schema.fields, *extra, T.StructField("batch", T.LongType())])

    def read(self) -> DataFrame:
        """Current rows with the partition columns (`batch` among them)."""
        versions = self._versions()
        if not versions:
            # Without rows to send, and so without a job that starts Python on every core.
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._stored_schema.fields]
            return self.spark.range(0).where(F.lit(False)).select(*nothing)
        return self.spark.read.schema(self._stored_schema).parquet(self._folder(versions[-1]))

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        by = [*self.by, "batch"]
        for field in self.schema.fields:
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
        # Rebalancing splits a hot partition over several tasks and files.
        placed = rows.select(*self._stored_schema.fieldNames()).hint("rebalance", *[F.col(c) for c in by])
        if self.cluster:
            placed = placed.sortWithinPartitions(*by, *self.cluster)
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", mode)
        if self.cluster:
            writer = writer.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS)
        writer.partitionBy(*by).parquet(self._folder(version))

    def next_batch(self) -> int:
        """The next free number; replay keys have negative ones."""
        return max([-1, *self.batches()]) + 1

    def batches(self) -> list[int]:
        """Numbers of the batches that have rows."""
        # Named by the folders of the files, so no job reads the footers of all of them.
        return sorted({int(n) for path in Table.read(self).inputFiles() for n in re.findall(r"/batch=(-?\d+)/", path)})

    def keep(self, numbers: list[int]) -> None:
        """Removes all other batches; for tables that are partitioned by batch alone."""
        if self.by:
            raise ValueError("the table has other partition columns")
        for batch in set(self.batches()) - set(numbers):
            drop_path(self.spark, f"{self._folder(self._versions()[-1])}/batch={batch}")

    def append(self, rows: DataFrame, replay: str | None = None, number: int | None = None) -> int:
        """Add a batch and return its number; a batch of the same replay key, or of the number given, is replaced."""
        versions = self._versions()
        batch = number if number is not None else self.next_batch() if replay is None else replay_number(replay)
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
        # The first batch commits the version folder, later ones their partitions.
        if versions:
            self._write(rows, versions[-1], "dynamic")
        else:
            self._write(rows, 1, "static")
        return batch

    def without(self, replay: str | None) -> DataFrame:
        """Current rows but those of a replay key: what was there before it."""
        rows = self.read()
        return rows if replay is None else rows.where(F.col("batch") != replay_number(replay))

    def rewrite(self, rows: DataFrame) -> None:
        """Replace all rows, for compaction; versions before the last one are removed."""
        versions = self._versions()
        batch = self.next_batch()
        self._write(rows.withColumn("batch", F.lit(batch).cast("long")), max(versions, default=0) + 1, "static")
        for old in versions[:-1]:
            drop_path(self.spark, self._folder(old))


class KeyedTable(Table):
    """A table with one row per key: new rows are appended, changed ones lie beside it until they are folded in.

    A change is a row of the `refreshed` columns with a sequence number, in a table of its own; reading takes the
    last of each key. Nothing is overwritten in place, and a change costs what it brings, wherever the old rows
    lie. A refreshed column that a change lacks becomes null. `fold` writes the changes into the rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, refreshed: tuple[str, ...], by: tuple[str, ...] = (), cluster: tuple[str, ...] = (), key: str = "sha"):
        super().__init__(spark, path, schema, by, cluster)
        self.key, self.refreshed = key, tuple(c for c in refreshed if c in schema.fieldNames())
        fields = [schema[key], *[schema[c] for c in self.refreshed], T.StructField("seq", T.LongType())]
        self.changes = Table(spark, f"{path}-changes", T.StructType(fields), cluster=(key,))

    def read(self) -> DataFrame:
        return self._resolved(super().read(), self.changes.read() if self.changes.batches() else None)

    def without(self, replay: str | None) -> DataFrame:
        if replay is None:
            return self.read()
        own = F.col("batch") != replay_number(replay)
        return self._resolved(super().read().where(own), self.changes.read().where(own) if self.changes.batches() else None)

    def _resolved(self, rows: DataFrame, changes: DataFrame | None) -> DataFrame:
        """Rows with the last change of their key. Only changed rows are joined; the others pass through."""
        if changes is None:
            return rows
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*self.refreshed), "seq").alias("last"))
        keys = broadcast_if_small(changes.select(self.key).distinct())
        kept = [c for c in rows.columns if c not in self.refreshed]
        old = rows.select(*kept).join(keys, self.key, "left_semi").join(last, self.key)
        changed = old.select(*[F.col(f"last.{c}").alias(c) if c in self.refreshed else F.col(c) for c in rows.columns])
        return rows.join(keys, self.key, "left_anti").unionByName(changed)

    def upsert(self, rows: DataFrame, replay: str | None = None) -> None:
        """Rows with unique keys: known keys are changed, new ones appended with the time in `indexed_at`."""
        stored = super().read()
        if replay is not None:
            stored = stored.where(F.col("batch") != replay_number(replay))
        keys = rows.select(self.key)
        known = stored.select(self.key).join(broadcast_if_small(keys), self.key, "left_semi")
        with staged_once(known, "known") as known:
            known = broadcast_if_small(known)
            changed = rows.join(known, self.key, "left_semi")
            if not known.isEmpty():
                last = self.changes.read().agg(F.max("seq")).first()[0]
                number = F.lit(0 if last is None else last + 1).cast("long")
                self.changes.append(changed.select(self.key, *[c for c in self.refreshed if c in rows.columns]).withColumn("seq", number), replay)
            fresh = rows.join(known, self.key, "left_anti")
            if not fresh.isEmpty():
                self.append(fresh, replay)

    def fold(self) -> None:
        """All rows as one batch with their changes. Between the two steps changes are applied twice, to no effect."""
        self.rewrite(self.read().drop("batch"))
        if self.changes.batches():
            self.changes.keep([])


def replay_number(key: str) -> int:
    """A negative number of 62 bits that stands for a replay key."""
    return -1 - int(hashlib.sha256(key.encode()).hexdigest()[:15], 16)


def with_shard(rows: DataFrame, key: str = "sha") -> DataFrame:
    """First characters of the id as a partition column: hydration joins read
    only the shards that hold a hit."""
    return rows.withColumn("shard", F.substring(F.col(key), 1, SHARD_CHARS))
