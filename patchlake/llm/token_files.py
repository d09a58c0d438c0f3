"""Token files: ids of documents in ascending order, in independent range-coded blocks.

A file set is a folder with `blocks` (Parquet, one row per block: place in the whole sequence of ids, the
documents or parts of documents in it, the coded ids with checkpoints and checksums) and `frequencies` (the
shared table). Blocks hold whole documents up to BLOCK ids; a longer document goes through blocks of its own.
Any block decodes alone, given the table; a range of documents is a range of blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm.bpe import Encoder, encoder_state, load_vocabulary, text_slices
from patchlake.llm.rans import Coder, crc32_of_both, scaled
from patchlake.llm.storage import drop_folder, new_folder

BLOCK = 1 << 17
RAW = "doc_id long, part int, place long, n long, ids binary"
BLOCKS = "part int, first long, n_tokens long, doc_ids array<long>, doc_starts array<long>, starts array<long>, lengths array<long>, totals array<long>, payload binary"


def encode_sorted(docs: DataFrame, path: str, end_id: int, parts: int) -> DataFrame:
    """(doc_id, part, place, n, ids): ids of every whole text and the end id, in ascending doc_id order.

    part counts the ranges of doc_id, place the ids before it in its range. Ids are 16 bits wide where the
    vocabulary allows. A null text counts as empty; rows without doc_id come first. One more row of each part,
    with place -1 and n 0, holds how often each id occurs in it.
    """
    n_tokens = len(load_vocabulary(path).tokens)
    tables = docs.sparkSession.sparkContext.broadcast(encoder_state(path))  # bounded by the vocabulary
    kind = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.restore(tables.value)
        part, place = TaskContext.get().partitionId(), 0
        total = np.zeros(n_tokens, dtype="<i8")
        for batch in batches:
            for begin, stop, texts in text_slices(batch.column(1)):
                flat, counts = encoder.encode(texts)
                flat = np.insert(flat, counts.cumsum(), np.uint32(end_id)).astype(kind)
                total += np.bincount(flat, minlength=n_tokens)
                counts = counts + 1
                ends = counts.cumsum()
                raw = flat.tobytes()
                width = flat.itemsize
                ids = [raw[width * a : width * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []
                yield pa.record_batch(
                    [batch.column(0).slice(begin, stop - begin), pa.array(np.full(len(counts), part), pa.int32()), pa.array(place + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=[x.split()[0] for x in RAW.split(", ")],
                )
                place += int(ends[-1]) if len(ends) else 0
        if place:
            row = [None, part, -1, 0, zlib.compress(total.tobytes(), 1)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in RAW.split(", ")])

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"]).repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    return rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, RAW)


def id_type(path: str) -> str:
    return "<u2" if len(load_vocabulary(path).tokens) <= 1 << 16 else "<u4"


def _counts(raw: DataFrame, n_tokens: int) -> np.ndarray:
    """How often each id occurs in all documents: the sum of what the tasks have counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_tokens, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(packed), dtype="<i8")
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(n_tokens, dtype=np.int64)
    sums = raw.where(F.col("place") < 0).select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n"))
    for token, n in sums.collect():  # bounded by the vocabulary
        out[token] = n
    return out


def write(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    """Writes the ids of all documents as a file set below folder."""
    spark = docs.sparkSession
    n_tokens, kind = len(load_vocabulary(path).tokens), id_type(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stage = new_folder(spark, "token-ids")
    encode_sorted(docs, path, end_id, parts).write.parquet(stage)
    raw = spark.read.schema(RAW).parquet(stage)
    sums = sorted(raw.groupBy("part").agg(F.sum("n")).collect())  # bounded: one row per range
    begins = dict(zip([part for part, _ in sums], np.concatenate([[0], np.cumsum([n for _, n in sums])]).tolist(), strict=False))
    frequencies = scaled(_counts(raw, n_tokens))
    table = [(int(x), int(frequencies[x])) for x in np.flatnonzero(frequencies)]
    spark.createDataFrame(table, "id int, frequency int").coalesce(1).write.parquet(f"{folder}/frequencies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        waiting: list[tuple[int | None, int, int, int, np.ndarray]] = []  # doc_id, its start, start, total, ids
        size, of = 0, None

        def block() -> pa.RecordBatch:
            tokens = np.concatenate([x for *_, x in waiting])
            row = [of, waiting[0][2], len(tokens), *([x[k] for x in waiting] for k in (0, 1, 2)), [len(x[4]) for x in waiting], [x[3] for x in waiting], coder.encode(tokens)]
            waiting.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5, pa.binary()]
            return pa.record_batch([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, part, place, n, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if waiting and (part != of or size + n > BLOCK or waiting[-1][2] + len(waiting[-1][4]) != begins[part] + place):
                    yield block()
                    size = 0
                of, tokens, whole = part, np.frombuffer(ids, dtype=kind), begins[part] + place
                start = whole
                while len(tokens) > BLOCK:
                    waiting.append((doc_id, whole, start, n, tokens[:BLOCK]))
                    yield block()
                    start, tokens = start + BLOCK, tokens[BLOCK:]
                waiting.append((doc_id, whole, start, n, tokens))
                size += len(tokens)
        if waiting:
            yield block()

    raw.where(F.col("place") >= 0).mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")
    drop_folder(spark, stage)


def frequencies_of(spark: SparkSession, folder: str, n_tokens: int) -> np.ndarray:
    out = np.zeros(n_tokens, dtype=np.int64)
    for token, frequency in spark.read.parquet(f"{folder}/frequencies").collect():  # bounded by the vocabulary
        out[token] = frequency
    return out


PIECES = "doc_id long, doc_start long, start long, n long, total long"


def read_pieces(spark: SparkSession, folder: str, n_tokens: int, digest: bool = False) -> DataFrame:
    """One row per document and block: doc_id, doc_start (ids of all documents before it), start, n, total (ids of
    the whole document), and the ids as little-endian 32-bit integers, or their CRC-32 with digest."""
    frequencies = frequencies_of(spark, folder, n_tokens)
    names = [x.split()[0] for x in PIECES.split(", ")] + ["crc" if digest else "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for *columns, payload in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                raw = memoryview(coder.decode(payload).astype("<u4").tobytes())
                ends = np.cumsum(columns[3]).tolist()
                own = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digest else pa.array([bytes(x) for x in own], pa.binary())
                yield pa.record_batch([*(pa.array(x, pa.int64()) for x in columns), last], names=names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("doc_ids", "doc_starts", "starts", "lengths", "totals", "payload")
    return blocks.mapInArrow(run, f"{PIECES}, {names[-1]} {'long' if digest else 'binary'}")


def document_digests(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from read_pieces(digest=True).

    The checksums of a document that lies in several blocks are combined; its parts are few numbers each.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column(3).to_pylist():
                parts.sort(key=lambda x: x["start"])
                crc = parts[0]["crc"]
                for x in parts[1:]:
                    crc = crc32_of_both(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.record_batch([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    whole = pieces.groupBy("doc_id", "doc_start", "total").agg(F.collect_list(F.struct("start", "n", "crc")).alias("parts"))
    return whole.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")
