"""Document and query embedding through a caller-supplied batch function."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake import schemas
from patchlake.functions import text as X
from patchlake.functions.words import ascii_words

# Limits of one request, tries and first wait in seconds.
BATCH_DOCS, BATCH_CHARS = 128, 400_000
TRIES, FIRST_WAIT = 6, 1.0
# Terms whose cells the built-in embedder remembers.
MAX_CELLS = 1_000_000

# texts -> (one vector per text, tokens used)
Embedder = Callable[[list[str]], tuple[np.ndarray, int]]


def pack(sizes, max_docs: int = BATCH_DOCS, max_chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Greedy (start, end) ranges: a range ends when it is full or the next text would not fit."""
    start = chars = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= max_docs or chars + size > max_chars):
            yield start, i
            start, chars = i, 0
        chars += size
    if start < len(sizes):
        yield start, len(sizes)


def with_retry(embed: Embedder, texts: list[str], tries: int = TRIES, wait: float = FIRST_WAIT):
    """Call `embed`, waiting 1, 2, 4, ... seconds after a failure; the last failure is raised."""
    for attempt in range(tries):
        try:
            return embed(texts)
        except Exception as err:
            if attempt == tries - 1:
                raise RuntimeError(f"no vectors after {tries} tries") from err
            time.sleep(wait * 2**attempt)


def embed_documents(
    docs: DataFrame,
    embed: Embedder,
    *,
    max_docs: int = BATCH_DOCS,
    max_chars: int = BATCH_CHARS,
    tries: int = TRIES,
    wait: float = FIRST_WAIT,
) -> DataFrame:
    """(sha, embedding, tokens) of (sha, doc_text) rows, batched inside each task.

    A request's token count is booked on its first row, so `sum(tokens)` is
    exact. Keys travel with their texts; nothing depends on row order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["doc_text"].fillna("").tolist()
            for start, end in pack([len(t) for t in texts], max_docs, max_chars):
                vectors, tokens = with_retry(embed, texts[start:end], tries, wait)
                used = np.zeros(end - start, dtype=np.int64)
                used[0] = tokens
                rows = np.asarray(vectors, dtype=np.float32)
                yield pd.DataFrame({"sha": frame["sha"].iloc[start:end], "embedding": list(rows), "tokens": used})

    return docs.select("sha", "doc_text").mapInPandas(run, schemas.EMBEDDINGS)


def embed_queries(queries: DataFrame, embed: Embedder) -> DataFrame:
    """Query rows with a `vector`; a failing call is not retried."""
    out = T.StructType([*queries.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors, _ = embed(frame["query"].fillna("").tolist())
                yield frame.assign(vector=list(np.asarray(vectors, dtype=np.float32)))

    return queries.mapInPandas(run, out)


def batch_numbers(docs: DataFrame, max_docs: int = BATCH_DOCS, max_chars: int = BATCH_CHARS) -> DataFrame:
    """(sha, n_chars, part, batch): how `embed_documents` would group the rows of each partition."""
    out = T.StructType.fromDDL("sha string, n_chars long, part int, batch int")
    rows = docs.select("sha", F.length("doc_text").cast("long").alias("n_chars"), F.spark_partition_id().alias("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = 0
        for frame in frames:
            numbers = np.empty(len(frame), dtype=np.int32)
            for start, end in pack(frame["n_chars"].tolist(), max_docs, max_chars):
                numbers[start:end] = batch
                batch += 1
            yield frame.assign(batch=numbers)

    return rows.mapInPandas(run, out)


# ---- built-in offline embedder ------------------------------------------------


def hash_bucket(term: str, dim: int) -> tuple[int, float]:
    """Bucket and sign of a term, from the first eight digits of its md5."""
    digest = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
    return digest // 2 % dim, 1.0 if digest % 2 else -1.0


def hashing_embedder(dim: int = 64) -> Embedder:
    """The same vectors as a batch function, for `embed_documents` and `embed_queries`."""

    cells: dict[str, tuple[int, float]] = {}

    def coded(terms: list[str]) -> list[tuple[int, float]]:
        if len(cells) > MAX_CELLS:
            cells.clear()
        for term in terms:
            if term not in cells:
                cells[term] = hash_bucket(term, dim)
        return [cells[term] for term in terms]

    def run(texts: list[str]) -> tuple[np.ndarray, int]:
        plain = np.array([i for i, text in enumerate(texts) if text.isascii()], dtype=np.int64)
        words, lengths = ascii_words(pa.array([texts[i] for i in plain], pa.string()))
        words, used = words.dictionary_encode(), int(lengths.sum())
        buckets = coded(words.dictionary.to_pylist())
        bucket, sign = np.array([b for b, _ in buckets], dtype=np.int64), np.array([s for _, s in buckets], dtype=np.float64)
        code, row = words.indices.to_numpy(zero_copy_only=False), np.repeat(plain, lengths)
        out = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=len(texts) * dim).astype(np.float64).reshape(len(texts), dim)
        for row, text in enumerate(texts):
            if text.isascii():
                continue
            terms = Counter(re.findall(r"[^\W_]+", text.lower()))
            used += sum(terms.values())
            for (cell, sign), count in zip(coded(list(terms)), terms.values(), strict=True):
                out[row, cell] += sign * count
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0), used

    return run


def hashed_vectors(docs: DataFrame, text: str = "doc_text", dim: int = 64, key: str = "sha") -> DataFrame:
    """(key, embedding): signed term counts hashed into `dim` cells, scaled to length 1.

    Tokens are cut in the JVM; the task adds the signs up, so no shuffle. A text
    without tokens gets no row.
    """
    key_type = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, key_type), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        import pyarrow as pa

        cells: dict[str, tuple[int, float]] = {}
        for batch in batches:
            tokens = batch.column(1)
            words = tokens.flatten().dictionary_encode()
            fresh = words.dictionary.to_pylist()
            if len(cells) > 1_000_000:
                cells.clear()
            for term in fresh:
                if term not in cells:
                    cells[term] = hash_bucket(term, dim)
            bucket = np.array([cells[t][0] for t in fresh], dtype=np.int64)
            sign = np.array([cells[t][1] for t in fresh])
            lengths = tokens.value_lengths().to_numpy()
            code = words.indices.to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            flat = np.bincount(row * dim + bucket[code], weights=sign[code], minlength=len(lengths) * dim)
            sums = flat.reshape(len(lengths), dim)
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0).astype(np.float32)
            offsets = np.arange(0, (len(lengths) + 1) * dim, dim, dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))
            rows = pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "embedding"])
            yield rows.filter(pa.array(lengths > 0))

    return docs.select(key, X.lexemes(F.col(text)).alias("tokens")).mapInArrow(run, out)
