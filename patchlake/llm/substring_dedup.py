"""Removal of repeated byte strings by two-stage suffix sorting of blocks.

A byte goes if a string of LENGTH bytes around it also starts earlier: in a document with a smaller id, or
earlier in the same one. Texts are too many for one suffix array, so blocks are made in which equal strings
meet: of the GRAM-byte grams in a string, the one with the least hash (the rightmost of equal ones) is its
anchor, which equal strings share at the same place. Anchors that occur once rule their strings out; each
other anchor sends the strings it belongs to to the block of the text where it occurs first. Neighbouring
strings with the same block go together as one passage. Each block is sorted, and common prefixes of neighbours
show the equal strings.

A block has at most BLOCK_BYTES. A text with more passages than that deals them by anchor to several blocks
(passages get shorter then); where one anchor alone has more, its strings are compared by a grouping on
the strings themselves, which Spark sums up before it shuffles and whose join it can split.

Equal texts count once: all copies but that with the smallest id go, if they have LENGTH bytes. Names of texts
are hashes that a digest confirms, so different texts never count as copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.bpe import text_slices
from patchlake.llm.memory import released
from patchlake.llm.ngram_join import mixed
from patchlake.llm.storage import staged
from patchlake.llm.suffix_sort import repeated_starts

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 3 << 20
SEPARATOR = b"\xff"  # in no UTF-8 text
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
BROADCAST_ROWS = 100_000
NO_ID = -(2**63)  # stands for a null doc_id
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbouring keys."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of every string of length bytes, in order of the strings."""
    n = len(text)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    view = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=text, strides=(1,)).astype(np.uint64)
    grams = n - GRAM + 1
    hashed = np.zeros(grams, dtype=np.uint64)
    for k, factor in enumerate(FACTORS):
        hashed += view[8 * k : 8 * k + grams] * np.uint64(factor)
    hashed = mixed(hashed)
    low = np.uint64((1 << 32) - 1)
    keys = (hashed & ~low) | (low - np.arange(grams, dtype=np.uint64))
    place = (low - (least_places(keys, length - GRAM + 1) & low)).astype(np.int64)
    return place, hashed[place]


def _first_copies(seen: set, names: list, texts: list) -> list[int]:
    """Rows whose text is new in this task."""
    out = []
    for k, name in enumerate(names):
        if texts[k] is not None and name not in seen:
            seen.add(name)
            out.append(k)
    return out


def repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """(text_id, place, home) of anchors that occur more than once; home is the first text that has one.

    texts: text_id, text. Rows are sorted by hash, so that a task streams over anchors of any number.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for begin, end, values in text_slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(begin, end - begin).to_pylist()
                out = [[], [], []]
                for k in _first_copies(seen, ids, values):
                    place, hashed = anchors(values[k], length)
                    new = np.flatnonzero(np.diff(place, prepend=-1))
                    for column, value in zip(out, (hashed[new].astype(np.int64), np.full(len(new), ids[k], dtype=np.int64), place[new].astype(np.int32)), strict=True):
                        column.append(value)
                if out[0]:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["hash", "text_id", "place"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hash, text_id and place of the last row, the first text of that hash, whether it has been told
        for batch in batches:
            hashed, ids, place = (column.to_numpy() for column in batch.columns)
            if not len(hashed):
                continue
            # The same text from several tasks gives the same row again.
            fresh = np.ones(len(hashed), dtype=bool)
            fresh[1:] = (hashed[1:] != hashed[:-1]) | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])
            fresh[0] = last is None or (hashed[0], ids[0], place[0]) != last[:3]
            hashed, ids, place = hashed[fresh], ids[fresh], place[fresh]
            if not len(hashed):
                continue
            head = np.ones(len(hashed), dtype=bool)
            head[1:] = hashed[1:] != hashed[:-1]
            head[0] = last is None or hashed[0] != last[0]
            at = np.maximum.accumulate(np.where(head, np.arange(len(hashed)), -1))
            home = np.where(at >= 0, ids[at], last[3] if last else 0)
            followed = np.zeros(len(hashed), dtype=bool)
            followed[at[~head & (at >= 0)]] = True
            told = ~head | followed
            parts = [(ids[told], place[told], home[told])]
            if not head[0] and not last[4]:
                parts.append(tuple(np.array([x]) for x in last[1:4]))
            for part in parts:
                if len(part[0]):
                    yield pa.record_batch([pa.array(x, kind) for x, kind in zip(part, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["text_id", "place", "home"])
            last = (hashed[-1], ids[-1], place[-1], home[-1], bool(told[-1]))

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(released(cut), "hash long, text_id long, place int").repartition(parts, "hash").sortWithinPartitions("hash", "text_id", "place")
    return rows.mapInArrow(released(join), "text_id long, place int, home long")


def passages(texts: DataFrame, firsts: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """(home, share, text_id, doc_id, start, n, passage): runs of n strings whose anchors have the same home.

    share deals the passages of a home with too many bytes to blocks, by anchor; repeated has it in the column
    shares. A string whose anchor occurs once is in no passage.
    """
    columns = {"text_id": "long", "kind": "int", "place": "int", "home": "long", "shares": "int", "text": "string"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*[F.lit(kind).alias(c) if c == "kind" else (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    seen_texts = once_per_task(texts)
    rows = shaped(repeated, 0).unionByName(shaped(firsts.select("text_id", F.col("doc_id").alias("home")), 1)).unionByName(shaped(seen_texts, 2))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc_id, done, known = None, None, False, []
        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place, home, shares = (batch.column(k).fill_null(0).to_numpy() for k in (2, 3, 4))
            out: list[tuple] = []
            edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1]), [True]])).tolist()
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if ids[begin] != now:
                    now, doc_id, done, known = ids[begin], None, False, []
                if kinds[begin] == 0:
                    known.append((place[begin:end], home[begin:end], shares[begin:end]))
                elif kinds[begin] == 1:
                    doc_id = int(home[begin])
                elif known and not done and doc_id is not None:
                    done = True
                    text = batch.column(5)[begin].as_py().encode()
                    out += [(int(now), doc_id, *x) for x in cut_passages(text, *(np.concatenate([x[k] for x in known]) for k in range(3)), length)]
            if out:
                kinds_out = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds_out)], names=["text_id", "doc_id", "home", "share", "start", "n", "passage"])

    return rows.repartition(parts, "text_id").sortWithinPartitions("text_id", "kind", "place").mapInArrow(released(run), "text_id long, doc_id long, home long, share int, start long, n long, passage binary")


def cut_passages(text: bytes, place: np.ndarray, home: np.ndarray, shares: np.ndarray, length: int) -> list[tuple]:
    """(home, share, start, n, bytes) of the runs of strings that may occur again; place: the repeated anchors, ascending."""
    anchor, hashed = anchors(text, length)
    own = np.flatnonzero(np.diff(anchor, prepend=-1))
    spots = anchor[own]
    at = np.minimum(np.searchsorted(place, spots), len(place) - 1)
    again = place[at] == spots
    group = np.repeat(np.arange(len(own)), np.diff(own, append=len(anchor)))
    clean, homes = again[group], home[at][group]
    share = np.where(shares[at] > 1, (hashed[own].astype(np.int64) & 0x7FFFFFFF) % np.maximum(shares[at], 1), 0)[group]
    edge = np.concatenate([[True], (homes[1:] != homes[:-1]) | (share[1:] != share[:-1]) | (clean[1:] != clean[:-1]), [True]])
    runs = np.flatnonzero(edge)
    return [(int(homes[b]), int(share[b]), int(b), int(e - b), text[b : e + length - 1]) for b, e in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True) if clean[b]]


def once_per_task(texts: DataFrame) -> DataFrame:
    """texts (text_id, text) without the further copies that a task meets, so that a hot text isn't shuffled whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            new = [k for k, x in enumerate(ids) if x not in seen and not seen.add(x)]
            yield batch if len(new) == len(ids) else batch.take(pa.array(new, pa.int32()))

    return texts.select("text_id", "text").mapInArrow(released(run), "text_id long, text string")


def sorted_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """(text_id, start, n): runs of strings that also stand earlier, by suffix sorting of each block.

    pieces: (home, share, ...) as from passages(). Blocks with the same partition are sorted together while they
    fit into BLOCK_BYTES.
    """
    parts = 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def finish(held: list[tuple[int, int, int, int, bytes]]) -> list[tuple]:
        held.sort(key=lambda x: (x[0], x[2]))  # by doc_id and start: earlier strings stand further left
        text = np.frombuffer(SEPARATOR.join([x[4] for x in held] + [b""]), dtype=np.uint8)
        sizes = np.array([len(x[4]) + 1 for x in held])
        begins = sizes.cumsum() - sizes
        starts = np.zeros(len(text), dtype=bool)
        counts = np.array([x[3] for x in held])
        starts[np.repeat(begins - (counts.cumsum() - counts), counts) + np.arange(counts.sum())] = True
        again = repeated_starts(text, starts, length)
        edges = np.flatnonzero(np.diff(again, prepend=False, append=False))
        runs, ends = edges[::2], edges[1::2]
        owner = np.searchsorted(begins, runs, "right") - 1
        return [(held[o][1], held[o][2] + int(b - begins[o]), int(e - b)) for o, b, e in zip(owner.tolist(), runs.tolist(), ends.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, None
        for batch in batches:
            found: list[tuple] = []
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            own = list(zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True))
            for name, row in zip(names, own, strict=True):
                if name != block and size > BLOCK_BYTES // 2:
                    found += finish(held)
                    held, size = [], 0
                block = name
                held.append(row)
                size += len(row[4])
            if found:
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["text_id", "start", "n"])
        if held and (found := finish(held)):
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["text_id", "start", "n"])

    rows = pieces.select("home", "share", "doc_id", "text_id", "start", "n", "passage")
    return rows.repartition(parts, "home", "share").sortWithinPartitions("home", "share").mapInArrow(released(run), "text_id long, start long, n long")


def grouped_strings(pieces: DataFrame, length: int) -> DataFrame:
    """The same for blocks that are still too large: strings are grouped by themselves and joined with their first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text_id, start, n, passage in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                yield pa.record_batch([pa.array([doc_id] * n, pa.int64()), pa.array([text_id] * n, pa.int64()), pa.array(range(start, start + n), pa.int64()), pa.array([passage[k : k + length] for k in range(n)], pa.binary())], names=["doc_id", "text_id", "start", "string"])

    strings = pieces.select("doc_id", "text_id", "start", "n", "passage").mapInArrow(released(run), "doc_id long, text_id long, start long, string binary")
    first = strings.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = strings.join(first, "string").where(F.struct("doc_id", "start") != F.col("first"))
    return again.select("text_id", "start", F.lit(1).cast("long").alias("n"))


def cleaned(rows: DataFrame, firsts: DataFrame, runs: DataFrame, length: int, digest: bool) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept) of all rows (text_id, doc_id, text, row).

    kept: what stays of the text, or its SHA-256 in hex with digest. Rows of a text follow its runs and its first
    doc_id; of copies in one task only one brings the text along, so that a hot text isn't shuffled whole.
    """
    row_type = rows.schema["row"].dataType.simpleString()
    schema = f"text_id long, kind int, start long, n long, doc_id long, text string, row {row_type}"

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            new = pa.array([x not in seen and not seen.add(x) for x in batch.column(0).to_pylist()], pa.bool_())
            zero = pa.array(np.zeros(len(new), dtype=np.int64))
            text = pa.compute.if_else(new, batch.column(2), pa.scalar(None, batch.column(2).type))
            start = pa.compute.cast(pa.compute.invert(new), pa.int64())  # rows with a text come first
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(new), 2, dtype=np.int32)), start, zero, batch.column(1), text, batch.column(3)], names=["text_id", "kind", "start", "n", "doc_id", "text", "row"])

    def filled(df: DataFrame, kind: int) -> DataFrame:
        kinds = [x.split(" ", 1) for x in ("text_id long", "start long", "n long", "doc_id long", "text string", f"row {row_type}")]
        out = {name: (F.col(name) if name in df.columns else F.lit(None)).cast(of) for name, of in kinds}
        return df.select(*[F.lit(kind).alias("kind") if name == "kind" else out[name].alias(name) for name in ("text_id", "kind", "start", "n", "doc_id", "text", "row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans, first, own = None, [], None, (0, 0, 0, "")
        for batch in batches:
            names, kinds, starts, counts, ids = (batch.column(k).to_pylist() for k in range(5))
            at, out = [], []
            for k, name in enumerate(names):
                if name != now:
                    now, spans, first = name, [], None
                if kinds[k] == 0:
                    spans.append((starts[k], starts[k] + counts[k] - 1 + length))
                elif kinds[k] == 1:
                    first = ids[k]
                else:
                    if starts[k] == 0 and (text := batch.column(5)[k].as_py()) is not None:
                        body = text.encode()
                        kept, removed = without(body, spans)
                        own = (len(body), removed, merged(spans), hashlib.sha256(kept).hexdigest() if digest else kept.decode(errors="ignore"))
                    copy = first is not None and first != (NO_ID if ids[k] is None else ids[k])
                    at.append(k)
                    out.append((own[0], own[0], 1, EMPTY_HASH if digest else "") if copy else own)
            if at:
                yield pa.record_batch([batch.column(6).take(pa.array(at, pa.int32())), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.string())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])

    bodies = rows.select("text_id", "doc_id", "text", "row").mapInArrow(released(once), schema)
    every = filled(runs, 0).unionByName(filled(firsts, 1)).unionByName(bodies)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = every.repartition(parts, "text_id").sortWithinPartitions("text_id", "kind", "start")
    return sorted_rows.mapInArrow(released(run), f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept string")


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """text without the spans (ascending by begin, they may overlap), and how many bytes went."""
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at:begin])
        at = max(at, end)
    kept.append(text[at:])
    out = b"".join(kept)
    return out, len(text) - len(out)


def merged(spans: list[tuple[int, int]]) -> int:
    """The number of maximal spans."""
    count, at = 0, -1
    for begin, end in spans:
        count += begin > at
        at = max(at, end)
    return count


def repeated_runs(texts: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """(text_id, start, n) of all strings that also stand earlier, in the first copy of each text."""
    repeated = staged(repeated_anchors(texts, length), "anchors")
    # An upper bound of a home's passages: an anchor belongs to at most length - GRAM + 1 strings.
    sizes = repeated.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") * (2 * length - GRAM) > BLOCK_BYTES)
    shares = sizes.select("home", F.ceil(F.col("n") * (2 * length - GRAM) * 2 / BLOCK_BYTES).cast("int").alias("shares"))
    dealt = repeated.join(shares, "home", "left")
    pieces = staged(passages(texts, firsts, dealt, length), "passages")
    large = pieces.groupBy("home", "share").agg(F.sum(F.octet_length("passage") + 1).alias("bytes")).where(F.col("bytes") > BLOCK_BYTES).select("home", "share")
    large = staged(large, "large-blocks")
    n_large = large.count()
    if not n_large:
        return staged(sorted_blocks(pieces, length), "repeated-runs")
    # Up to a bound these names are sent to all tasks, so that a hot block's passages stay where they are.
    large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    small = pieces.join(large, ["home", "share"], "left_anti")
    rest = pieces.join(large, ["home", "share"], "left_semi")
    return staged(sorted_blocks(small, length).unionByName(grouped_strings(rest, length)), "repeated-runs")


def named_texts(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text, ...) with text_id, equal for equal texts alone, and the first copies: (text_id, doc_id).

    The name is a 64-bit hash that length and 120 bits of SHA-256 confirm. Where different texts share a name,
    all of that name get another one, made of another digest, until none is shared. First copies are of texts
    of length bytes or more.
    """
    rows, tries = rows.withColumn("text_id", F.xxhash64("text")), 0
    while True:
        digest = F.sha2(F.col("text").cast("binary"), 256)
        facts = rows.select("text_id", "doc_id", F.octet_length("text").alias("n"), digest.alias("digest"))
        for k in range(2):
            facts = facts.withColumn(f"digest_{k}", F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("long"))
        checked = ("n", "digest_0", "digest_1")
        ends = [end(name).alias(f"{name}_{end.__name__}") for name in checked for end in (F.min, F.max)]
        firsts = staged(facts.groupBy("text_id").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc_id"), *ends), "first-copies")
        shared = firsts.where(" or ".join(f"{name}_min != {name}_max" for name in checked)).select("text_id", F.lit(True).alias("__llm_shared"))
        n_shared = shared.count()
        if not n_shared:
            return rows, firsts.where(F.col("n_min") >= length).select("text_id", "doc_id")
        tries += 1
        other = F.xxhash64(F.sha2(F.concat(F.lit(f"{tries} "), F.col("text")).cast("binary"), 256))
        rows = rows.join(F.broadcast(shared) if n_shared <= BROADCAST_ROWS else shared, "text_id", "left")
        rows = rows.withColumn("text_id", F.when(F.col("__llm_shared"), other).otherwise(F.col("text_id"))).drop("__llm_shared")


def deduplicate(docs: DataFrame, length: int = LENGTH, digest: bool = False, text: str = "text") -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept) of all documents; row has the columns of docs but the text.

    kept: the text that stays (a character of which a byte goes, goes), or the SHA-256 of the bytes that stay, in
    hex, with digest. A null text has no bytes. Rows that repeat a doc_id with the same text count as one
    document; of different documents with equal texts only that with the smallest doc_id keeps its own. A row
    without doc_id counts as the smallest.
    """
    own = [F.col(f"`{name}`") for name in docs.columns if name != text]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*own).alias("row"))
    rows, firsts = named_texts(rows, length)
    long = rows.where(F.octet_length("text") >= length)
    runs = repeated_runs(long.select("text_id", "text"), firsts, length)
    return cleaned(rows, firsts, runs, length, digest)
