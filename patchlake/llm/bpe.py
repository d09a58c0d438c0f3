"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring byte symbols that occurs inside no vocabulary token can never be joined by a
merge, so it is a certain cut. Words are cut at these pairs, the fragments are encoded independently
(all fragments of a batch together, as rows of a matrix) and the ids are put together again.

Results equal those of the tokenizers library for tokenizers whose normalizer is NFC, white space to a
space, lower case, whose pre-tokenizer drops white space and maps bytes to characters, and whose model is
BPE with a word-end suffix; other files are refused. Null texts count as empty. White space produces no
ids, so the text is cut at ASCII white space first and every chunk is encoded once per task while the
chunk table has room; beyond its bound it keeps the chunks that come again and again.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, normalizers, pre_tokenizers

NEVER = np.int32(2**31 - 1)
# Row lengths up to which fragments share a matrix; longer fragments take the heap.
WIDTHS = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
CHUNKS_KEPT = 200_000
CELLS = 1_000_000  # symbols of fragments that are merged together


@dataclass(frozen=True)
class Vocabulary:
    """The parsed tokenizer file; small (bounded by the vocabulary) and sent to every task."""

    tokens: list[str]
    merges: np.ndarray  # rank -> (left id, right id, merged id)
    specials: dict[str, int]
    suffix: str
    classes: np.ndarray  # see character_classes()

    def parts(self) -> tuple:
        """Plain values, which travel without this module."""
        return self.tokens, self.merges, self.specials, self.suffix, self.classes


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(byte if byte in prints else next(others)) for byte in range(256)]


def character_classes(splitter: pre_tokenizers.PreTokenizer) -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 anything else.

    Code points that this Python's Unicode doesn't know yet are tried out on the pre-tokenizer itself: a
    letter joins a letter before it, anything else a mark before it.
    """
    kinds = {"L": 1, "N": 2, "Z": 0}
    categories = [unicodedata.category(chr(code)) for code in range(0x40000)]
    classes = np.full(0x110000, 3, dtype=np.uint8)
    classes[: len(categories)] = [kinds.get(x[0], 3) for x in categories]
    classes[[0x85, *range(0x09, 0x0E)]] = 0
    later = [code for code, x in enumerate(categories) if x == "Cn"]
    for before, kind in (("x", 1), ("!", 3)):
        pieces = splitter.pre_tokenize_str("".join(f"{before}{chr(code)}\n" for code in later))
        whole = {start // 3 for _, (start, end) in pieces if end - start == 2}
        classes[[code for k, code in enumerate(later) if k in whole]] = kind
        if kind == 1:
            classes[[code for k, code in enumerate(later) if k not in whole]] = 2
    return classes


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [step["type"] for step in (spec.get("normalizer") or {}).get("normalizers", [])]
    if model["type"] != "BPE" or not model.get("end_of_word_suffix") or steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
        raise ValueError(f"{path}: needs a BPE model with a word-end suffix, NFC, Replace, Lowercase and no decoder")
    if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path}: dropout, byte fallback, ignored merges and subword prefixes aren't supported")
    vocab = model["vocab"]
    specials = {token["content"]: token["id"] for token in spec.get("added_tokens", [])}
    if any(token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"] for token in spec.get("added_tokens", [])):
        raise ValueError(f"{path}: added tokens must match plainly")
    tokens = [""] * (1 + max(max(vocab.values()), *specials.values(), 0))
    for token, at in [*vocab.items(), *specials.items()]:
        tokens[at] = token
    pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int32).reshape(-1, 3)
    shell = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
    return Vocabulary(tokens, merges, specials, model["end_of_word_suffix"], character_classes(shell.pre_tokenizer))


class Encoder:
    """Encodes batches of whole texts in one task."""

    def __init__(self, vocabulary: Vocabulary, keep: int = CHUNKS_KEPT) -> None:
        self.vocabulary, self.keep = vocabulary, keep
        ids = {token: at for at, token in enumerate(vocabulary.tokens) if token not in vocabulary.specials}
        letters = byte_alphabet()
        self.plain = np.array([ids[x] for x in letters], dtype=np.int32)
        self.final = np.array([ids[x + vocabulary.suffix] for x in letters], dtype=np.int32)
        self.small = np.zeros(len(vocabulary.tokens), dtype=np.int32)  # id of a byte symbol -> dense number
        self.small[self.plain], self.small[self.final] = np.arange(256), np.arange(256, 512)
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.joins = np.zeros((512, 512), dtype=bool)
        for token in ids:
            body = token.removesuffix(vocabulary.suffix) or token
            symbols = [byte_of[x] for x in body]
            symbols[-1] += 256 * (body != token)
            self.joins[symbols[:-1], symbols[1:]] = True
        left, right, self.merged = vocabulary.merges.T
        bytes_only = np.concatenate([self.plain, self.final])
        both = np.isin(left, bytes_only) & np.isin(right, bytes_only)
        self.base_rank = np.full((512, 512), NEVER, dtype=np.int32)
        self.base_rank[self.small[left[both]], self.small[right[both]]] = np.flatnonzero(both)
        self._hash_pairs(left.astype(np.int64), right.astype(np.int64))
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.specials)) + ")") if vocabulary.specials else None
        self.classes = vocabulary.classes
        self._clear()

    def state(self) -> dict:
        """The tables that the vocabulary gives: bounded by it, made once and sent to every task."""
        left_out = ("normal", "known", "pool", "used", "start", "size", "again")
        return {name: value for name, value in self.__dict__.items() if name not in left_out}

    @classmethod
    def restore(cls, state: dict) -> Encoder:
        made = cls.__new__(cls)
        made.__dict__.update(state)
        made.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        made._clear()
        return made

    # pair -> rank, an open table probed for whole arrays at once

    def _hash_pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        self.slots = 1 << 19
        keys = left << 32 | right
        self.keys = np.full(self.slots, -1, dtype=np.int64)
        self.ranks = np.full(self.slots, NEVER, dtype=np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            spots, first = np.unique(at[todo], return_index=True)
            free = self.keys[spots] < 0
            placed = todo[first[free]]
            self.keys[spots[free]], self.ranks[spots[free]] = keys[placed], placed
            todo = np.setdiff1d(todo, placed)
            at[todo] = (at[todo] + 1) % self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        here = self.keys[at]
        found = np.where(here == keys, self.ranks[at], NEVER)
        # A taken slot passes its other keys on to the next one.
        todo = np.flatnonzero((here != keys) & (here >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % self.slots
            here = self.keys[at[todo]]
            hit = here == keys[todo]
            found[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (here >= 0)]
        return found

    # fragments

    def _merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows: symbols, -1 behind the end. Applies the lowest merge of every row until none is left."""
        done = np.full_like(rows, -1)
        place = np.arange(len(rows))
        ranks = np.where(rows[:, 1:] < 0, NEVER, self.base_rank[self.small[rows[:, :-1]], self.small[rows[:, 1:]]])
        while len(rows):
            line = np.arange(len(rows))
            if ranks.shape[1] == 0:
                done[place, : rows.shape[1]] = rows
                break
            j = ranks.argmin(1)
            best = ranks[line, j]
            live = best < NEVER
            if not live.all():
                done[place[~live], : rows.shape[1]] = rows[~live]
                rows, ranks, place, j, best = rows[live], ranks[live], place[live], j[live], best[live]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            new = self.merged[best]
            columns = np.arange(rows.shape[1] - 1)
            rows = np.where(columns <= j[:, None], rows[:, :-1], rows[:, 1:])
            rows[line, j] = new
            ranks = np.where(columns[:-1] < j[:, None], ranks[:, :-1], ranks[:, 1:])
            if ranks.shape[1]:
                k = np.flatnonzero(j > 0)
                ranks[k, j[k] - 1] = self._rank(rows[k, j[k] - 1], new[k])
                k = np.flatnonzero(j < ranks.shape[1])
                after = rows[k, j[k] + 1]
                ranks[k, j[k]] = np.where(after < 0, NEVER, self._rank(new[k], after))
        return done, (done >= 0).sum(1)

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long fragment: a heap of pairs over a linked list."""
        ids = symbols.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._rank(symbols[:-1], symbols[1:]).tolist()
        heap = [(rank, at, ids[at], ids[at + 1]) for at, rank in enumerate(first) if rank < NEVER]
        heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def offer(at: int) -> None:
            pair = (ids[at], ids[after[at]])
            if pair not in known:
                known[pair] = int(self._rank(np.array(pair[:1]), np.array(pair[1:]))[0])
            if known[pair] < NEVER:
                heappush(heap, (known[pair], at, *pair))

        while heap:
            rank, at, left, right = heappop(heap)
            if ids[at] != left or after[at] >= n or ids[after[at]] != right:
                continue
            gone = after[at]
            ids[at], ids[gone] = int(self.merged[rank]), -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _encode_words(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words raw[begin:end] in one array, and how many each has."""
        lengths = ends - begins
        ends = lengths.cumsum()
        raw = raw[np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1])]
        symbols = self.plain[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        cut = np.ones(len(symbols), dtype=bool)  # where a fragment begins
        dense = self.small[symbols]
        cut[1:] = ~self.joins[dense[:-1], dense[1:]]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(symbols))
        counts = np.ones(len(starts), dtype=np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        low = 1
        for width in WIDTHS:
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for part in np.array_split(which, 1 + len(which) * width // CELLS):
                if len(part):
                    at = starts[part][:, None] + np.arange(width)
                    inside = np.arange(width) < sizes[part][:, None]
                    rows = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1)
                    rows, counts[part] = self._merge_rows(rows)
                    made.append((part, rows))
        for one in np.flatnonzero(sizes > WIDTHS[-1]):
            ids = self._merge_long(symbols[starts[one] : starts[one] + sizes[one]])
            counts[one] = len(ids)
            made.append((np.array([one]), ids[None, :]))
        offsets = counts.cumsum() - counts
        flat = np.empty(counts.sum(), dtype=np.int32)
        single = sizes == 1
        flat[offsets[single]] = symbols[starts[single]]
        for part, rows in made:
            inside = rows >= 0
            flat[(offsets[part][:, None] + np.arange(rows.shape[1]))[inside]] = rows[inside]
        first = np.searchsorted(starts, ends - lengths)
        return flat, np.add.reduceat(counts, first) if len(first) else counts[:0]

    # chunks

    def _clear(self) -> None:
        self.known = Numbered()
        self.pool = np.empty(1 << 16, dtype=np.int32)
        self.used = 0
        self.start, self.size = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int64)
        self.again = np.zeros(1 << 16, dtype=bool)  # met in more than one batch

    def _shrink(self) -> None:
        """Forgets chunks that only one batch has had, and all if too many are left."""
        old, sizes, starts, pool = list(self.known), self.size, self.start, self.pool
        kept = np.flatnonzero(self.again[: len(old)])
        self._clear()
        if 2 * len(kept) <= self.keep and 2 * int(sizes[kept].sum()) <= 8 * self.keep:
            for at in kept.tolist():
                self.known[old[at]] = len(self.known)
            size = sizes[kept]
            ends = size.cumsum()
            flat = pool[np.repeat(starts[kept] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            self._add(np.arange(len(kept)), flat, size)

    def _add(self, at: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """Enters the ids of the chunks with the numbers at."""
        while len(self.start) < len(self.known):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[at] = self.used + counts.cumsum() - counts
        self.size[at] = counts
        self.used += len(flat)

    def _words(self, normal: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a normalized text, and where its words begin and end: contractions, runs of letters, single
        numbers and runs of anything else but white space."""
        data = normal.encode()
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(data) == len(normal):
            kinds = self.classes[raw]
        else:
            codes = np.frombuffer(normal.encode("utf-32-le"), dtype=np.uint32)
            kinds = np.repeat(self.classes[codes], 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        edge = np.ones(len(raw) + 1, dtype=bool)
        edge[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2) & (raw[1:] & 0xC0 != 0x80)
        marks = np.flatnonzero(raw == 0x27)
        marks = marks[edge[marks] & edge[marks + 1]]
        if len(marks):
            tail = np.concatenate([raw, np.zeros(2, dtype=np.uint8)])
            one, two = tail[marks + 1], tail[marks + 2]
            single = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
            double = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            edge[marks[single | double] + 1] = False
            edge[marks[single] + 2] = True
            edge[marks[double] + 3] = True
        places = np.flatnonzero(edge)
        begins, ends = places[:-1], places[1:]
        words = kinds[begins] != 0
        return raw, begins[words], ends[words]

    def _plain_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        raw, begins, ends = self._words(self.normal.normalize_str("\n".join(texts)))
        if not len(begins):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        flat, sizes = self._encode_words(raw, begins, ends)
        owner = np.searchsorted(np.flatnonzero(raw == 0x0A), begins)
        return flat, np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)

    def _learn(self, chunks: list[bytes], first: int) -> None:
        """Encodes chunks, which have the numbers from first on."""
        for begin in range(0, len(chunks), 50_000):
            joined = b"\n".join(chunks[begin : begin + 50_000]).decode()
            texts = joined.split("\n")
            at = np.arange(first + begin, first + begin + len(texts))
            if self.special and self.special.search(joined):
                marked = [k for k, text in enumerate(texts) if self.special.search(text)]
                for k in marked:
                    parts = [part for part in self.special.split(texts[k]) if part]
                    ids = [np.array([x], dtype=np.int32) if (x := self.vocabulary.specials.get(part)) is not None else self._plain_chunks([part])[0] for part in parts]
                    self._add(at[k : k + 1], np.concatenate(ids), np.array([sum(map(len, ids))]))
                gone = set(marked)
                texts, at = [text for k, text in enumerate(texts) if k not in gone], np.delete(at, marked)
            self._add(at, *self._plain_chunks(texts))

    def encode(self, texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        words, of, counts = distinct_chunks([text or b"" for text in texts])
        if len(self.known) > self.keep or self.used > 8 * self.keep:
            self._shrink()
        first = len(self.known)
        index = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))[of]
        if self.known.new:
            self._learn(self.known.new, first)
            self.known.new = []
        self.again[index[index < first]] = True
        sizes, starts = self.size[index], self.start[index]
        ends = sizes.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], counts.cumsum()])]
        return flat.astype(np.uint32), np.diff(edges)


def distinct_chunks(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct runs without ASCII white space, the number of each run among them, and how many runs each text has."""
    parts = pa.compute.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    coded = parts.values.dictionary_encode()
    of, edges = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()
    # White space at the ends of a text, and a text without any run, leave empty runs.
    lengths = pa.compute.binary_length(coded.dictionary).to_numpy()
    real = lengths[of] > 0
    counts = np.diff(np.concatenate([[0], real.cumsum()])[edges])
    kept = np.flatnonzero(lengths > 0)
    number = np.zeros(len(lengths), dtype=np.int64)
    number[kept] = np.arange(len(kept))
    return coded.dictionary.take(pa.array(kept)).cast(pa.large_binary()).to_pylist(), number[of[real]], counts


@lru_cache(maxsize=4)
def encoder_state(path: str) -> dict:
    return Encoder(load_vocabulary(path)).state()


class Numbered(dict):
    """Numbers its keys as they are first asked for; new has the latest ones."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number


class Decoder:
    """decode(ids, skip_special_tokens=False) of a tokenizer without decoder: the tokens joined by spaces."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = [token.encode() for token in vocabulary.tokens]

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = 2 << 20) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Runs of rows with about limit bytes of text, one row at least."""
    values = column.cast(pa.large_binary())
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    begin, size = 0, 0
    lengths = pa.compute.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    for end, length in enumerate(lengths.tolist(), 1):
        size += length
        if size >= limit or end == len(lengths):
            yield begin, end, values.slice(begin, end - begin).to_pylist()
            begin, size = end, 0


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): the ids of every whole text as little-endian unsigned 32-bit integers.

    A null text is an empty one. Repeated rows stay; other columns are left out.
    """
    tables = docs.sparkSession.sparkContext.broadcast(encoder_state(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.restore(tables.value)
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(1)):
                flat, counts = encoder.encode(texts)
                yield pa.record_batch([batch.column(0).slice(begin, end - begin), binary_rows(flat, counts)], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def binary_rows(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value of little-endian unsigned 32-bit integers per row."""
    ends = np.concatenate([[0], counts.cumsum()]).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat.astype("<u4")))]).cast(pa.binary())


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, decoded string) from (id, ids binary). No ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path).parts())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(*vocabulary.value))
        for batch in batches:
            texts = [decoder.decode(np.frombuffer(x, dtype="<u4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids binary, decoded string")


class Digests:
    """Number and SHA-256 of ids (decimal, joined by one space)."""

    def __init__(self, n_tokens: int) -> None:
        self.decimal = [b"%d" % x for x in range(n_tokens)]

    def of(self, ids: np.ndarray) -> str:
        return hashlib.sha256(b" ".join(map(self.decimal.__getitem__, ids.tolist()))).hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again in one pass.

    What encode_documents and decode_documents return, digested where it is made: ids and decoded texts are
    several times as large as the texts and needn't leave the task.
    """
    tables = docs.sparkSession.sparkContext.broadcast(encoder_state(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.restore(tables.value)
        decoder, digests = Decoder(encoder.vocabulary), Digests(len(encoder.vocabulary.tokens))
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(1)):
                flat, counts = encoder.encode(texts)
                ids_hash, text_hash, at = [], [], 0
                for n in counts.tolist():
                    ids = flat[at : at + n]
                    ids_hash.append(digests.of(ids))
                    text_hash.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
                    at += n
                yield pa.record_batch([batch.column(0).slice(begin, end - begin), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
