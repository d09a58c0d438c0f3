"""Best-fit packing of token pieces, improved by swap-based local search.

Pieces shorter than a sequence are dealt to groups of bounded size by a hash. A group is packed by best fit,
longest first; then the local search moves pieces between underfull bins and exchanges one for one or two for
one. Every step makes a fuller bin fuller, so the sum of squared fills grows until bins are empty. Bins that stay underfull are dissolved and packed once more with
those of the other groups, until one group is left or that saves no bin.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.bpe import Encoder, encoder_state, text_slices
from patchlake.llm.memory import released
from patchlake.llm.storage import staged

GROUP_PIECES = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, row long"


class Bins:
    """Bins of one group: best fit and local search over integer lengths."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.free: list[int] = []
        self.items: list[list[tuple[int, int]]] = []  # (length, piece), ascending
        self.open: list[tuple[int, int]] = []  # (free, bin) of bins with room, ascending

    def add(self, length: int, piece: int) -> None:
        """Into the bin that it fills best, else a new one."""
        at = bisect_left(self.open, (length, -1))
        if at < len(self.open):
            self._put(self.open[at][1], length, piece)
        else:
            self.free.append(self.capacity - length)
            self.items.append([(length, piece)])
            if self.free[-1]:
                insort(self.open, (self.free[-1], len(self.free) - 1))

    def _room(self, at: int, free: int) -> None:
        if self.free[at]:
            del self.open[bisect_left(self.open, (self.free[at], at))]
        self.free[at] = free
        if free:
            insort(self.open, (free, at))

    def _put(self, at: int, length: int, piece: int) -> None:
        insort(self.items[at], (length, piece))
        self._room(at, self.free[at] - length)

    def _take(self, at: int, length: int, piece: int) -> None:
        self.items[at].remove((length, piece))
        self._room(at, self.free[at] + length)

    def empty(self, donor: int) -> bool:
        """Moves the pieces of a bin into fuller ones; whether none is left."""
        for item in reversed(self.items[donor].copy()):
            at = bisect_left(self.open, (item[0], -1))
            if at < len(self.open) and self.open[at][1] == donor:
                at += 1
            if at < len(self.open) and self.open[at][0] <= self.free[donor]:
                self._take(donor, *item)
                self._put(self.open[at][1], *item)
        return not self.items[donor]

    def improve(self) -> None:
        """Passes over all underfull bins until one empties no bin, or as few are left as the lengths allow."""
        least = -(-sum(x for items in self.items for x, _ in items) // self.capacity)
        while True:
            before = sum(map(bool, self.items))
            if before <= least:
                return
            Exchange(self).run()
            for _, at in sorted(self.open, reverse=True):
                if self.free[at] < self.capacity:
                    self.empty(at)
            if sum(map(bool, self.items)) >= before:
                return


class Exchange:
    """A pass of the local search over the pieces of underfull bins.

    The fullest bin takes what fills it most from bins that are no fuller: a piece, a longer piece for one or
    for two of its own, or two pieces for one of its own; again until it is full or nothing fits. Then it leaves
    the pass and the next one takes. Each step adds to the sum of squared fills; free space gathers in the
    emptiest bins until they have no piece left.
    """

    def __init__(self, bins: Bins) -> None:
        self.bins = bins
        self.pool = {at for free, at in bins.open if free < bins.capacity}
        self.at: dict[int, list[tuple[int, int]]] = {}  # length -> (bin, piece) in the pool
        self.have = 0  # bit n: a piece of length n is in the pool
        self.mirror = 0  # the same bits from capacity down
        for at in self.pool:
            for item in bins.items[at]:
                self._enter(at, *item)
        self.queue = [(bins.free[at], at) for at in self.pool]
        heapify(self.queue)

    def _enter(self, at: int, length: int, piece: int) -> None:
        own = self.at.setdefault(length, [])
        if not own:
            self.have |= 1 << length
            self.mirror |= 1 << (self.bins.capacity - length)
        own.append((at, piece))

    def _leave(self, at: int, length: int, piece: int) -> None:
        own = self.at[length]
        own.remove((at, piece))
        if not own:
            self.have ^= 1 << length
            self.mirror ^= 1 << (self.bins.capacity - length)

    def _longest(self, length: int) -> int:
        """The longest piece of the pool of at most this length, else 0."""
        return (self.have & ((1 << (length + 1)) - 1)).bit_length() - 1 if length > 0 and self.have else 0

    def _holder(self, length: int) -> tuple[int, int]:
        """The emptiest bin that has a piece of this length, and the piece."""
        return max(self.at[length], key=lambda x: (self.bins.free[x[0]], x))

    def _trade(self, taker: int, ours: list[tuple[int, int]], giver: int, theirs: tuple[int, int]) -> None:
        """theirs goes from giver, a bin of the pool, to taker; ours the other way."""
        bins = self.bins
        bins._take(giver, *theirs)
        self._leave(giver, *theirs)
        for item in ours:
            bins._take(taker, *item)
            bins._put(giver, *item)
            self._enter(giver, *item)
        bins._put(taker, *theirs)
        heappush(self.queue, (bins.free[giver], giver))

    def _single(self, taker: int) -> bool:
        """One piece for none, one or two of the taker's: the exchange that fills it most, then with the longest piece."""
        bins, best = self.bins, None
        own, free = bins.items[taker], bins.free[taker]
        for ours in [*([x, y] for k, x in enumerate(own) for y in own[:k]), *([x] for x in own), []]:
            out = sum(x for x, _ in ours)
            length = self._longest(min(bins.capacity, out + free))
            if length > out and (best is None or (length - out, length) > (best[0], best[2])):
                best = length - out, ours, length
        if not best:
            return False
        giver, piece = self._holder(best[2])
        self._trade(taker, best[1], giver, (best[2], piece))
        return True

    def _double(self, taker: int) -> bool:
        """Two pieces that fill the taker up, for one of its own that has room where the longer of them was."""
        bins = self.bins
        for ours in bins.items[taker]:
            total = ours[0] + bins.free[taker]
            both = self.have & (self.mirror >> (bins.capacity - total)) if total <= bins.capacity else 0
            while both:
                long = both.bit_length() - 1
                both ^= 1 << long
                if 2 * long < total:
                    break
                if 2 * long == total and len(self.at[long]) < 2:
                    continue
                giver, piece = self._holder(long)
                if bins.free[giver] + long < ours[0]:
                    continue
                self._trade(taker, [ours], giver, (long, piece))
                short = total - long
                if not self.at.get(short):  # it was the taker's own
                    return True
                other, piece = self._holder(short)
                self._trade(taker, [], other, (short, piece))
                return True
        return False

    def run(self) -> None:
        bins = self.bins
        while self.queue:
            free, taker = heappop(self.queue)
            if taker not in self.pool or free != bins.free[taker]:
                continue  # it has left, or has changed since
            self.pool.discard(taker)
            for item in bins.items[taker]:
                self._leave(taker, *item)
            while bins.items[taker] and bins.free[taker] and (self._single(taker) or self._double(taker)):
                pass


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of the bin) of every piece."""
    bins = Bins(capacity)
    for at in np.argsort(-lengths, kind="stable").tolist():
        bins.add(int(lengths[at]), at)
    bins.improve()
    where, offset, fill = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    for number, items in enumerate(x for x in bins.items if x):
        at = 0
        for length, piece in items:
            where[piece], offset[piece] = number, at
            at += length
        fill[[piece for _, piece in items]] = at
    return where, offset, fill


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of every whole text: its ids and the end id, cut every capacity tokens. Null texts count as empty."""
    tables = docs.sparkSession.sparkContext.broadcast(encoder_state(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.restore(tables.value)
        part, row = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for begin, stop, texts in text_slices(batch.column(1)):
                flat, counts = encoder.encode(texts)
                flat = np.insert(flat, counts.cumsum(), end)
                counts = counts + 1
                pieces = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(owner)) - np.repeat(pieces.cumsum() - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, counts[owner] - start)
                raw = memoryview(np.ascontiguousarray(flat.astype("<u4"))).cast("B")
                ends = length.cumsum().tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
                ids = batch.column(0).slice(begin, stop - begin).take(pa.array(owner))
                rows = np.arange(row, row + len(owner))
                row += len(owner)
                yield pa.record_batch(
                    [ids, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part), pa.int32()), pa.array(rows, pa.int64())],
                    names=[x.split()[0] for x in PIECES.split(", ")],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(released(run), PIECES)


def _packer(columns: list[str], capacity: int, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "row"], ignore_index=True)
        where, offset, fill = pack_lengths(group["length"].to_numpy(), capacity)
        return group[columns].assign(sequence_id=(level << 48) + (int(key[0]) << 24) + where, offset=offset, filled=fill)

    return one


def pack(pieces: DataFrame, capacity: int, dense: float = 0.98) -> DataFrame:
    """pieces (length; part and row name a piece) with sequence_id and offset.

    Full pieces are sequences of their own. The rest goes through levels of groups; sequences filled to the
    share dense stay as they are, others are packed again, until a level has a single group or makes no fewer
    bins of its pieces than they had before; then the bins that they had stay.
    """
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", (F.lit(-1) - F.col("part")) * (1 << 40) + F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rest, done, level = pieces.where(F.col("length") < capacity), full, 0
    columns = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, filled long"
    before, bins = None, None  # the underfull bins of the last level, and how many they are
    while True:
        groups = max(1, -(-rest.count() // GROUP_PIECES))
        one = _packer(columns, capacity, level)
        dealt = rest.select(*columns, F.pmod(F.xxhash64(F.lit(level), "part", "row"), F.lit(groups)).alias("__llm_group"))
        packed = staged(dealt.groupBy("__llm_group").applyInPandas(one, schema), f"packed-{level}")
        # Every bin has one piece at offset 0.
        made, short = packed.where("offset = 0").agg(F.count("*"), F.count_if(F.col("filled") < int(dense * capacity))).head()
        if bins is not None and made >= bins:
            return done.unionByName(before)
        if groups == 1:
            return done.unionByName(packed.drop("filled"))
        done = done.unionByName(packed.where(F.col("filled") >= int(dense * capacity)).drop("filled"))
        before, bins = packed.where(F.col("filled") < int(dense * capacity)).drop("filled"), short
        rest, level = before.select(*columns), level + 1


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents as sequences of at most capacity tokens: one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty or null text is one piece,
    the end id alone. Repeated rows are packed as often as they occur. No rows, no pieces.
    """
    pieces = staged(token_pieces(docs, path, capacity, end_id), "pieces")
    return pack(pieces, capacity).drop("part", "row")
