"""N-gram Jaccard join by universe partition.

A document's set is that of its word n-grams, hashed to 64 bits. Sizes fall into bands a ratio `threshold`
apart, so a linked pair lies in one band or in neighbouring ones. In a band, linked sets differ in at most h
elements. The universe is dealt to segments by a hash; each segment of a set has a budget: 0 (left out), 1
(must be equal) or 2 (may differ by one element). When the budgets of a band sum to h + 1, some segment stays
within its budget (pigeonhole), so equal segment keys find every linked pair: a segment with budget 1 has one
key, its content; one with budget 2 also has a key for every deletion of one element. An empty segment would
bring together all sets that have none of its elements. So there are more than h + 1 segments, as many as it
takes for the segments in which a set has elements to hold budgets of h + 1 by themselves: such a set meets each
linked one in one of them and has no keys of empty ones. The few other sets have these too. Budgets are chosen by
band and segment, by cost: a segment whose keys would bring together many sets gives its budget to one whose
keys don't, if the documents that they bring together are still apart after the first links and cost more than
keys made anew.

Keys lead to stars, not to all pairs: the documents of a key meet the first one, unless links have brought them
together before. Only keys that still hold several components go on, and there the documents outside the
centre's component meet the others, block by block, as products of matrices. Sizes and odd sketches (parities of
buckets, which differ in no more bits than the sets do in elements) rule out most pairs before. All links are
verified on the whole sets, made anew from the texts, as these are smaller to shuffle than the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.bpe import text_slices
from patchlake.llm.components import connected_components
from patchlake.llm.memory import released
from patchlake.llm.storage import drop_folder, new_folder, staged

KEYED = "doc_id long, n long, same_as long, band int, sketch binary, low_sketch binary, keys array<long>"
HITS = "key long, center long, doc_id long"
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOTS = np.uint64((1 << 20) - 1)
DELETIONS = 24  # keys of a segment with budget 2, about
CHUNK = 2048  # documents of a block
BROADCAST_IDS = 100_000  # ids sent to all tasks at most
SKETCH = 1  # bytes of a sketch for two differences
COLUMNS = 4096  # elements of a matrix product


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of data, and where they begin."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begins, ends = edge[::2], edge[1::2]
    if not len(begins):
        return np.zeros(0, dtype=np.uint64), begins
    # A polynomial over the bytes, modulo 2^64: differences of running sums, scaled to the word's begin.
    lengths = ends - begins
    inside = np.repeat(begins - (lengths.cumsum() - lengths), lengths) + np.arange(lengths.sum())
    place = np.arange(len(inside)) - np.repeat(lengths.cumsum() - lengths, lengths)
    powers = np.empty(int(lengths.max()), dtype=np.uint64)
    powers[0] = 1
    if len(powers) > 1:
        powers[1:] = MIX
        powers = np.multiply.accumulate(powers)
    terms = mixed(raw[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mixed(np.add.reduceat(terms, lengths.cumsum() - lengths) + lengths.astype(np.uint64)), begins


def gram_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; A-Z count as a-z. With fewer words than width the
    whole sequence is one gram; without words the set is empty."""
    lowered = [(text or b"").lower() for text in texts]  # bytes: A-Z alone
    data = b"\n".join(lowered)
    words, begins = word_hashes(data)
    ends = np.cumsum([len(x) + 1 for x in lowered])
    edges = np.concatenate([[0], np.searchsorted(begins, ends)]).tolist()
    out = []
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        own = words[first:last]
        n = len(own)
        if n == 0:
            out.append(own)
            continue
        size = min(width, n)
        grams = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            grams = mixed(grams ^ own[k : n - size + 1 + k]) + MIX
        out.append(np.unique(grams))
    return out


class Bands:
    """Bands of set sizes for the threshold num / den (den > num): bounds, largest difference, segments."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.tops = [0]  # band k has the sizes tops[k] + 1 .. tops[k + 1]
        self.room: dict[int, int] = {}  # differences by band

    def band(self, n: int) -> int:
        """Sizes in one band or the next below cover all partners: a partner of n has at most n * den / num elements."""
        while self.tops[-1] < n:
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * self.den // self.num))
        return int(np.searchsorted(self.tops, n)) - 1

    def most_apart(self, band: int) -> int:
        """The most elements in which two linked sets differ, the smaller of them in band."""
        self.band(self.tops[-1] + 1) if band + 1 >= len(self.tops) else None
        top = self.tops[band + 1]
        # |a| <= top and |b| <= |a| den / num; the difference is at most (den - num) / (den + num) of both.
        return (self.den - self.num) * (top + top * self.den // self.num) // (self.den + self.num)

    def differences(self, band: int) -> int:
        """The differences that the segments of a band, one more, make room for: most_apart() or more.

        So many that the band's smallest sets fill more than most_apart() segments, by three standard deviations;
        at most three segments for each of most_apart() + 1.
        """
        if band not in self.room:
            needed = self.most_apart(band) + 1
            some = np.arange(needed, 3 * needed + 1)
            load = (self.tops[band] + 1) / some
            free = np.exp(-load)
            deviation = np.sqrt(some * free * np.maximum(0, 1 - (1 + load) * free))
            enough = np.append(np.flatnonzero(some * (1 - free) - 3 * deviation >= needed), len(some) - 1)
            self.room[band] = int(some[enough[0]]) - 1 if needed > 1 else 0
        return self.room[band]


def slot_of(band: int, segments: np.ndarray) -> np.ndarray:
    """A number of SLOT_BITS for each segment of a band; the lowest bits of its keys."""
    return mixed(segments.astype(np.uint64) + np.uint64(band << 32)) & SLOTS


def segment_keys(grams: np.ndarray, band: int, bands: Bands, budgets: dict[int, np.ndarray]) -> np.ndarray:
    """Keys of one set in one band; a band without budgets has 1 for each of its segments.

    Where the segments with elements have budgets of more than bands.most_apart(band), one of them stays within
    its budget, so that empty ones with budget 1 need no keys.
    """
    given = budgets.get(band)
    segments = bands.differences(band) + 1 if given is None else len(given)
    at = (mixed(grams + np.uint64(band)) % np.uint64(segments)).astype(np.int64)
    # A segment's content is the sum of its elements' hashes: a deletion is a subtraction.
    terms = mixed(grams ^ np.uint64(0x5851F42D4C957F2D))
    order = np.argsort(at, kind="stable")
    sums = np.zeros(segments, dtype=np.uint64)
    counts = np.bincount(at, minlength=segments)
    filled = np.flatnonzero(counts)
    sums[filled] = np.add.reduceat(terms[order], (counts.cumsum() - counts)[filled])
    slots = slot_of(band, np.arange(segments))

    def named(content: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return (mixed(content ^ mixed(slot + np.uint64(band << 32))) & ~SLOTS) | slot

    if given is None:
        used = filled if len(filled) > bands.most_apart(band) else np.arange(segments)
        return named(sums[used], slots[used]).astype(np.int64)
    enough = given[filled].sum() > bands.most_apart(band)
    used = np.flatnonzero((given == 2) | (given == 1) & ((counts > 0) | ~enough))
    cut = np.flatnonzero(given[at] == 2)
    keys = np.concatenate([named(sums[used], slots[used]), named(sums[at[cut]] - terms[cut], slots[at[cut]])])
    return np.unique(keys).astype(np.int64)


def odd_sketch(grams: np.ndarray, band: int, bands: Bands) -> bytes:
    """Parities of the numbers of elements in SKETCH buckets for each difference that a link may have.

    Two sketches of a band differ in no more bits than their sets do in elements.
    """
    size = SKETCH * (bands.differences(band) // 2 + 1)
    at = (mixed(grams ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(8 * size)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=8 * size).astype(np.uint8) & 1).tobytes()


def may_link(a: tuple, b: tuple, bands: Bands, num: int, den: int) -> bool:
    """False where sizes or sketches rule a link out; a, b: (n, band, sketch, low_sketch)."""
    (small, large) = (a, b) if a[0] <= b[0] else (b, a)
    if den * small[0] < num * large[0] or large[1] - small[1] > 1:
        return False
    other = large[2] if large[1] == small[1] else large[3]
    bits = (int.from_bytes(small[2]) ^ int.from_bytes(other)).bit_count()
    return bits <= (den - num) * (a[0] + b[0]) // (den + num)


def keyed_documents(docs: DataFrame, width: int, num: int, den: int, budgets: dict[int, np.ndarray]) -> DataFrame:
    """KEYED: size of the set, the first document of the task with the same set, and the set's keys.

    Only that first document has keys, so that very many copies of a text have no more keys than tasks. A row
    without doc_id is nobody's first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, first = Bands(num, den), {}
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(begin, end - begin)
                sets = gram_sets(texts, width)
                same, keys, marks = [], [], []
                for doc_id, grams in zip(ids.to_pylist(), sets, strict=True):
                    name = (len(grams), mixed(grams).sum(dtype=np.uint64), mixed(grams ^ MIX).sum(dtype=np.uint64))
                    known = first.setdefault(name, doc_id) if len(grams) and doc_id is not None else doc_id
                    same.append(known)
                    own = bands.band(len(grams)) if len(grams) else -1
                    marks.append((own, odd_sketch(grams, own, bands) if own >= 0 else b"", odd_sketch(grams, own - 1, bands) if own > 0 else b""))
                    used = [band for band in (own, own - 1) if band >= 0] if len(grams) and known == doc_id and doc_id is not None else []
                    keys.append(np.concatenate([np.zeros(0, dtype=np.int64), *[segment_keys(grams, band, bands, budgets) for band in used]]))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.record_batch(
                    [ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(same, pa.int64()), pa.array([x[0] for x in marks], pa.int32()), pa.array([x[1] for x in marks], pa.binary()), pa.array([x[2] for x in marks], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *keys])))],
                    names=[x.split()[0] for x in KEYED.split(", ")],
                )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(released(run), KEYED)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """HITS: (key, center, doc_id) for keys of two documents or more; center is the first document of the key.

    Sorted by key, so that a task streams over keys of any size and holds one row of a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_doc, told = None, None, False
        for batch in batches:
            keys, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            fresh = np.ones(len(keys), dtype=bool)
            fresh[1:] = keys[1:] != keys[:-1]
            fresh[0] = last_key is None or keys[0] != last_key
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
            center = np.where(at >= 0, docs[at], last_doc if last_doc is not None else 0)
            follow = ~fresh
            named = np.zeros(len(keys), dtype=bool)  # centers that have a second document
            named[at[follow & (at >= 0)]] = True
            out = follow | named
            parts = [(keys[out], center[out], docs[out])]
            if not fresh[0] and not told:
                parts.append((np.array([last_key]), np.array([last_doc]), np.array([last_doc])))
            for k, c, d in parts:
                if len(k):
                    yield pa.record_batch([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["key", "center", "doc_id"])
            # told: whether the center of the last key has been written.
            told = bool(named[at[-1]]) if at[-1] >= 0 else True
            last_key, last_doc = int(keys[-1]), int(center[-1])

    rows = keyed.select(F.explode("keys").alias("key"), "doc_id")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "doc_id").mapInArrow(released(run), HITS)


def allocate(hits: DataFrame, n_keys: int, sizes: list[int], num: int, den: int) -> dict[int, np.ndarray]:
    """Budgets of the bands in which moving them pays.

    The cost of a segment is the number of rows that its open keys lay out in blocks: the documents beside the
    center, and once more for every CHUNK outer documents that they meet. A key is open while it has several
    components beside the center; hits without labels count every document as a component. A segment far above
    the others goes from 1 to 0, and another goes from 1 to 2, which costs some DELETIONS keys for each of its
    documents. As all keys are made anew then, what is saved must exceed their number. Costs are summed over all
    keys; only those of segments far above the mean come to the driver.
    """
    slot = F.col("key").bitwiseAND(int(SLOTS)).alias("slot")
    costs = hits.groupBy(slot).agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id") == F.col("center")).alias("keys"))
    mean = costs.agg(F.avg("rows")).head()[0] or 0.0
    crowded = (F.col("rows") > 16 * F.lit(mean)) & (F.col("rows") > DELETIONS * F.col("keys"))
    found = [row.slot for row in costs.where(crowded).select("slot").collect()]  # bounded: a sixteenth of the slots
    if not found:
        return {}
    if "label" not in hits.columns:
        hits = hits.withColumns({"label": F.col("doc_id"), "center_label": F.col("center")})
    few = F.broadcast(hits.sparkSession.createDataFrame([(x,) for x in found], "slot long"))
    others = hits.where("doc_id != center").withColumn("slot", slot).join(few, "slot")
    by_key = others.groupBy("slot", "key").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("center_label")).alias("n_outer"), F.min("label").alias("low"), F.max("label").alias("high"))
    work = by_key.where("low != high and n_outer > 0").groupBy("slot").agg(F.sum(F.col("n") + F.col("n") * F.col("n_outer") / CHUNK).alias("work")).collect()
    hot = {row.slot for row in work}
    if sum(row.work for row in work) <= n_keys:
        return {}
    bands, out = Bands(num, den), {}
    if not hot or not sizes:
        return out
    for band in range(bands.band(max(sizes)) + 1):
        segments = bands.differences(band) + 1
        costly = np.flatnonzero(np.isin(slot_of(band, np.arange(segments)).astype(np.int64), sorted(hot)))
        # As many cheap segments must be there to take the budget over.
        if len(costly) and 2 * len(costly) <= segments:
            budget = np.ones(segments, dtype=np.int8)
            budget[costly] = 0
            budget[np.flatnonzero(budget)[: len(costly)]] = 2
            out[band] = budget
    return out


def are_linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray | bool:
    return den * common >= num * (a + b - common)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted arrays share."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents named in ids (doc_id), filtered where they are read if there are few, so that other texts aren't shuffled."""
    ids = ids.select("doc_id").distinct()
    return docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else docs


def _with_chunks(members: DataFrame, star: str, size: int) -> DataFrame:
    """members with chunk, so that no chunk of a star has many more than size rows."""
    counts = members.groupBy(star).agg(F.ceil(F.count("*") / size).alias("chunks"))
    return members.join(counts, star).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))


def possible(edges: DataFrame, keyed: DataFrame, num: int, den: int) -> DataFrame:
    """The edges (center, doc_id) that sizes and sketches don't rule out; a sketch is far smaller than a text."""
    marks = keyed.select("doc_id", F.struct("n", "band", "sketch", "low_sketch").alias("mark"))
    both = edges.join(marks, "doc_id").join(marks.select(F.col("doc_id").alias("center"), F.col("mark").alias("center_mark")), "center").select("center", "doc_id", "center_mark", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            left, right = ([tuple(x.values()) for x in batch.column(k).to_pylist()] for k in (2, 3))
            kept = pa.array([may_link(a, b, bands, num, den) for a, b in zip(left, right, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["center", "doc_id"])

    return both.mapInArrow(released(run), "center long, doc_id long")


def star_links(edges: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(center, doc_id, linked) for edges (center, doc_id): the document's set compared with the center's.

    A star goes through tasks in chunks, the center first in each; a task holds one center at a time.
    """
    members = _with_chunks(edges, "center", CHUNK)
    members = members.select("center", "chunk", "doc_id", F.lit(1).alias("role"))
    centers = members.select("center", "chunk").distinct().select("center", "chunk", F.col("center").alias("doc_id"), F.lit(0).alias("role"))
    needed = edges.select("doc_id").unionByName(edges.select(F.col("center").alias("doc_id")))
    visits = members.unionByName(centers).join(only(docs, needed), "doc_id").select("center", "chunk", "role", "doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            roles, ids, names = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist()
            for begin, end, texts in text_slices(batch.column(4), 1 << 20):
                out = []
                for k, grams in enumerate(gram_sets(texts, width), begin):
                    if roles[k] == 0:
                        center = grams
                    else:
                        out.append((names[k], ids[k], bool(are_linked(overlap(center, grams), len(center), len(grams), num, den))))
                if out:
                    yield pa.record_batch([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["center", "doc_id", "linked"])

    return visits.repartition(parts, "center", "chunk").sortWithinPartitions("center", "chunk", "role", "doc_id").mapInArrow(released(run), "center long, doc_id long, linked boolean")


def block_links(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of left, rows of right) that are linked: overlaps as products of 0/1 matrices, some elements at a time.

    Elements that only one side has can't be shared; a set with too few others is left out.
    """
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes, strict=True)]
    shared = np.intersect1d(flat[0], flat[1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    hold = []
    for f, o, n in zip(flat, owner, sizes, strict=True):
        at = np.minimum(np.searchsorted(shared, f), max(0, len(shared) - 1))
        known = shared[at] == f if len(shared) else np.zeros(len(f), dtype=bool)
        enough = den * np.bincount(o[known], minlength=len(n)) >= num * n
        hold.append((at[known], o[known], np.flatnonzero(enough)))
    (at_l, own_l, rows_l), (at_r, own_r, rows_r) = hold
    if not len(rows_l) or not len(rows_r):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    place = [np.full(len(n), -1) for n in sizes]
    place[0][rows_l], place[1][rows_r] = np.arange(len(rows_l)), np.arange(len(rows_r))
    common = np.zeros((len(rows_l), len(rows_r)), dtype=np.float32)
    order_l, order_r = np.argsort(at_l, kind="stable"), np.argsort(at_r, kind="stable")
    at_l, own_l, at_r, own_r = at_l[order_l], place[0][own_l[order_l]], at_r[order_r], place[1][own_r[order_r]]
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        sides = []
        for at, own, rows in ((at_l, own_l, rows_l), (at_r, own_r, rows_r)):
            part = slice(*np.searchsorted(at, [low, low + width]))
            matrix = np.zeros((len(rows), width), dtype=np.float32)
            kept = own[part] >= 0
            matrix[own[part][kept], at[part][kept] - low] = 1
            sides.append(matrix)
        common += sides[0] @ sides[1].T
    a, b = np.nonzero(are_linked(common, sizes[0][rows_l][:, None], sizes[1][rows_r][None, :], num, den))
    return rows_l[a], rows_r[b]


def labelled(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """hits with the components of the document (label) and of the center (center_label)."""
    label = parts.select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
    center = parts.select(F.col("id").alias("center"), F.col("component").alias("center_label"))
    named = hits.join(label, "doc_id", "left").join(center, "center", "left")
    return named.withColumn("label", F.coalesce("label", "doc_id")).withColumn("center_label", F.coalesce("center_label", "center"))


def open_stars(hits: DataFrame) -> DataFrame:
    """(center, doc_id, label, outer) of documents that share a key with one of another component, neither its center.

    hits: as from labelled(). Only keys with several components beside the center are open. outer: not in the
    center's component.
    """
    others = hits.where("doc_id != center").withColumn("outer", F.col("label") != F.col("center_label"))
    open_keys = others.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    return others.join(open_keys, "key", "left_semi").select("center", "doc_id", "label", "outer").distinct()


def in_blocks(members: DataFrame, details: DataFrame) -> DataFrame:
    """(center, x, y, side, doc_id, label, outer, details...): blocks x of outer documents (side 0) beside blocks y of
    all documents of the star (side 1), sorted so that a task meets two blocks of CHUNK documents after each other.

    Blocks are laid out on ids; the details (doc_id, ...) join them once.
    """
    members = _with_chunks(members, "center", CHUNK)
    every = F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)
    left = members.where("outer").select("center", F.col("chunk").alias("x"), F.explode(every).alias("y"), F.lit(0).alias("side"), "doc_id", "label", "outer")
    # A right block is needed only where the left one has documents.
    wanted = members.where("outer").select("center", F.col("chunk").alias("x")).distinct()
    right = members.join(wanted, "center").select("center", "x", F.col("chunk").alias("y"), F.lit(1).alias("side"), "doc_id", "label", "outer")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = [name for name in details.columns if name != "doc_id"]
    visits = left.unionByName(right).join(details, "doc_id").select("center", "x", "y", "side", "doc_id", "label", "outer", *more)
    return visits.repartition(parts, "center", "x", "y").sortWithinPartitions("center", "x", "y", "side", "doc_id")


def near_sketches(members: DataFrame, keyed: DataFrame, num: int, den: int) -> DataFrame:
    """The members (center, doc_id, label, outer) for which sizes and sketches leave a link with another component
    of their star possible. Sketches of two blocks are compared in matrices of bits."""
    rows = in_blocks(members, keyed.select("doc_id", "n", "band", "sketch", "low_sketch"))

    def partners(left: list[tuple], right: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row of left and of right has a possible partner of another label on the other side."""
        hit_l, hit_r = np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)
        for shift in (-1, 0, 1):  # the right band is that of the left one, or a neighbour
            for band in {x[4] for x in left}:
                a = [k for k, x in enumerate(left) if x[4] == band]
                b = [k for k, x in enumerate(right) if x[4] == band + shift]
                if not a or not b:
                    continue
                # Both sketches of the lower band.
                raw = [np.array([np.frombuffer(side[k][6 if own > low else 5], dtype=np.uint8) for k in of]) for side, of, own, low in ((left, a, band, min(band, band + shift)), (right, b, band + shift, min(band, band + shift)))]
                sizes = [np.array([side[k][3] for k in of]) for side, of in ((left, a), (right, b))]
                labels = [np.array([side[k][1] for k in of]) for side, of in ((left, a), (right, b))]
                for at, k in enumerate(a):
                    total = sizes[0][at] + sizes[1]
                    fits = (den * np.minimum(sizes[0][at], sizes[1]) >= num * np.maximum(sizes[0][at], sizes[1])) & (labels[0][at] != labels[1])
                    few = np.flatnonzero(fits)
                    if len(few):
                        bits = np.bitwise_count(raw[1][few] ^ raw[0][at]).sum(1, dtype=np.int64)
                        near = few[bits <= (den - num) * total[few] // (den + num)]
                        if len(near):
                            hit_l[k] = True
                            hit_r[np.array(b)[near]] = True
        return hit_l, hit_r

    def finish(center: int, sides: list[list[tuple]]) -> list[tuple]:
        if not sides[0] or not sides[1]:
            return []
        left, right = partners(*sides)
        return [(center, x[0], x[1], x[2]) for side, hit in zip(sides, (left, right), strict=True) for x, h in zip(side, hit, strict=True) if h]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, [[], []]

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["center", "doc_id", "label", "outer"])

        for batch in batches:
            block = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            side = batch.column(3).to_pylist()
            own = list(zip(*(batch.column(k).to_pylist() for k in range(4, 11)), strict=True))
            out: list[tuple] = []
            for name, which, row in zip(block, side, own, strict=True):
                if name != now:
                    out += finish(now[0], sides) if now else []
                    now, sides = name, [[], []]
                sides[which].append(row)
            if out:
                yield told(out)
        if now and (out := finish(now[0], sides)):
            yield told(out)

    return rows.mapInArrow(released(run), "center long, doc_id long, label long, outer boolean").distinct()


def open_star_links(members: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between members (center, doc_id, label, outer) of a star with different labels.

    Blocks of the outer documents meet blocks of all documents of the star; of the links between two
    components a pair of blocks returns one.
    """
    visits = in_blocks(members, only(docs, members))

    def finish(sides: list[list[tuple[int, int, np.ndarray]]]) -> list[tuple[int, int]]:
        left, right = sides
        if not left or not right:
            return []
        a, b = block_links([x[2] for x in left], [x[2] for x in right], num, den)
        label_a, label_b = np.array([x[1] for x in left])[a], np.array([x[1] for x in right])[b]
        at = np.flatnonzero(label_a != label_b)
        _, first = np.unique(np.stack([label_a[at], label_b[at]]), axis=1, return_index=True)
        return [(left[a[k]][0], right[b[k]][0]) for k in at[first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, [[], []]
        for batch in batches:
            block = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            side, ids, labels = (batch.column(k).to_pylist() for k in (3, 4, 5))
            out: list[tuple[int, int]] = []
            for begin, _, texts in text_slices(batch.column(7), 1 << 20):
                for k, grams in enumerate(gram_sets(texts, width), begin):
                    if block[k] != now:
                        out += finish(sides)
                        now, sides = block[k], [[], []]
                    sides[side[k]].append((ids[k], labels[k], grams))
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
        if out := finish(sides):
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return visits.mapInArrow(released(run), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents (doc_id, text); others columns are left out.

    Two documents link where den * |intersection| >= num * |union| of their sets of word n-grams. component_id is
    the smallest doc_id that links reach. A null or blank text has an empty set and no link; a row without
    doc_id has none either. Rows that repeat a doc_id share its component.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    if _repeats(docs):
        return _by_rows(docs, width, num, den)
    keyed, hits, n_keys = _shared(docs, width, num, den, {})
    largest = keyed.agg(F.max("n")).head()[0]
    # What crowded keys cost at most; what they really cost shows after the first links.
    budgets = allocate(hits, n_keys, [largest] if largest else [], num, den)
    texts, marks = docs, keyed
    # First every document meets the smallest of its centers, then those centers that are still apart from it.
    edges = staged(hits.where("doc_id != center").groupBy("doc_id").agg(F.min("center").alias("center")).select("center", "doc_id"), "first-centers")
    first = staged(star_links(staged(possible(edges, marks, num, den), "star-edges"), texts, width, num, den), "star-links")
    parts = connected_components(_ends(first).unionByName(_copies(keyed)))
    if budgets:
        budgets = allocate(labelled(hits, parts), n_keys, [largest], num, den)
    if budgets:
        # The same sets by other keys; a copy may have another first document now.
        again, hits, _ = _shared(docs, width, num, den, budgets)
        parts = _joined(parts, _copies(again))
    apart = labelled(hits.where("doc_id != center"), parts).where("label != center_label").select("center", "doc_id").distinct()
    later = staged(possible(apart.join(edges, ["center", "doc_id"], "left_anti"), marks, num, den), "star-edges")
    parts = _joined(parts, _ends(staged(star_links(later, texts, width, num, den), "star-links")))
    members = staged(near_sketches(staged(open_stars(labelled(hits, parts)), "open-stars"), marks, num, den), "open-stars")
    parts = _joined(parts, staged(open_star_links(members, texts, width, num, den), "open-links"))
    out = keyed.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _shared(docs: DataFrame, width: int, num: int, den: int, budgets: dict[int, np.ndarray]) -> tuple[DataFrame, DataFrame, int]:
    """(documents without their keys, HITS, number of keys); the keys themselves are removed once they are compared."""
    path = new_folder(docs.sparkSession, "set-keys")
    keyed_documents(docs, width, num, den, budgets).write.parquet(path)
    keyed = docs.sparkSession.read.schema(KEYED).parquet(path)
    n_keys = keyed.agg(F.sum(F.size("keys"))).head()[0] or 0
    hits = staged(shared_keys(keyed), "shared-keys")
    plain = staged(keyed.drop("keys"), "set-sizes")
    drop_folder(docs.sparkSession, path)
    return plain, hits, n_keys


def _copies(keyed: DataFrame) -> DataFrame:
    return keyed.where("same_as != doc_id").select(F.col("doc_id").alias("a"), F.col("same_as").alias("b"))


def _ends(found: DataFrame) -> DataFrame:
    return found.where("linked").select(F.col("center").alias("a"), F.col("doc_id").alias("b"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a, b)."""
    if not links.head(1):
        return parts
    return connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id occurs more than once."""
    return bool(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").head(1))


def _by_rows(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """near_duplicates where doc_ids repeat: every row links by its own text under an id of its own, then the rows of a doc_id join."""
    row_id = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = staged(docs.withColumn("row_id", row_id), "text-rows")
    found = near_duplicates(rows.select(F.col("row_id").alias("doc_id"), "text"), width, num, den).withColumnRenamed("doc_id", "row_id")
    found = staged(found.join(rows.select("row_id", "doc_id"), "row_id", "left"), "row-components")
    firsts = found.where(F.col("doc_id").isNotNull()).groupBy("component_id").agg(F.min("doc_id").alias("b"))
    parts = connected_components(found.join(firsts, "component_id").select(F.col("doc_id").alias("a"), "b").distinct())
    out = found.select("doc_id", "n_shingles").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
