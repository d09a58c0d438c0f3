"""Ranked lexical search for many queries at once, by common-subexpression evaluation.

The score of a document for an item is a sum over the item's terms. Terms that the same items hold, and then
pairs of such sets that several items share, become nodes of a graph; the partial sum of a node is computed
once for each document and added into every node and item above it. The corpus is cut into terms once for a
block of items; frequencies cover all documents; each task keeps its best rows of every item.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlake.llm.storage import drop_folder, new_folder

# The characters of a term, and which of them are folded.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

BLOCK_BYTES = 1 << 20  # text of the items that are answered in one pass
CELLS = 1 << 20  # partial sums a task holds at once
WINDOW = 32  # nodes of an item that a new one is paired with
NO_ID = (1 << 63) - 1  # stands for a null doc_id, which comes last among equal scores


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(UPPER)) if text else []


# ---- the graph of shared sums --------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Nodes 0..len(leaf_term)-1 are (term, times); the others sum up earlier nodes, level by level; items sum up nodes.

    `steps` holds for each level the places of its nodes, their children one after another and the begin of
    each. `outputs` holds the last two for the items.
    """

    terms: list[str]
    leaf_term: np.ndarray
    leaf_times: np.ndarray
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    outputs: tuple[np.ndarray, np.ndarray]
    n_nodes: int


def mine(items: list[list[int]], n_leaves: int) -> tuple[list[list[int]], list[list[int]]]:
    """(nodes of every item, children of the nodes from n_leaves on): sets that several items share, each made once.

    Leaves with the same items are one set. Then the pair of nodes that most items share becomes a node of its
    own, again and again, until no two items share a pair. A node is paired with the WINDOW newest and most
    shared ones of an item, which keeps long items cheap; a pair not tried costs only a sum made twice.
    """
    made: list[list[int]] = []
    of: dict[int, set[int]] = defaultdict(set)
    for i, item in enumerate(items):
        for leaf in item:
            of[leaf].add(i)
    same = defaultdict(list)
    for leaf in sorted(of):
        same[tuple(sorted(of[leaf]))].append(leaf)
    parts: list[dict[int, None]] = [{} for _ in items]  # in order of insertion: the most shared and the newest last
    for holders, leaves in sorted(same.items(), key=lambda x: (len(x[0]), x[0])):
        if len(leaves) > 1 and len(holders) > 1:
            node = n_leaves + len(made)
            made.append(leaves)
            of[node] = set(holders)
            leaves = [node]
        for i in holders:
            parts[i].update(dict.fromkeys(leaves))
    pairs: Counter = Counter()
    for part in parts:
        shared = [node for node in part if len(of[node]) > 1]
        for k, node in enumerate(shared):
            pairs.update((node, other) if node < other else (other, node) for other in shared[max(0, k - WINDOW) : k])
    heap = [(-n, *pair) for pair, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = of[a] & of[b]
        if len(both) < 2:
            continue
        if len(both) < -n:
            heapq.heappush(heap, (-len(both), a, b))
            continue
        node = n_leaves + len(made)
        made.append([a, b])
        of[a], of[b], of[node] = of[a] - both, of[b] - both, both
        near: Counter = Counter()
        for i in sorted(both):
            del parts[i][a], parts[i][b]
            near.update(islice(reversed(parts[i]), WINDOW))
            parts[i][node] = None
        for other, times in near.items():
            if times > 1:
                heapq.heappush(heap, (-times, other, node))
    return [list(part) for part in parts], made


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    begins = np.cumsum([0, *(len(x) for x in lists)])[:-1]
    return np.array([x for part in lists for x in part], dtype=np.int64), begins.astype(np.int64)


def plan(texts: list[list[str]]) -> Plan:
    """The graph for items given as lists of terms; an item without terms must not be among them."""
    counts = [Counter(terms) for terms in texts]
    leaves = sorted({leaf for count in counts for leaf in count.items()})
    number = {leaf: i for i, leaf in enumerate(leaves)}
    parts, made = mine([[number[leaf] for leaf in count.items()] for count in counts], len(leaves))
    levels = [0] * len(leaves)
    for children in made:  # children come before
        levels.append(1 + max(levels[child] for child in children))
    steps = []
    for level in range(1, max(levels) + 1):
        nodes = [node for node in range(len(leaves), len(levels)) if levels[node] == level]
        steps.append((np.array(nodes), *_flat([made[node - len(leaves)] for node in nodes])))
    terms = sorted({term for term, _ in leaves})
    at = {term: i for i, term in enumerate(terms)}
    leaf_term = np.array([at[term] for term, _ in leaves], dtype=np.int64)
    times = np.array([n for _, n in leaves], dtype=np.int64)
    return Plan(terms, leaf_term, times, steps, _flat(parts), len(levels))


def evaluate(made: Plan, impacts: np.ndarray) -> np.ndarray:
    """Scores (items, documents) from the impacts (terms, documents), every shared sum computed once."""
    sums = np.empty((made.n_nodes, impacts.shape[1]), dtype=np.int64)
    n_leaves = len(made.leaf_term)
    np.multiply(impacts[made.leaf_term], made.leaf_times[:, None], out=sums[:n_leaves])
    for nodes, children, begins in made.steps:
        sums[nodes] = np.add.reduceat(sums[children], begins, axis=0)
    children, begins = made.outputs
    return np.add.reduceat(sums[children], begins, axis=0)


# ---- the corpus -------------------------------------------------------------------


COUNTED = "doc_id long, n long, terms binary, tfs binary"


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of terms of each document that has one, and how often each of the
    wanted terms, by number, occurs in it (32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(terms)}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                ids, ns, found, tfs = [], [], [], []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns), strict=True):
                    words = terms_of(text)
                    if not words:
                        continue
                    hits = [(number[word], n) for word, n in Counter(words).items() if word in number]
                    packed = np.array(hits, dtype="<u4").reshape(-1, 2)
                    ids.append(doc_id)
                    ns.append(len(words))
                    found.append(packed[:, 0].tobytes())
                    tfs.append(packed[:, 1].tobytes())
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip((ids, ns, found, tfs), kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTED)


def frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term: counted in the tasks, summed in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                joined = b"".join(batch.column(0).slice(begin, 1024).to_pylist())
                total += np.bincount(np.frombuffer(joined, "<u4"), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(n_terms, dtype=np.int64)
    for term, n in rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # bounded by the items' terms
        out[term] = n
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


class Best:
    """The k best (score descending, id ascending) of every item seen so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.ones(n_items, dtype=np.int64)  # a score above 0; later the k-th best
        self.scores = [np.zeros(0, dtype=np.int64)] * n_items
        self.ids = [np.zeros(0, dtype=np.int64)] * n_items

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= self.floor[:, None]
        for item in np.flatnonzero(fits.any(axis=1)).tolist():
            at = fits[item]
            score = np.concatenate([self.scores[item], scores[item, at]])
            doc = np.concatenate([self.ids[item], ids[at]])
            order = np.lexsort((doc, -score))[: self.k]
            self.scores[item], self.ids[item] = score[order], doc[order]
            if len(order) == self.k:
                self.floor[item] = self.scores[item][-1]


def _ranked(rows: DataFrame, made: Plan, weight: np.ndarray, n_docs: int, n_terms_all: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of each task."""
    n_items = len(made.outputs[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, width = Best(n_items, k), max(1, CELLS // made.n_nodes)
        for batch in batches:
            for begin in range(0, batch.num_rows, width):
                ids, ns, terms, tfs = (c.to_pylist() for c in batch.slice(begin, width).columns)
                m = np.array([25 + 75 * n * n_docs // n_terms_all for n in ns], dtype=np.int64)
                lengths = [len(x) // 4 for x in terms]
                term = np.frombuffer(b"".join(terms), "<u4")
                tf = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
                column = np.repeat(np.arange(len(ids)), lengths)
                impacts = np.zeros((len(made.terms), len(ids)), dtype=np.int64)
                impacts[term, column] = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[column]))
                best.add(evaluate(made, impacts), np.array([NO_ID if x is None else x for x in ids], dtype=np.int64))
        sizes = [len(x) for x in best.ids]
        item = np.repeat(np.arange(n_items), sizes)
        docs = np.concatenate(best.ids)
        columns = [pa.array(item, pa.int32()), pa.array(docs, mask=docs == NO_ID), pa.array(np.concatenate(best.scores))]
        yield pa.record_batch(columns, names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def _answer(items: list[tuple[int | None, str]], docs: DataFrame, k: int) -> DataFrame | None:
    texts = [(item_id, terms) for item_id, text in items if (terms := terms_of(text))]
    if not texts:
        return None
    spark = docs.sparkSession
    made = plan([terms for _, terms in texts])
    path = new_folder(spark, "search-counts")
    counted(docs, made.terms).write.parquet(path)
    rows = spark.read.schema(COUNTED).parquet(path)
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).head()
    if not total.docs:
        return None
    weight = weights(total.docs, frequencies(rows, len(made.terms)))
    out = new_folder(spark, "search-best")
    _ranked(rows, made, weight, total.docs, total.terms, k).write.parquet(out)
    drop_folder(spark, path)
    found = spark.read.schema("item int, doc_id long, score long").parquet(out)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(texts)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, score above 0, equal scores by doc_id.

    Items come in blocks of about BLOCK_BYTES of text, each one pass over all documents. Equal rows of an item
    are one; different texts under one item_id are answered each for itself. Null and empty texts, and those
    without a term, have no rows as items and don't count as documents. Rows of a repeated doc_id are documents
    of their own; a null doc_id comes last among equal scores. Other columns have no part in it.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for slot in range(n):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == slot) if n > 1 else asked
        rows = sorted(map(tuple, block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))  # a block of items
        answer = _answer(rows, docs, k)
        out = out if answer is None else out.unionByName(answer)
    return out
