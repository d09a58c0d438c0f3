"""Merkle trees over tables, stored as aligned blocks in van Emde Boas order.

Rows with the same chain are the leaves of one tree, in a given order. A tree is cut into aligned subtrees
of HEIGHT levels; each is one row of a table, its nodes laid out by the recursive split at half height. The
roots of the blocks are the leaves of the next table, until one block remains. The roots of all chains, in
order of the chains, are the leaves of one more tree. A proof reads one path through each block, by address
arithmetic alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions.bounds import broadcast_if_small
from patchlake.llm.storage import new_folder, staged

HEIGHT = 8  # levels of a block below its root: 256 leaves, 16 KB of digests
SIZE = 32  # bytes of a digest
BATCH = 64  # blocks of one Arrow batch in Python

CHAIN, INDEX, COUNT, LEAF = "__llm_chain", "__llm_index", "__llm_count", "__llm_leaf"
BLOCKS = f"{CHAIN} string, block long, levels int, n int, single boolean, keys array<long>, others array<binary>, nodes binary"


def digest_of(*columns: Column) -> Column:
    """Lowercase hex sha256 of the values one after another: `-` if null, else UTF-8 byte count, `:`, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def chain_name(column: Column) -> Column:
    """A name that is never null and sorts like the column, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


# ---- addresses ----------------------------------------------------------------


def address(levels: int, depth: int, index):
    """Place of node `index` at `depth` (root: 0) in a tree of `levels` levels; index may be an array.

    The upper half of the levels lies first, then the subtrees below it from left to right, each laid out alike.
    """
    base = index * 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        bottom, depth = levels - top, depth - top
        base = base + ((1 << top) - 1) + (index >> depth) * ((1 << bottom) - 1)
        index, levels = index & ((1 << depth) - 1), bottom
    return base


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build_block(leaves: list[str], levels: int) -> bytes:
    """The nodes of one subtree. Two consecutive nodes become their hash; one left over becomes its own."""
    out = bytearray(SIZE * ((1 << levels) - 1))
    level = leaves
    for depth in range(levels - 1, -1, -1):
        for place, node in zip(address(levels, depth, np.arange(len(level))).tolist(), level, strict=True):
            out[SIZE * place : SIZE * place + SIZE] = bytes.fromhex(node)
        level = [_hash("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return bytes(out)


def paths_of(nodes: bytes, n: int, levels: int) -> list[list[tuple[str, str] | None]]:
    """For each leaf, from below: ("L" or "R", sibling on that side), or None where the node stands alone."""
    out: list[list] = [[] for _ in range(n)]
    width = n
    for depth in range(levels - 1, 0, -1):
        places = address(levels, depth, np.arange(width)).tolist()
        hexes = [nodes[SIZE * p : SIZE * p + SIZE].hex() for p in places]
        steps = [("L", hexes[j - 1]) if j & 1 else ("R", hexes[j + 1]) if j + 1 < width else None for j in range(width)]
        shift = levels - 1 - depth
        for leaf in range(n):
            out[leaf].append(steps[leaf >> shift])
        width = -(-width // 2)
    return out


def fold(node: str, path: list[tuple[str, str] | None]) -> str:
    """The root that follows from a node and its siblings."""
    for step in path:
        node = _hash(node) if step is None else _hash(step[1] + node) if step[0] == "L" else _hash(node + step[1])
    return node


def pack(path: list[tuple[str, str] | None]) -> bytes:
    return b"".join(b"N" if step is None else step[0].encode() + bytes.fromhex(step[1]) for step in path)


def unpack(packed: bytes) -> list[tuple[str, str] | None]:
    out, at = [], 0
    while at < len(packed):
        side = chr(packed[at])
        out.append(None if side == "N" else (side, packed[at + 1 : at + 1 + SIZE].hex()))
        at += 1 if side == "N" else 1 + SIZE
    return out


# ---- trees ----------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with INDEX, the place within the chain from 0, and COUNT, the rows of the chain.

    Range partitions are sorted and counted; only their counts, one row per partition and chain, are summed
    up. Rows that are equal in all of `order` are dealt to several partitions: which comes first is no matter.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [CHAIN, *order, "__llm_salt"]
    salted = rows.withColumn("__llm_salt", F.monotonically_increasing_id() % 997)
    ordered = salted.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__llm_salt")
    laid = staged(ordered.withColumn("__llm_at", F.monotonically_increasing_id()), "merkle-leaves")
    part = F.shiftright("__llm_at", 33).alias("__llm_part")
    counts = laid.groupBy(CHAIN, part).agg(F.count("*").alias("__llm_n"), F.min("__llm_at").alias("__llm_first"))
    counts = counts.selectExpr(
        "*",
        f"sum(__llm_n) OVER (PARTITION BY {CHAIN} ORDER BY __llm_part) - __llm_n AS __llm_before",
        f"sum(__llm_n) OVER (PARTITION BY {CHAIN}) AS {COUNT}",
    ).drop("__llm_n")
    joined = laid.withColumn("__llm_part", part).join(broadcast_if_small(counts), [CHAIN, "__llm_part"])
    joined = joined.withColumn(INDEX, F.col("__llm_at") - F.col("__llm_first") + F.col("__llm_before"))
    return joined.drop("__llm_part", "__llm_first", "__llm_before", "__llm_at")


@dataclass(frozen=True)
class Tree:
    """The tables of one forest of chains, from the leaves up, and the chains' roots (CHAIN, root)."""

    levels: list[DataFrame]
    roots: DataFrame


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """(chain, block...) from (chain, INDEX, COUNT, LEAF, key, other)."""
    entry = F.struct(F.col(INDEX).alias("i"), F.col("key"), F.col(LEAF).alias("leaf"), F.col("other"))
    grouped = leaves.groupBy(CHAIN, F.shiftright(INDEX, height).alias("block"), COUNT).agg(F.sort_array(F.collect_list(entry)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                out: list[list] = [[] for _ in range(8)]
                for chain, block, count, rows in zip(*(c.to_pylist() for c in batch.slice(begin, BATCH).columns), strict=True):
                    single = count <= 1 << height
                    levels = (count - 1).bit_length() + 1 if single else height + 1
                    nodes = build_block([r["leaf"].hex() for r in rows], levels)
                    row = [chain, block, levels, len(rows), single, [r["key"] for r in rows], [r["other"] for r in rows], nodes]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
                names = [CHAIN, "block", "levels", "n", "single", "keys", "others", "nodes"]
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    return grouped.mapInArrow(run, BLOCKS)


def build(leaves: DataFrame, folder: str, height: int = HEIGHT) -> Tree:
    """Writes the tables of the trees over (CHAIN, INDEX, COUNT, LEAF hex, key, other) below folder.

    Block roots go on as leaves while a chain has more than one block. key and other are kept beside the
    leaves. An empty table gives an empty tree.
    """
    spark = leaves.sparkSession
    levels: list[DataFrame] = []
    rows = leaves.select(CHAIN, INDEX, COUNT, F.unhex(LEAF).alias(LEAF), "key", "other")
    # The node at depth 0 comes first in every layout.
    root = F.col("nodes").substr(1, SIZE)
    while True:
        path = f"{folder}/level={len(levels)}"
        _blocks(rows, height).write.parquet(path)
        levels.append(spark.read.schema(BLOCKS).parquet(path))
        more = levels[-1].where(~F.col("single"))
        if not more.head(1):
            break
        sizes = more.groupBy(CHAIN).agg(F.count("*").alias(COUNT))
        up = more.select(CHAIN, F.col("block").alias(INDEX), root.alias(LEAF), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("other"))
        rows = up.join(broadcast_if_small(sizes), CHAIN)
    found = [table.where("single").select(CHAIN, F.lower(F.hex(root)).alias("root")) for table in levels]
    roots = found[0]
    for more in found[1:]:
        roots = roots.unionByName(more)
    return Tree(levels, roots)


PATHS = f"{CHAIN} string, index long, path binary"


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(chain, index, path) of the leaves of `blocks`; above: the (chain, block, path) of the blocks' roots."""
    joined = blocks.select(CHAIN, "block", "n", "levels", "nodes").join(broadcast_if_small(above), [CHAIN, "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                chains, at, out = [], [], []
                for chain, block, n, levels, nodes, up in zip(*(c.to_pylist() for c in batch.slice(begin, BATCH).columns), strict=True):
                    inner = paths_of(nodes, n, levels)
                    chains += [chain] * n
                    at += [(block << (levels - 1)) + i for i in range(n)]  # only blocks of full height have successors
                    out += [pack(path) + up for path in inner]
                yield pa.record_batch([pa.array(chains, pa.string()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=[CHAIN, "index", "path"])

    return joined.select(CHAIN, "block", "n", "levels", "nodes", "path").mapInArrow(run, PATHS)


def paths_to_blocks(tree: Tree, tops: DataFrame) -> DataFrame:
    """(chain, block, path, ...) of the lowest blocks: siblings from the block's root up; tops holds the
    (chain, path) of the chains' roots."""
    tops = tops.select(CHAIN, "path")
    above = None
    for table in reversed(tree.levels):
        singles = table.where("single").select(CHAIN, "block").join(broadcast_if_small(tops), CHAIN)
        if above is not None:
            singles = singles.unionByName(above)
        if table is tree.levels[0]:
            return singles
        inner = _paths(table, singles)
        above = staged(inner.select(CHAIN, F.col("index").alias("block"), "path"), "merkle-paths")
    raise AssertionError("a tree has a table")


@dataclass(frozen=True)
class Manifest:
    """The trees of the chains, the tree over their roots, and (chain, subroot, root, path) of each chain."""

    chains: Tree
    top: Tree
    roots: DataFrame


def manifest(rows: DataFrame, folder: str, order: list[str], height: int = HEIGHT) -> Manifest:
    """Trees over rows (CHAIN, LEAF hex, key long, other binary, columns of order), and one over their roots.

    Leaves of a chain ascend by `order`, null first; chains ascend bytewise. `other` is a second digest that
    `proofs` folds instead of the leaf where it isn't null.
    """
    chains = build(numbered(rows, order), f"{folder}/chains", height)
    subroots = staged(chains.roots, "merkle-roots")
    leaves = subroots.select(F.lit("").alias(CHAIN), F.col(CHAIN).alias("name"), F.col("root").alias(LEAF), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("other"))
    placed = staged(numbered(leaves, ["name"]), "merkle-top")
    top = build(placed, f"{folder}/top", height)
    none = top.roots.select(CHAIN, F.lit(b"").alias("path"))
    paths = _paths(top.levels[0], paths_to_blocks(top, none))
    named = placed.select("name", F.col(INDEX).alias("index"), F.unhex(LEAF).alias("subroot"))
    joined = named.join(paths.select("index", "path"), "index").withColumn("root", top.roots.select("root").scalar())
    roots = joined.select(F.col("name").alias(CHAIN), F.lower(F.hex("subroot")).alias("subroot"), "root", "path")
    return Manifest(chains, top, staged(roots, "merkle-chains"))


PROOFS = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(made: Manifest) -> DataFrame:
    """One row per leaf: key, leaf, subroot, root, digest of its siblings, the root folded from `other` (else the
    leaf) and the siblings, and whether that is the root.

    What leaves of a block fold to is folded on to the root once for each digest.
    """
    blocks, above = made.chains.levels[0], paths_to_blocks(made.chains, made.roots)
    joined = blocks.join(broadcast_if_small(above), [CHAIN, "block"]).join(broadcast_if_small(made.roots.drop("path")), CHAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PROOFS.split(", ")]
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                out: list[list] = [[] for _ in names]
                for n, levels, keys, others, nodes, packed, subroot, root in zip(*(c.to_pylist() for c in batch.slice(begin, BATCH).columns), strict=True):
                    up = unpack(packed)
                    upper = "".join(step[1] for step in up if step)
                    known: dict[str, str] = {}
                    leaves = [nodes[SIZE * p : SIZE * p + SIZE].hex() for p in address(levels, levels - 1, np.arange(n)).tolist()]
                    for key, leaf, other, path in zip(keys, leaves, others, paths_of(nodes, n, levels), strict=True):
                        node = fold(leaf if other is None else other.hex(), path)
                        if node not in known:
                            known[node] = fold(node, up)
                        proof = _hash("".join(step[1] for step in path if step) + upper)
                        for column, value in zip(out, (key, leaf, subroot, root, proof, known[node], known[node] == root), strict=True):
                            column.append(value)
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    return joined.select("n", "levels", "keys", "others", "nodes", "path", "subroot", "root").mapInArrow(run, PROOFS)


def document_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of all documents, one tree per lang.

    A leaf is the digest of doc_id, source, lang, n_chars and text, null values included; other columns have no
    part in it. Leaves of a lang ascend by doc_id (null first), then by digest where a doc_id repeats; equal rows
    are leaves of their own. Where 7 divides the crc32 of the doc_id, the folded digest is the one with n_chars
    + 1 (a null stays, so such a row still verifies). A lang of one document has its leaf as subroot; a table
    of one lang has the subroot as root; the siblings of a lone document are the empty text. An empty table
    gives no rows.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(
        chain_name(F.col("lang")).alias(CHAIN),
        F.col("doc_id").cast("long").alias("key"),
        digest_of(*columns).alias(LEAF),
        F.when(tampered, F.unhex(digest_of(*changed))).alias("other"),
    )
    made = manifest(rows, new_folder(docs.sparkSession, "merkle"), ["key", LEAF], height)
    return proofs(made).withColumnRenamed("key", "doc_id")
