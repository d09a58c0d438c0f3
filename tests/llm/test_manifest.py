"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from patchlake.llm import manifest_queries, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(None if i ^ 1 >= len(level) else (level[i ^ 1], i & 1))
        i >>= 1
    return out


def brute(rows):
    chains = {}
    for row in rows:
        chains.setdefault(row["lang"], []).append(row)
    names = sorted(chains, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        chains[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in chains[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(chains[name]):
            path = siblings(trees[name], i) + siblings(top, k)
            node = leaf(row)
            if row["n_chars"] is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
                node = leaf({**row, "n_chars": row["n_chars"] + 1})
            for step in path:
                node = sha(node) if step is None else sha(step[0] + node) if step[1] else sha(node + step[0])
            proof = sha("".join(step[0] for step in path if step))
            out.append((row["doc_id"], leaf(row), trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def rows_of(n, seed=5):
    rng = random.Random(seed)
    langs = ["en"] * 12 + ["fr", "dé", None, "", "z"]
    rows = [dict(doc_id=i, text=rng.choice(["a", "é" * 3, "", None, f"text {i}"]), lang=rng.choice(langs), source=rng.choice(["s", None]), n_chars=rng.choice([i, None])) for i in range(n)]
    return rows + [dict(rows[3]), dict(rows[3]), dict(rows[3], text="other"), dict(rows[5], doc_id=None), dict(rows[6], doc_id=None, lang=None), dict(rows[7], text="long " * 100_000)]


@pytest.mark.parametrize("levels", range(1, 11))
def test_address(levels):
    places = np.concatenate([merkle.address(levels, depth, np.arange(1 << depth)) for depth in range(levels)])
    assert sorted(places.tolist()) == list(range((1 << levels) - 1)) and places[0] == 0
    if levels > 3:  # a subtree of the lower half lies together
        top = levels // 2
        below = np.concatenate([merkle.address(levels, top + d, (1 << d) + np.arange(1 << d)) for d in range(levels - top)])
        assert below.max() - below.min() == len(below) - 1


@pytest.mark.parametrize("height", [2, 8])
def test_manifest(spark, height):
    rows = rows_of(90)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    docs = docs.selectExpr("*", "'x' AS key", "1 AS __llm_index", "'y' AS leaf", "2 AS block")
    got = sorted(map(tuple, merkle.document_manifest(docs, height).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.document_manifest(empty).count() == 0
    for n in (1, 3):
        rows = rows_of(20)[:n]
        docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
        assert sorted(map(tuple, merkle.document_manifest(docs).collect()), key=str) == sorted(brute(rows), key=str)


def test_any_change_shows(spark):
    """Every column of a leaf counts, a value and a null included."""
    rows = [(1, "t", "en", "s", 1), (3, "t", "en", "s", 1), (1, "", "en", "s", 1), (1, None, "en", "s", 1), (1, "t", "", "s", 1), (1, "t", "en", None, 1), (1, "t", "en", "s", None), (1, "t", "e", "ns", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert docs.select(merkle.digest_of(*[docs[c] for c in docs.columns]).alias("h")).distinct().count() == len(rows)


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{sf_dir}/documents.parquet'").df().to_dict("records")
    got = sorted(map(tuple, manifest_queries.op12_merkle_manifest(spark, sf_dir).collect()))
    assert got == sorted(brute(rows))
