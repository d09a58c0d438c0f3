"""The shared search against a plain ranking."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

from patchlake.llm import search_queries, shared_search


def cut(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, k=10):
    counted = [(doc_id, Counter(words), len(words)) for doc_id, text in docs if (words := cut(text))]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(term for _, tf, _ in counted for term in tf)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scored = []
        for doc_id, tf, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = 0
            for term in cut(text):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(docs, items, k=10):
    return sorted(map(tuple, shared_search.search(docs, items, k).collect()), key=str)


DOCS = [
    (1, "the cat sat on the mat"), (2, "The CAT, the dog; the É2 é2"), (3, None), (4, ""), (5, "-- ,, !!"), (6, "dog " * 50), (7, "cat"), (8, "cat"), (8, "cat"),
    (9, "mat\x00cat\x7fdog{1}"), (None, "cat"), (10, "straße İ ſ K 中文 dog"), (11, "z " * 60_000 + "cat"), (12, "unrelated words here"),
]
ITEMS = [(1, "the cat"), (2, "cat cat dog the"), (2, "cat cat dog the"), (3, "dog mat the cat"), (4, None), (5, ""), (6, "?"), (7, "nowhere"), (8, "straße 中文 É2"), (None, "the mat"), (9, "cat")]


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 20), (20, 40)])
def test_search(spark, monkeypatch, limits):
    """Null, empty and very long texts, ties, repeated rows and clashing names; in one pass and in several."""
    monkeypatch.setattr(shared_search, "BLOCK_BYTES", limits[0])
    monkeypatch.setattr(shared_search, "CELLS", limits[1])
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS score", "'x' AS terms").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "7 AS doc_id", "1 AS rank")
    want = [x for x in ITEMS if x[1]]
    assert found(docs, items) == brute(DOCS, want) and found(docs, items, 3) == brute(DOCS, want, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(docs.where("false"), items) == found(docs, items.where("false")) == []
    assert found(docs.where("doc_id IN (3, 4, 5)"), items) == []


def test_plan_shares_sums():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [rng.choices(words, weights=[1 / (1 + i) for i in range(60)], k=rng.randint(1, 30)) for _ in range(40)] + [["a", "b", "c"], ["a", "b", "c", "d"]]
    made = shared_search.plan(texts)
    impacts = np.array([[rng.randint(0, 9) for _ in range(5)] for _ in made.terms])
    at = {term: i for i, term in enumerate(made.terms)}
    want = np.array([sum(impacts[at[term]] for term in terms) for terms in texts])
    assert (shared_search.evaluate(made, impacts) == want).all()
    leaves = [list(Counter(terms).items()) for terms in texts]
    number = {leaf: i for i, leaf in enumerate(sorted({x for item in leaves for x in item}))}
    parts, children = shared_search.mine([[number[x] for x in item] for item in leaves], len(number))
    pairs = Counter(pair for part in parts for pair in combinations(sorted(part), 2))
    assert max(pairs.values()) == 1  # whatever two items share is one node
    adds = sum(len(x) - 1 for x in parts + children)
    assert adds < 0.8 * sum(len(x) - 1 for x in leaves)
    holders = Counter(child for x in parts + children for child in x)
    assert all(holders[len(number) + i] > 0 for i in range(len(children)))


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    assert sorted(map(tuple, search_queries.op13_shared_search(spark, sf_dir).collect()), key=str) == brute(docs, items)
