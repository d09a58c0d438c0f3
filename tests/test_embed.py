import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchlake.functions.words import ascii_words
from patchlake.operators import embed


def test_pack():
    assert list(embed.pack([])) == []
    assert list(embed.pack([5, 5, 5], max_docs=2, max_chars=100)) == [(0, 2), (2, 3)]
    assert list(embed.pack([60, 50, 40, 1], max_docs=9, max_chars=100)) == [(0, 1), (1, 4)]
    # A text over the limit is a request of its own.
    assert list(embed.pack([10, 500, 10], max_docs=9, max_chars=100)) == [(0, 1), (1, 2), (2, 3)]
    assert list(embed.pack([500, 500], max_docs=9, max_chars=100)) == [(0, 1), (1, 2)]


def test_retry():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return np.zeros((len(texts), 2)), 1

    vectors, _ = embed.with_retry(flaky, ["a"], wait=0)
    assert vectors.shape == (1, 2) and len(calls) == 3
    with pytest.raises(RuntimeError):
        embed.with_retry(lambda texts: 1 / 0, ["a"], tries=2, wait=0)


def test_documents_and_queries(spark):
    docs = spark.createDataFrame([(f"s{i}", f"Word{i} other_{i} x" if i else None) for i in range(40)], "sha string, doc_text string")
    run = embed.hashing_embedder(16)
    rows = {r.sha: r for r in embed.embed_documents(docs.repartition(3), run, max_docs=7).collect()}
    assert len(rows) == 40 and sum(r.tokens for r in rows.values()) == 39 * 4
    want, _ = run(["Word3 other_3 x"])
    assert rows["s3"].embedding == pytest.approx(want[0].tolist(), abs=1e-6)
    hashed = {r.sha: r.embedding for r in embed.hashed_vectors(docs, dim=16).collect()}
    assert set(hashed) == set(rows) - {"s0"}
    assert all(hashed[s] == pytest.approx(rows[s].embedding, abs=1e-6) for s in hashed)
    queries = spark.createDataFrame([(1, "word3"), (2, "")], "query_id int, query string")
    vectors = {r.query_id: r.vector for r in embed.embed_queries(queries, run).collect()}
    assert vectors[1] == pytest.approx(run(["word3"])[0][0].tolist()) and set(vectors[2]) == {0.0}


def test_failing_embedder_fails_the_job(spark):
    docs = spark.createDataFrame([("s", "text")], "sha string, doc_text string")

    def broken(texts):
        raise OSError("down")

    with pytest.raises(Exception, match="no vectors after"):
        embed.embed_documents(docs, broken, tries=2, wait=0).collect()


def test_batch_numbers(spark):
    docs = spark.range(50).select(F.col("id").cast("string").alias("sha"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("doc_text"))
    rows = embed.batch_numbers(docs.repartition(3), max_docs=4, max_chars=100).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.part, r.batch), []).append(r.n_chars)
    assert sum(map(len, groups.values())) == 50
    assert all(len(g) <= 4 and (sum(g) <= 100 or len(g) == 1) for g in groups.values())


def test_hashing_embedder_by_its_definition():
    """Texts of ASCII are cut together, others one by one; both follow the same rule."""
    texts = ["", "Word3 other_3 x", "ends", "Starts  and_more and", "ünï code Übung_x 12 and", "...", "ü", "and"]
    vectors, used = embed.hashing_embedder(16)(texts)
    n_words = 0
    for text, vector in zip(texts, vectors, strict=True):
        want, terms = np.zeros(16), re.findall(r"[^\W_]+", text.lower())
        n_words += len(terms)
        for term in terms:
            cell, sign = embed.hash_bucket(term, 16)
            want[cell] += sign
        assert np.allclose(vector, want / (np.linalg.norm(want) or 1))
    assert used == n_words
    assert embed.hashing_embedder(16)([])[0].shape == (0, 16) and embed.hashing_embedder(16)(["ü"])[0].any()


def test_terms_are_hashed_once(monkeypatch):
    calls, plain = [], embed.hash_bucket
    monkeypatch.setattr(embed, "hash_bucket", lambda term, dim: calls.append(term) or plain(term, dim))
    run = embed.hashing_embedder(16)
    for _ in range(3):
        run(["a b a", "b c", "ü a"])
    assert sorted(calls) == ["a", "b", "c", "ü"]


def test_ascii_words():
    texts = pa.array(["xx", "a b_c", None, "", "Lone", "1-2", "tail ", "z"]).slice(1)
    words, lengths = ascii_words(texts)
    assert words.to_pylist() == ["a", "b", "c", "lone", "1", "2", "tail", "z"] and lengths.tolist() == [3, 0, 0, 1, 2, 1, 1]
