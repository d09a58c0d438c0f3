import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.functions import bounds
from patchlake.operators import dense, fusion, lexical, literal
from patchlake.plans import search

WORDS = "alpha beta gamma delta the the the of".split()


def make_docs(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of the documents are copies of one text.
        text = "the alpha of beta the gamma" if i % 3 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))
        vector = None if i % 7 == 0 else [round(rng.uniform(-1, 1), 3) for _ in range(8)] if i % 3 else [1.0] + [0.5] * 7
        rows.append(
            (f"d{i:03d}", f"s{i % 2}", "FIX" if i % 4 else None, ["m1", "m2"][: i % 3], None if i % 11 == 0 else i % 9, text, vector)
        )
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(
        rows, "sha string, source string, tag string, modules array<string>, day int, diff_text string, embedding array<float>"
    )
    return (
        df.withColumn("authored_at", F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(day)"))
        .withColumn("subject", F.lit("subj"))
        .withColumn("body", F.lit(None).cast("string"))
        .withColumn("doc_text", F.col("diff_text"))
        .repartition(4)
    )


QUERIES = [
    (0, "alpha", None, None, None),
    (1, "the of", "m1", None, None),
    (2, "Gamma.Delta", None, "FIX", ""),
    (3, "beta beta alpha the", None, None, "s1"),
    (4, "", None, None, None),
    (5, "lph", None, None, None),
]


def queries_df(spark, rows=QUERIES):
    return spark.createDataFrame(rows, "query_id int, query string, module string, tag string, source string")


def passes(row, module, tag, source):
    return (not module or module in row[3]) and (not tag or row[2] == tag) and (not source or row[1] == source)


def ranked(df, *extra):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.sha, *[r[e] for e in extra]) if extra else r.sha)
    return out


def test_literal(spark, docs, rows):
    got = ranked(literal.literal_search(docs, queries_df(spark), pool=5))
    for query_id, text, *filters in QUERIES:
        hits = [r for r in rows if text.lower() in r[5].lower() and passes(r, *filters)]
        hits.sort(key=lambda r: (-(99 if r[4] is None else r[4]), r[0]))
        assert got.get(query_id, []) == [r[0] for r in hits[:5]], text


def test_literal_escapes_nothing(spark):
    docs = spark.createDataFrame([("a", "50%_x\\y"), ("b", "50 xx")], "sha string, doc_text string")
    docs = docs.withColumn("authored_at", F.lit(None).cast("timestamp"))
    queries = spark.createDataFrame([(0, "%_X\\"), (1, "5%x")], "query_id int, query string")
    assert ranked(literal.literal_search(docs, queries)) == {0: ["a"]}


def covers(tokens, elements):
    """Brute force: minimal windows that hold every element; weight / (1 + noise)."""
    places = sorted((i, e) for e in elements for i in range(len(tokens)) if tuple(tokens[i : i + len(e)]) == e)
    total, starts = 0.0, {}
    for _, (end, _) in enumerate(places):
        last = {}
        for i, e in places:
            if i <= end:
                last[e] = max(i, last.get(e, -1))
        if len(last) == len(elements):
            starts.setdefault(min(last.values()), end)
    for begin, end in starts.items():
        inside = sum(len(e) for i, e in places if begin <= i < end)
        total += 0.1 / (1 + max(0, end - begin - inside))
    return total


def tokenize(text):
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


@pytest.mark.parametrize("block", [100_000, 3])
def test_fulltext_rank(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(lexical, "MAX_BROADCAST_ROWS", block)
    text = F.concat_ws(" ", "subject", "diff_text")
    found = lexical.fulltext_search(docs, text, queries_df(spark), pool=7)
    got = ranked(found, "score")
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(query_id") == 1 and "WindowGroupLimit" in plan and "Join" not in plan
    for query_id, query, *filters in QUERIES:
        elements = list(dict.fromkeys(tuple(tokenize(w)) for w in query.split() if tokenize(w)))
        want = []
        for r in rows:
            if elements and passes(r, *filters):
                score = covers(tokenize("subj " + r[5]), elements)
                if score:
                    want.append((-round(score, 9), r[0]))
        want = [(sha, -s) for s, sha in sorted(want)[:7]]
        assert [(s, pytest.approx(v)) for s, v in want] == got.get(query_id, []), query


def test_clauses_phrases_and_negation(spark, docs, rows):
    spec = [
        (0, 0, 0, 0, "the", False), (0, 0, 0, 1, "alpha", False), (0, 0, 1, 0, "delta", True),
        (1, 0, 0, 0, "gamma", False), (1, 1, 0, 0, "delta", False), (1, 1, 1, 0, "of", True), (1, 1, 1, 1, "the", True),
        (2, 0, 0, 0, "the", False), (2, 0, 0, 1, "the", False), (3, 0, 0, 0, "the", True),
    ]
    terms = spark.createDataFrame(spec, "query_id int, clause_id int, elem_id int, offset int, term string, negated boolean")
    got = {}
    for r in lexical.match(docs, F.col("diff_text"), terms).collect():
        got.setdefault(r.query_id, set()).add(r.sha)
    padded = {r[0]: " " + " ".join(tokenize(r[5])) + " " for r in rows}
    assert got[0] == {s for s, t in padded.items() if " the alpha " in t and " delta " not in t}
    assert got[1] == {s for s, t in padded.items() if " gamma " in t or (" delta " in t and " of the " not in t)}
    assert got[2] == {s for s, t in padded.items() if " the the " in t}
    assert 3 not in got  # nothing but a negated element


def test_many_clauses_take_the_same_plan(spark, docs, rows):
    """200 alternatives of one query."""
    spec = [(0, i, 0, 0, "alpha" if i == 150 else f"absent{i}", False) for i in range(200)]
    terms = spark.createDataFrame(spec, "query_id int, clause_id int, elem_id int, offset int, term string, negated boolean")
    found = lexical.match(docs, F.col("diff_text"), terms)
    assert {r.sha for r in found.collect()} == {r[0] for r in rows if "alpha" in tokenize(r[5])}
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_bm25(spark, docs, rows):
    got = ranked(lexical.bm25_search(docs, queries_df(spark), pool=6), "score")
    counts = {r[0]: Counter(tokenize(r[5])) for r in rows}
    for query_id, query, *filters in QUERIES:
        scores = {}
        for term in set(tokenize(query)):
            df = sum(term in c for c in counts.values())
            idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
            for r in rows:
                tf, n = counts[r[0]][term], sum(counts[r[0]].values())
                if tf and passes(r, *filters):
                    scores[r[0]] = scores.get(r[0], 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256))
        want = sorted(((-round(s, 9), sha) for sha, s in scores.items()))[:6]
        assert got.get(query_id, []) == [(sha, pytest.approx(-s)) for s, sha in want]


def vector_queries(spark, filters=True):
    rng = random.Random(1)
    rows = [(*q, [rng.uniform(-1, 1) for _ in range(8)]) for q in QUERIES]
    df = spark.createDataFrame(
        rows, "query_id int, query string, module string, tag string, source string, vector array<float>"
    )
    return rows, df if filters else df.select("query_id", "vector")


def brute_dense(rows, query, filters, k):
    q = np.array(query, dtype=np.float32).astype(float)
    scored = []
    for r in rows:
        if r[6] is not None and passes(r, *filters):
            v = np.array(r[6], dtype=np.float32).astype(float)
            scored.append((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 9), r[0]))
    return [sha for _, sha in sorted(scored)[:k]]


@pytest.mark.parametrize("filters", [True, False])
@pytest.mark.parametrize("block, cells", [(100, 4_000_000), (2, 1)])
def test_dense(spark, docs, rows, monkeypatch, filters, block, cells):
    monkeypatch.setattr(dense, "query_blocks", lambda q: bounds.query_blocks(q, block))
    monkeypatch.setattr(dense, "MATRIX_CELLS", cells)
    specs, queries = vector_queries(spark, filters)
    got = ranked(dense.dense_search(docs, queries, pool=9))
    for query_id, _, *wanted, vector in specs:
        assert got.get(query_id, []) == brute_dense(rows, vector, wanted if filters else (None,) * 3, 9)


def test_dense_rejects_other_dimensions(spark, docs):
    queries = spark.createDataFrame([(0, [1.0, 2.0])], "query_id int, vector array<float>")
    with pytest.raises(Exception, match="dimensions"):
        dense.dense_search(docs, queries).collect()
    assert dense.dense_search(docs, queries.limit(0)).count() == 0


def test_lsh_recall(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(10, 16))
    vectors = [(i, (centers[i % 10] + 0.3 * rng.normal(size=16)).tolist()) for i in range(500)]
    df = spark.createDataFrame(vectors, "sha long, embedding array<float>")
    queries = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "query_id int, vector array<float>")
    exact = ranked(dense.dense_search(df, queries, pool=10))
    near = ranked(dense.lsh_search(df, queries, pool=10))
    recall = np.mean([len(set(near.get(q, [])) & set(exact[q])) / 10 for q in exact])
    assert recall >= 0.9


def lists_df(spark):
    rows = [
        (0, 0, 0, "a", 9.0), (0, 0, 1, "b", 5.0), (0, 0, 2, "c", 1.0), (0, 1, 0, "c", 0.5), (0, 1, 1, "b", 0.4), (0, 1, 2, "d", 0.4),
        (1, 1, 0, "x", 1.0), (2, 0, 0, "p", 2.0), (2, 1, 0, "q", 2.0),
    ]
    return rows, spark.createDataFrame(rows, "query_id int, list_id int, rank int, sha string, score double")


def test_rrf_and_ties(spark):
    rows, df = lists_df(spark)
    got = ranked(fusion.fused_top_k(fusion.rrf(df), 3), "score")
    # a: 1/61, c: 1/63 + 1/61, b: 2/62; p and q tie and keep list order.
    assert [s for s, _ in got[0]] == ["c", "b", "a"]
    assert got[0][0][1] == pytest.approx(1 / 63 + 1 / 61) and got[1] == [("x", pytest.approx(1 / 61))]
    assert [s for s, _ in got[2]] == ["p", "q"]


def test_rrf_is_monotone_in_rank(spark):
    _, df = lists_df(spark)
    scores = {r.sha: r.score for r in fusion.rrf(df.where("query_id = 0 AND list_id = 0")).collect()}
    assert scores["a"] > scores["b"] > scores["c"]


@pytest.mark.parametrize("pooled", [True, False])
def test_dbsf(spark, pooled):
    rows, df = lists_df(spark)
    got = {(r.query_id, r.sha): r.score for r in fusion.dbsf(df, pooled=pooled).collect()}
    want = Counter()
    for query_id, list_id in {(r[0], r[1]) for r in rows}:
        scores = {r[3]: r[4] for r in rows if r[:2] == (query_id, list_id)}
        mean, sd = np.mean(list(scores.values())), np.std(list(scores.values()), ddof=1) if len(scores) > 1 else 0
        for sha, s in scores.items():
            want[query_id, sha] += (s - (mean - 3 * sd)) / (6 * sd) if sd else 0.5
    assert got == {key: pytest.approx(value) for key, value in want.items()}


def test_pinned_order(spark):
    _, df = lists_df(spark)
    got = ranked(fusion.pinned_top_k(df.where("query_id = 0"), 1, 4))
    assert got[0] == ["c", "b", "d", "a"]


def test_hybrid_routes(spark, docs, rows):
    specs, queries = vector_queries(spark)
    k_queries = queries.withColumn("k", F.when(F.col("query_id") == 0, 2).otherwise(99))
    got = ranked(search.hybrid_rank(docs, k_queries, pool=50))
    assert len(got[0]) == 2
    # The identifier-shaped query has literal and full-text hits only, literal ones first.
    exact = ranked(literal.literal_search(docs, queries.where("query_id = 2")))
    assert got.get(2, [])[: len(exact.get(2, []))] == exact.get(2, [])
    # With a separate vector table the result is the same.
    vectors = docs.select("sha", "embedding", "modules", "tag", "source")
    split = search.hybrid_rank(docs.drop("embedding"), k_queries, pool=50, vectors=vectors)
    assert ranked(split) == got
    # A plain question fuses the dense and the full-text list.
    lex = ranked(lexical.fulltext_search(docs, search._fulltext_column(), queries))
    sem = ranked(dense.dense_search(docs, queries))
    for query_id in (1, 3):
        scores, seen = Counter(), {}
        for place, found in enumerate((sem.get(query_id, []), lex.get(query_id, []))):
            for rank, sha in enumerate(found):
                scores[sha] += 1 / (61 + rank)
                seen.setdefault(sha, (place, rank))
        want = sorted(scores, key=lambda s: (-round(scores[s], 9), seen[s]))[:50]
        assert got.get(query_id, []) == want


def test_search_hits(spark, docs):
    _, queries = vector_queries(spark)
    links = dict(repo_by_source={"s1": "r/one"}, default_repo="r/zero", link_base="https://example.org")
    hits = search.search(docs, queries, k=3, **links).collect()
    assert {h["rank"] for h in hits} == {1, 2, 3}
    one = next(h for h in hits if int(h.sha[1:]) % 2)
    assert one.link == f"https://example.org/r/one/commit/{one.sha}" and one.snippet
    vector = search.search(docs, queries, system="vector", k=3, fuse="dbsf", **links).collect()
    assert vector and all(h.snippet is None for h in vector)
    fallback = search.search(docs, queries, system="other", k=3, **links).collect()
    assert sorted(map(str, fallback)) == sorted(map(str, hits))
    with pytest.raises(ValueError):
        search.vector_rank(docs, queries, fuse="max")
    runs = search.batch_search(docs, queries)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
    assert {r.system for r in runs.select("system").distinct().collect()} == {"hybrid", "vector"}
    timed, ran = search.timed_search(docs, queries)
    assert sorted(map(str, timed.collect())) == sorted(map(str, runs.collect()))
    assert ran.where("ms > 0").count() == 2 * len(QUERIES)
