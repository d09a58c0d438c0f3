"""Stored indexes against scans of the texts."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from patchlake.functions import text as X
from patchlake.operators import block_index, cells, dense, fusion, lexical, literal, lookup, trigrams
from patchlake.plans.jobs import Corpus
from patchlake.sources.store import MAX_PUSHED, where_in


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["amber", "Birch", "cédar", "delta_x", "EMBER", "fjord.y", "İstanbul", "中文字", "ß", "x"]
    return [(f"{i:04d}", None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 12))) + (f" rare{i}" if i % 5 == 0 else ""), f"s{i % 2}") for i in range(n)]


NEEDLES = ["amber", "AMBER birch", "dar d", "x_", "", "中文字", "中文", "İ", "i̇stanbul", "rare5", "RARE10", "rare", "nowhere", "ßx", "%", "fjord.y ", "a" * 5000]


def commits(spark, rows):
    docs = spark.createDataFrame(rows, "sha string, doc_text string, source string")
    docs = docs.withColumn("modules", F.array("source")).withColumn("tag", F.lit("FIX"))
    return docs.withColumn("authored_at", F.when(F.col("sha") % 3 == 0, F.lit("2024-01-02").cast("timestamp")))


def hits(df):
    return sorted((r.query_id, r.sha) for r in df.select("query_id", "sha").collect())


@pytest.mark.parametrize("n", [0, 1, 100, 900])
def test_packed_places(n):
    places = sorted(random.Random(n).sample(range(trigrams.CHUNK), n))
    data = trigrams.packed(trigrams.array("H", places))
    assert len(data) == min(2 * n, trigrams.CHUNK // 8)
    assert np.flatnonzero(np.unpackbits(trigrams.bitmap(n, data), bitorder="little")).tolist() == places


@pytest.mark.parametrize("chunk", [4096, 64])
def test_indexed_literal(spark, monkeypatch, chunk):
    monkeypatch.setattr(trigrams, "CHUNK", chunk)
    docs = commits(spark, texts(300)).repartition(3)
    queries = spark.createDataFrame([(i, x, None if i % 4 else "s1") for i, x in enumerate(NEEDLES)] + [(99, None, None)], "query_id int, query string, source string")
    index = trigrams.index_rows(docs)
    assert hits(literal.literal_matches(docs, queries, index=index)) == hits(literal.literal_matches(docs, queries))
    found = trigrams.candidates(index, queries.where("query_id IN (0, 9, 12)")).collect()
    assert {r.sha for r in found if r.query_id == 9} >= {"0005"} and len([r for r in found if r.query_id == 9]) < 20
    assert not [r for r in found if r.query_id == 12]


def test_index_follows_the_table(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), sharded=False)
    queries = spark.createDataFrame([(0, "rare"), (1, "amber"), (2, "new text"), (3, "zz")], "query_id int, query string")

    def same():
        docs = corpus.commits.read()
        plain = hits(literal.literal_matches(docs, queries))
        assert hits(literal.literal_matches(docs, queries, index=corpus.search_grams())) == plain
        return plain

    rows = texts(200)
    corpus.commits.append(commits(spark, rows[:120]))
    assert corpus.index_texts() == 120 and corpus.index_texts() == 0
    corpus.commits.append(commits(spark, rows[120:]))
    assert corpus.index_texts() == 80
    before = same()
    # A text that changes: the old one is found no more, the new one is.
    corpus.upsert(commits(spark, [("0005", "new text", "s1"), ("9999", "new text", "s0")]))
    assert corpus.index_texts() == 2
    after = same()
    assert (0, "0005") in before and (0, "0005") not in after and [x for x in after if x[0] == 2] == [(2, "0005"), (2, "9999")]


def test_scan_reads_candidates_only(spark, tmp_path):
    """The ids of the candidates reach a scan of a clustered table; most row groups hold none of them."""
    corpus = Corpus(spark, str(tmp_path / "c"), sharded=False)
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.sha2(F.concat_ws(".", "id", k).cast("binary"), 512)), "")
    text = F.concat(F.lit("text "), F.col("id").cast("string"), F.translate(noise, "0123456789", "ghijklmnop"))
    rows = spark.range(30_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("sha"), text.alias("doc_text"), F.lit("s").alias("source"))
    corpus.commits.append(rows.withColumn("authored_at", F.lit(None).cast("timestamp")))
    corpus.index_texts()
    queries = spark.createDataFrame([(0, "text 21999")], "query_id int, query string")
    found = literal.literal_matches(corpus.commits.read(), queries, index=corpus.search_grams())
    assert found.count() == 1
    pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1:]
    assert any("In(sha," in x or "EqualTo(sha," in x for x in pushed)
    ids = [r.sha for r in trigrams.candidates(corpus.search_grams(), queries).collect()]
    assert 1 <= len(ids) < 20
    groups = []
    for file in (tmp_path / "c" / "commits").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        column = meta.schema.names.index("sha")
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(column).statistics
            groups.append(any(stats.min <= x <= stats.max for x in ids))
    assert len(groups) >= 6 and sum(groups) <= len(groups) / 2

def test_where_in_is_bounded(spark):
    with pytest.raises(ValueError):
        where_in(spark.range(3), "id", list(range(MAX_PUSHED + 1)))


# ---- BM25 over blocks --------------------------------------------------------------


def scored(df):
    return sorted((r.query_id, r["rank"], r.sha, r.score) for r in df.select("query_id", "rank", "sha", "score").collect())


@pytest.mark.parametrize(("block", "first"), [(256, 4), (8, 1)])
def test_block_search(spark, monkeypatch, block, first):
    """The same ranking as over the texts, whatever the blocks; ties, filters, queries without hits."""
    monkeypatch.setattr(block_index, "BLOCK", block)
    monkeypatch.setattr(block_index, "FIRST_BLOCKS", first)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"{i:03d}", None if i % 50 == 0 else " ".join(rng.choices(words, weights=[1 / (1 + k) for k in range(30)], k=rng.randint(0, 30))), f"s{i % 3}", "FIX" if i % 2 else None) for i in range(400)]
    rows += [(f"t{i:02d}", "tie w1", "s0", "FIX") for i in range(40)]
    docs = spark.createDataFrame(rows, "sha string, doc_text string, source string, tag string").withColumn("modules", F.array("source")).repartition(3)
    asked = [(0, "w1 w29", None, None, None), (1, "w0 w0 w2 w28", None, "FIX", ""), (2, "tie", "s0", None, None), (3, "", None, None, None), (4, "absent", None, None, None), (5, "w3", "none", None, None), (6, "W5,w6", None, None, "s1")]
    queries = spark.createDataFrame(asked, "query_id int, query string, module string, tag string, source string")
    index = block_index.block_rows(docs)
    postings = block_index.Postings(index, block_index.frequencies(index))
    assert scored(block_index.search(postings, queries, 7)) == scored(lexical.bm25_search(docs, queries, 7))
    plain = queries.select("query_id", "query")
    assert scored(block_index.search(postings, plain, 60)) == scored(lexical.bm25_search(docs, plain, 60))
    assert block_index.search(postings, plain.where("false"), 5).count() == 0
    want = lexical.postings(docs).select("sha", "term", "tf", F.round("weight", 9).alias("weight"))
    got = block_index.posting_rows(index).select("sha", "term", "tf", F.round("weight", 9).alias("weight"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_below_the_bar_stay_unread(spark, tmp_path, monkeypatch):
    """One block holds all good hits: the lists of the others aren't read; terms reach the scan."""
    read = []
    plain = block_index._scored

    def counting(lists, directory, pairs, *rest):
        read.append(pairs.count())
        return plain(lists, directory, pairs, *rest)

    monkeypatch.setattr(block_index, "_scored", counting)
    monkeypatch.setattr(block_index, "BLOCK", 16)
    monkeypatch.setattr(block_index, "FIRST_BLOCKS", 1)
    corpus = Corpus(spark, str(tmp_path / "c"), sharded=False)
    rows = [(f"{i:04d}", "good good good" if 100 <= i < 110 else "good " + "filler " * 200, "s") for i in range(800)]
    corpus.commits.append(commits(spark, rows).coalesce(1).sortWithinPartitions("sha"))
    corpus.vectors.append(corpus.commits.read().select("sha", F.array(F.lit(1.0).cast("float")).alias("embedding")))
    corpus.load()
    queries = spark.createDataFrame([(0, "good")], "query_id int, query string")
    found = block_index.search(corpus.search_postings(), queries, 5)
    assert scored(found) == scored(lexical.bm25_search(corpus.commits.read(), queries, 5))
    blocks = corpus.postings.read().where("term = 'good'").count()
    assert blocks >= 50 and read[0] == 1 and read[1] <= 2
    index = corpus.search_postings().index
    pushed = where_in(index, "term", ["good"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,good)" in pushed or "In(term" in pushed


def test_load_that_fails(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, str(tmp_path / "c"), sharded=False)
    corpus.commits.append(commits(spark, texts(60)))
    corpus.vectors.append(corpus.commits.read().select("sha", F.array(F.lit(1.0).cast("float")).alias("embedding")))

    def fail(*args, **options):
        raise RuntimeError

    for step in ("terms", "points"):
        with monkeypatch.context() as m:
            m.setattr(getattr(corpus, step), "append", fail)
            with pytest.raises(RuntimeError):
                corpus.load()
        assert corpus.points.read().count() == corpus.search_postings().index.count() == corpus.search_postings().terms.count() == 0
    for _ in range(2):
        corpus.load()
        rows = block_index.posting_rows(corpus.search_postings().index)
        assert sorted(map(str, rows.select("sha", "term").collect())) == sorted(map(str, lexical.postings(corpus.commits.read()).select("sha", "term").collect()))
    with monkeypatch.context() as m:
        m.setattr(corpus.points, "rewrite", fail)
        with pytest.raises(RuntimeError):
            corpus.load(recreate=True)
    assert corpus.search_postings().terms.where("term = ''").agg(F.sum("n")).first()[0] == 60
    corpus.load(recreate=True)
    assert corpus.search_postings().terms.where("term = ''").agg(F.sum("n")).first()[0] == 60 and len(corpus.postings.batches()) == 1


# ---- cells ---------------------------------------------------------------------------


def clustered(spark, n, k=12, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(k, 16))
    rows = [(f"{i:04d}", (middle[i % k] + 0.4 * rng.normal(size=16)).tolist(), f"s{i % 2}") for i in range(n)]
    rows += [("zero", [0.0] * 16, "s0"), ("none", None, "s0")]
    return spark.createDataFrame(rows, "sha string, embedding array<float>, source string").withColumn("modules", F.array("source")).withColumn("tag", F.lit("T"))


def test_cells(spark):
    vectors = clustered(spark, 600)
    centers = cells.fit(vectors, 12)
    assert np.array_equal(centers, cells.fit(vectors.repartition(7), 12))  # however the rows are spread
    stored = cells.placed(vectors, centers).cache()
    assert stored.count() == 601 and [r.cell for r in stored.where("sha = 'zero'").collect()] == [cells.NOWHERE]
    queries = vectors.where("sha < '0040'").selectExpr("sha AS query_id", "embedding AS vector", "if(sha < '0010', 's1', null) AS source")
    probes = cells.measured_probes(stored, centers, queries, 10, 0.9)
    assert probes < 6
    exact = {(r.query_id, r.sha): r.score for r in dense.dense_search(vectors, queries, 10).collect()}
    near = {(r.query_id, r.sha): r.score for r in cells.search(cells.Cells(stored, centers, probes), queries, 10).collect()}
    hits = set(exact) & set(near)
    assert len(hits) >= 0.85 * len(exact) and all(exact[x] == pytest.approx(near[x], abs=1e-8) for x in hits)
    assert all(int(sha) % 2 for query, sha in near if query < "0010" and sha != "zero")
    every = {(r.query_id, r.sha) for r in cells.search(cells.Cells(stored, centers, 12), queries, 10).collect()}
    assert every == set(exact)
    assert cells.fit(vectors.where("false"), 5).shape[0] == 0
    assert cells.search(cells.Cells(stored, np.zeros((0, 1)), 0), queries, 10).count() == 0


def test_only_probed_cells_are_read(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), sharded=False)
    vectors = clustered(spark, 600)
    corpus.commits.append(vectors.select("sha", "source", "modules", "tag", F.lit("text").alias("doc_text")))
    corpus.vectors.append(vectors.where("embedding IS NOT NULL AND sha < '0500'").select("sha", "embedding"))
    corpus.load()
    corpus.index_vectors(12)
    corpus.vectors.append(vectors.where("embedding IS NOT NULL AND sha >= '0500'").select("sha", "embedding"))
    corpus.load()
    probes = corpus.index_vectors()
    near = corpus.search_cells()
    assert near.probes == probes < 6 and near.vectors.count() == 601
    queries = vectors.where("sha = '0007'").selectExpr("0 AS query_id", "embedding AS vector")
    found = cells.search(near, queries, 10)
    want = [r.sha for r in dense.dense_search(vectors, queries, 10).collect()]
    assert len(set(want) & {r.sha for r in found.collect()}) >= 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


# ---- ids -----------------------------------------------------------------------------


def scanned(df):
    """Rows that the scans of a plan have returned."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, total, waiting = [], 0, [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
            leaves.append(name)
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    assert leaves
    return total


def test_ids_read_few_pages(spark, tmp_path):
    """40 ids of 200,000 rows: a twentieth of the rows is read, by hydration and by lookup."""
    corpus = Corpus(spark, str(tmp_path / "c"), sharded=False)
    rows = spark.range(200_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("sha"), F.lit("s").alias("source"), F.lit("x").alias("subject"), F.col("id").cast("string").alias("doc_text"))
    corpus.commits.append(rows)
    ids = [r.sha for r in rows.where("id % 5000 = 7").collect()]
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "query_id int, sha string")
    got = fusion.hydrate(wanted, corpus.commits.read(), "doc_text", few=True)
    assert sorted(r.sha for r in got.collect()) == sorted(ids)
    assert scanned(got) <= 40 * 256 <= 200_000 / 19
    links = dict(repo_by_source={}, default_repo="r", link_base="https://example.org")
    asked = spark.createDataFrame([(i, x if i % 2 else x[:14]) for i, x in enumerate(ids)], "lookup_id int, sha string")
    found = lookup.lookup(corpus.commits.read(), asked, **links)
    assert sorted(r.sha for r in found.collect()) == sorted(ids)
    pushed = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(sha" in pushed or "In(sha" in pushed
    assert scanned(found) <= 40 * 256


def test_block_rows_of_any_text(spark):
    """Texts of ASCII alone reach the task uncut; all texts have the words that full-text search knows."""
    texts = ["A b_c a", "Übung A ü", None, "", "...", "x" * 300 + " 1-2", "ﬁ İx 12"]
    docs = spark.createDataFrame([(f"{i}", t, ["m"], "T", "s") for i, t in enumerate(texts)], "sha string, doc_text string, modules array<string>, tag string, source string")
    index = block_index.block_rows(docs.coalesce(1))
    found = {(r.sha, r.term, r.tf) for r in block_index.posting_rows(index).collect()}
    terms = docs.select("sha", F.explode(X.lexemes(F.col("doc_text"))).alias("term")).groupBy("sha", "term").count()
    assert found == {tuple(r) for r in terms.collect()} and len(found) > 8
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "AS plain" in plan
