import pytest
from pyspark.sql import functions as F

from patchlake.functions import bounds
from patchlake.operators import maintain

COLUMNS = "sha string, source string, tag string, subject string, doc_text string, embedding array<float>, indexed_at string"
OLD = [("a", "c", "FIX", "old a", "text a", [1.0], "t0"), ("b", "c", "IMP", "old b", "text b", [2.0], "t0")]
NEW = [("b", "e", "REF", None, "new b"), ("c", "e", "REF", "new c", "new c")]


def merged(spark, **options):
    old = spark.createDataFrame(OLD, COLUMNS)
    new = spark.createDataFrame(NEW, "sha string, source string, tag string, subject string, doc_text string")
    return {r.sha: r for r in maintain.upsert(old, new, F.lit("t1"), **options).collect()}


def test_upsert(spark):
    rows = merged(spark)
    assert rows["a"].subject == "old a" and rows["a"].embedding == [1.0] and rows["a"].indexed_at == "t0"
    # A new NULL overwrites; tag, vector and first-seen time stay.
    b = rows["b"]
    assert (b.source, b.tag, b.subject, b.doc_text, b.embedding, b.indexed_at) == ("e", "IMP", None, "new b", [2.0], "t0")
    c = rows["c"]
    assert (c.source, c.tag, c.subject, c.embedding, c.indexed_at) == ("e", "REF", "new c", None, "t1")
    assert set(rows) == {"a", "b", "c"}


def test_upsert_options(spark):
    rows = merged(spark, refresh_tag=True, clear_stale_vectors=True)
    assert rows["b"].tag == "REF" and rows["b"].embedding is None and rows["a"].embedding == [1.0]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame(OLD, COLUMNS)
    new = spark.createDataFrame(NEW, "sha string, source string, tag string, subject string, doc_text string")
    once = maintain.upsert(old, new, F.lit("t1"))
    twice = maintain.upsert(once, new, F.lit("t2"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_last_per_key_with_a_hot_key(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("sha"),
        F.col("id").alias("arrival"),
        F.when(F.col("id") == 29_997, F.lit(None)).otherwise(F.col("id")).alias("v"),
    )
    out = maintain.last_per_key(rows, "arrival")
    assert out.count() == 20_001
    assert out.where("sha = 'hot'").first().v is None


@pytest.mark.parametrize("limit", [0, 2, 100])
def test_new_rows_strategies_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(maintain, "MAX_BROADCAST_ROWS", limit)
    incoming = spark.createDataFrame([(k, "text") for k in "abcdc"], "sha string, doc_text string")
    stored = spark.createDataFrame([("a", "x"), ("b", "y"), ("z", "x")], "sha string, source string")
    for source, want in ((None, ["c", "c", "d"]), ("x", ["b", "c", "c", "d"])):
        for fn in (maintain.new_rows, maintain.new_wide_rows):
            assert sorted(r.sha for r in fn(incoming, stored, source).collect()) == want
    counts = maintain.resume_counts(incoming, stored).first()
    assert (counts.kept, counts.skipped) == (3, 2)


@pytest.mark.parametrize("limit", [0, 100])
def test_distinct_wide_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(maintain, "MAX_BROADCAST_ROWS", limit)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).cast("string").alias("sha"), F.lit("text").alias("doc_text")
    )
    out = maintain.distinct_wide_rows(rows.repartition(4))
    assert out.count() == out.select("sha").distinct().count() == 2001


def test_vectors_and_pending(spark):
    old = spark.createDataFrame([(*r[:5], None, r[6]) for r in OLD], COLUMNS)
    old = old.withColumn("committed_at", F.expr("CASE sha WHEN 'b' THEN TIMESTAMP '2020-01-01' END"))
    assert [r.sha for r in maintain.pending(old, 1).collect()] == ["b"]
    assert maintain.pending(old).count() == 2
    filled = maintain.fill_vectors(old, spark.createDataFrame([("b", [3.0])], "sha string, embedding array<float>"))
    assert {r.sha: r.embedding for r in filled.collect()} == {"a": None, "b": [3.0]}
    assert [r.sha for r in maintain.pending(filled).collect()] == ["a"]


def test_stats_of_an_empty_corpus(spark):
    row = maintain.corpus_stats(spark.createDataFrame([], COLUMNS), 0.12).first()
    assert (row.commits, row.embedded, row.fixes, row.chars, row.est_cost) == (0, 0, 0, 0, 0.0)
    used = maintain.usage(spark.createDataFrame([(1_500_000,), (500_000,)], "tokens long"), 0.12).first()
    assert (used.tokens, round(used.cost, 6)) == (2_000_000, 0.24)


def test_size_checks(spark):
    df = spark.range(10)
    assert bounds.is_small(df, 10) and not bounds.is_small(df, 9)
    assert bounds.settled_or_none(df, 9) is None and bounds.settled_or_none(df, 10).count() == 10
    queries = df.withColumnRenamed("id", "query_id")
    blocks = bounds.query_blocks(queries, 3)
    assert len(blocks) > 1
    assert sorted(r[0] for r in bounds.union_all(blocks).collect()) == list(range(10))
