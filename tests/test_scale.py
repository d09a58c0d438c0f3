"""What must not grow: texts in joins, sizes of logs, chains of comparisons, tasks of a slice."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import curation, views
from patchlake.operators import embed, lexical, maintain
from patchlake.plans.jobs import Corpus
from patchlake.sources import changelog
from patchlake.sources.store import MAX_PUSHED, Table, where_in


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved(df):
    """Names of the columns that meet in joins or pass through exchanges."""

    def walk(node):
        yield node
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    def names(node):
        output = node.output()
        return {output.apply(i).name() for i in range(output.size())}

    plan = df._jdf.queryExecution().sparkPlan()
    return set().union(*[names(n) for n in walk(plan) if "Join" in n.nodeName()], set())


LINES = [(1, 10, 0, 2.0), (1, 11, 9, 3.0), (1, 14, 5, 1.0), (2, 12, 9, None), (3, 13, 1, 1.0), (4, 12, 8, 2.0)]


@pytest.fixture
def orders(spark, tmp_path):
    lines = [(k, p, s, i, q, 1.0, 0.1, 0.2, "R", "F", None) for i, (k, p, s, q) in enumerate(LINES[::-1])]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(10, "ten"), (11, "eleven"), (12, "twelve"), (13, None), (14, "fourteen")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    rows = [(k, 7, "P" if k == 2 else "O", "1999-01-01" if k != 4 else "1995-01-01", f"{k}-X") for k in range(1, 6)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, d string, o_orderpriority string")
    frame.withColumn("o_orderdate", F.col("d").cast("timestamp")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_patches_are_made_after_the_join(spark, orders, no_broadcast):
    src = views.spark_commit_src(spark, orders)
    assert "patch" not in moved(src)
    head = "diff --git a/{0} b/{0}\n@@ -0,0 +1 @@\n"
    patches = {r.subject.split()[-1]: r.patch for r in src.collect()}
    # In order of the lines; a block without a name or number is left out, a patch without blocks is null.
    assert patches["1"] == head.format("core/static/src/app.js") + "+fourteen\n" * 8 + head.format("addons/payment_stripe/tests/test_model.py") + "+eleven\n" * 120 + head.format("addons/spreadsheet_dashboard/models/model.py") + "+ten\n" * 2
    assert patches["2"] is None and patches["3"] is None and len(patches) == 4


def test_modules_of_a_range_without_patches_in_the_join(spark, orders, no_broadcast):
    found = curation.module_prune_dim(spark, orders)
    assert "patch" not in moved(found) and "block" not in moved(found)
    assert {r.module for r in found.collect()} == {"core", "payment_stripe", "spreadsheet_dashboard"}


def test_written_logs_are_compressed(spark, tmp_path):
    patch = "diff --git a/addons/sale/a.py b/addons/sale/a.py\n" + "+line\n" * 5000
    rows = [(f"{i:040x}", "n", "e", None, None, "s", "b", patch) for i in range(200)]
    commits = spark.createDataFrame(rows, "sha string, author_name string, author_email string, authored_at timestamp, committed_at timestamp, subject string, body string, patch string")
    path = str(tmp_path / "log")
    changelog.write_log(commits, path)
    size = sum(f.stat().st_size for f in Path(path).glob("part-*"))
    assert size < 200 * len(patch) / 20
    read = changelog.parse_records(changelog.read_log(spark, path))
    assert read.count() == 200 and read.select("patch").distinct().collect() == [(patch,)]


def test_long_lists_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "ids")
    spark.range(20_000).select(F.sha1(F.col("id").cast("string")).alias("sha")).sort("sha").coalesce(1).write.parquet(path)
    ids = [r.sha for r in spark.read.parquet(path).sort("sha").limit(MAX_PUSHED - 1).collect()]
    found = where_in(spark.read.parquet(path), "sha", [*ids, None])
    assert found.count() == len(ids) and where_in(spark.read.parquet(path), "sha", []).count() == 0


def test_one_slice_keeps_several_tasks_busy(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "corpus"), sharded=False)
    docs = spark.range(6000).select(F.sha1(F.col("id").cast("string")).alias("sha"), F.lit("x").alias("source"), F.concat(F.lit("text "), "id").alias("doc_text"))
    corpus.commits.append(docs.coalesce(1))
    plain = embed.hashing_embedder(16)
    seen = spark.sparkContext.accumulator(0)

    class Parts:
        """Counts tasks: each adds one on its first request."""

        def __init__(self):
            self.first = True

        def __call__(self, texts):
            if self.first:
                self.first = False
                seen.add(1)
            return plain(texts)

    corpus.embed(Parts())
    assert corpus.vectors.read().select("sha").distinct().count() == 6000 == corpus.vectors.read().count()
    assert seen.value > 2


def test_batches_are_known_without_a_job(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), Corpus(spark, str(tmp_path)).vectors.schema)
    rows = spark.range(3).select(F.col("id").cast("string").alias("sha"))
    assert table.batches() == [] and table.append(rows) == 0 and table.append(rows) == 1
    kept = table.append(rows, "key")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert table.batches() == [kept, 0, 1] and table.next_batch() == 2
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_bm25_shuffles_no_postings(spark):
    texts = ["a b c", "a a b", "c c c c", "d", None, "a c", "b b a x y"]
    docs = spark.createDataFrame([(f"{i}", t, ["m"], "T", "s" if i % 2 else "u") for i, t in enumerate(texts)], "sha string, doc_text string, modules array<string>, tag string, source string")
    queries = spark.createDataFrame([(0, "a c", None), (1, "b zz", "s"), (2, "c", "")], "query_id int, query string, source string")
    hits = lexical.bm25_search(docs, queries, pool=3)
    assert "MapInArrow" in hits._jdf.queryExecution().optimizedPlan().toString() and "term" not in moved(hits)

    def scores(rows):
        return {(r.query_id, r["rank"]): (r.sha, round(r.score, 6)) for r in rows.collect()}

    # Rows of a repeated key go another way: it must give the same for keys that don't repeat.
    doubled = docs.where("doc_text is not null").unionByName(docs.where("false"))
    extra = spark.createDataFrame([("9", "q", ["m"], "T", "s"), ("9", "q", ["m"], "T", "s")], docs.schema)
    grouped = lexical.bm25_search(doubled.unionByName(extra), queries.limit(1).unionByName(queries.where("query_id > 0")), pool=3)
    assert {k: v[0] for k, v in scores(grouped).items()} == {k: v[0] for k, v in scores(hits).items()}
    twice = docs.unionByName(docs.where("sha = '3'"))
    once = lexical.bm25_search(docs.where("sha <> '3'"), queries, pool=3)
    assert {k[0] for k in scores(lexical.bm25_search(twice, queries, pool=3))} == {k[0] for k in scores(once)}


def test_postings_are_counted_in_the_row(spark):
    rows = [("a", "x y x"), ("b", "x"), ("c", ""), ("d", None), ("e", "y y"), ("e", "y z"), (None, "q"), (None, "q r")]
    docs = spark.createDataFrame(rows, "sha string, doc_text string")
    plain = docs.where("sha < 'e'")
    assert "Aggregate" not in lexical.postings(plain)._jdf.queryExecution().optimizedPlan().toString()
    # Rows of a key that repeats still count together where their lengths agree.
    found = sorted((str(r.sha), r.term, r.tf) for r in lexical.postings(docs).collect())
    assert found == [("None", "q", 1), ("None", "q", 1), ("None", "r", 1), ("a", "x", 2), ("a", "y", 1), ("b", "x", 1), ("e", "y", 3), ("e", "z", 1)]
    wanted = lexical.term_counts(lexical.tokenized(plain, F.col("doc_text"), "sha"), "sha")
    weights = wanted.select("sha", "term", "tf", lexical.bm25_weight(F.col("tf"), F.col("doc_len")).alias("weight"))
    assert sorted(weights.collect()) == sorted(lexical.postings(plain).collect())


def test_all_new_rows_move_no_text(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(maintain, "MAX_BROADCAST_ROWS", 5)
    incoming = spark.range(20).select(F.col("id").cast("string").alias("sha"), F.lit("text").alias("patch"))
    for stored, n in ((incoming.limit(0), 20), (incoming.where("sha < '11'"), 17), (incoming.where("sha <> '7'"), 1), (incoming.where("sha < '5'"), 5)):
        assert maintain.new_wide_rows(incoming, stored.select("sha")).count() == n
    found = maintain.new_wide_rows(incoming, incoming.where("sha < '11'").select("sha"))
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
