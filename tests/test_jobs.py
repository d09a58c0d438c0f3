import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlake.functions.rules import Rules
from patchlake.operators import block_index, embed, lookup
from patchlake.plans import jobs
from patchlake.plans.jobs import Corpus
from patchlake.plans.search import hybrid_rank
from patchlake.sources import changelog
from patchlake.sources.store import Table
from patchlake.streaming import ingest

RULES = Rules()
EMBEDDER = embed.hashing_embedder(16)


def log_text(shas, body="body"):
    out = ""
    for sha in shas:
        i = int(sha, 16)
        patch = f"diff --git a/addons/sale/f{i}.py b/addons/sale/f{i}.py\n@@\n+token_{sha[:4]} shared\n"
        out += "\x1e" + "\x1f".join([sha, "n", "e", "2024-01-02T03:04:05Z", f"2024-01-{i % 28 + 1:02d}T00:00:00Z", f"[FIX] s{i}", body])
        out += "\x1d" + patch
    return out


def shas(start, stop):
    return [f"{i:040x}" for i in range(start, stop)]


def read(spark, path):
    return changelog.parse_records(changelog.read_log(spark, str(path)))


def test_table_versions(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), T.StructType([T.StructField("sha", T.StringType()), T.StructField("source", T.StringType())]), by=("source",))
    assert table.read().count() == 0

    def rows(*pairs):
        return spark.createDataFrame(pairs, "sha string, source string")

    assert table.append(rows(("a", "x"), ("b", "y"))) == 0
    assert table.append(rows(("c", "x"))) == 1
    assert table.append(rows(("d", "x")), "key") == table.append(rows(("e", "x")), "key") < 0  # a replay replaces its batch
    assert table.append(rows(("f", "x"))) == 2
    assert sorted(r.sha for r in table.read().collect()) == ["a", "b", "c", "e", "f"]
    table.rewrite(table.read().where("sha <> 'a'"))
    assert sorted(r.sha for r in table.read().collect()) == ["b", "c", "e", "f"]
    (tmp_path / "t" / "v000003").mkdir()  # a version that was never committed
    assert table.read().count() == 4


def test_resumed_build_and_search(spark, tmp_path):
    (tmp_path / "one").write_text(log_text(shas(0, 30)))
    (tmp_path / "two").write_text(log_text(shas(20, 40), "changed"))
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    seen = []
    corpus.run(read(spark, tmp_path / "one"), RULES, "community", EMBEDDER, 0.12, lambda stage, stats: seen.append((stage, stats.first().embedded)))
    assert seen == [("built", 0), ("embedded", 30)]
    corpus.run(read(spark, tmp_path / "two"), RULES, "community", EMBEDDER, 0.12)
    corpus.run(read(spark, tmp_path / "two"), RULES, "community", EMBEDDER, 0.12)
    stored = corpus.commits.read()
    assert stored.count() == 40 and stored.where("body = 'changed'").count() == 10
    assert corpus.vectors.read().count() == corpus.points.read().count() == 40
    rows = block_index.posting_rows(corpus.search_postings().index)
    assert rows.where("term = 'shared'").count() == 40

    queries = spark.createDataFrame([(0, f"token_{'0' * 4}"), (1, "shared")], "query_id int, query string")
    queries = embed.embed_queries(queries, EMBEDDER)
    docs = corpus.documents()
    joined = hybrid_rank(docs, queries, k=5)
    split = hybrid_rank(corpus.commits.read(), queries, k=5, vectors=corpus.search_vectors())
    assert joined.count() == 10 and sorted(map(str, joined.collect())) == sorted(map(str, split.collect()))

    # Without resume the rows are refreshed in place, twice as well as once.
    for _ in range(2):
        corpus.build(read(spark, tmp_path / "two"), RULES, "enterprise", resume=False)
    stored = corpus.commits.read()
    assert stored.count() == 40 and stored.where("body = 'changed' AND source = 'enterprise'").count() == 20

    links = dict(repo_by_source={}, default_repo="r", link_base="https://example.org")
    one = spark.createDataFrame([(0, shas(7, 8)[0])], "lookup_id int, sha string")
    assert lookup.lookup(corpus.commits.read(), one, **links).first().sha == shas(7, 8)[0]
    plan = lookup.lookup(corpus.commits.read(), one, **links)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "NestedLoop" not in plan and "Cartesian" not in plan

    found = lookup.lookup(
        corpus.documents(),
        spark.createDataFrame(
            [(0, shas(7, 8)[0]), (1, "0" * 39), (2, shas(7, 8)[0].upper() + "F"), (3, "zz"), (4, None), (5, "f" * 7), (6, f" {shas(5, 6)[0]} ")],
            "lookup_id int, sha string",
        ),
        repo_by_source={"enterprise": "r/two"},
        default_repo="r/one",
        link_base="https://example.org",
        max_chars=10,
    )
    rows = {r.lookup_id: r for r in found.collect()}
    assert len(rows) == 7
    assert rows[0].sha == shas(7, 8)[0] and rows[0].truncated and rows[0].diff_text == "diff --git\n... [truncated at 10 chars]"
    assert rows[0].link.startswith("https://example.org/r/one/") and rows[0].error is None and rows[0].files
    assert rows[6].sha == shas(5, 6)[0]
    assert rows[1].error == f"prefix '{'0' * 39}' is ambiguous — give more characters" and rows[1].sha is None
    assert rows[5].error == "no commit matching 'fffffff'"
    assert rows[2].error.startswith("no commit matching")
    assert rows[3].error == rows[4].error == "sha must be a hex commit id or prefix"


def test_limits_and_gates(spark, tmp_path):
    (tmp_path / "one").write_text(log_text(shas(0, 30)))
    corpus = Corpus(spark, str(tmp_path / "corpus"), sharded=False)
    with pytest.raises(ValueError):
        corpus.load()
    corpus.build(read(spark, tmp_path / "one"), RULES, "community", limit=10)
    assert corpus.commits.read().count() == 10
    corpus.build(read(spark, tmp_path / "one"), RULES, "community", limit=10)
    assert corpus.commits.read().count() == 20
    corpus.embed(EMBEDDER, limit=5)
    oldest = corpus.commits.read().orderBy("committed_at", "sha").limit(5)
    assert {r.sha for r in corpus.vectors.read().collect()} == {r.sha for r in oldest.collect()}
    corpus.load("community")
    with pytest.raises(ValueError):
        corpus.load("enterprise")
    assert corpus.points.read().count() == 5
    corpus.embed(EMBEDDER)
    corpus.load(recreate=True)
    assert corpus.points.read().count() == 20


@pytest.mark.parametrize("resume", [True, False])
def test_stream_equals_batch(spark, tmp_path, resume):
    logs = tmp_path / "logs"
    logs.mkdir()
    corpus = Corpus(spark, str(tmp_path / "streamed"), sharded=False)
    for i, (start, stop) in enumerate([(0, 20), (15, 30), (0, 30)]):
        (logs / f"part{i}").write_text(log_text(shas(start, stop)))
        commits = ingest.stream_commits(spark, str(logs), max_files=1)
        ingest.ingest(corpus, commits, RULES, "community", str(tmp_path / "ck"), resume=resume, embedder=EMBEDDER).awaitTermination()
    batch = Corpus(spark, str(tmp_path / "batch"), sharded=False)
    batch.build(read(spark, logs), RULES, "community")
    columns = ["sha", "source", "tag", "body", "modules", "doc_text"] if resume else ["sha", "source", "tag", "body", "modules"]
    assert sorted(map(str, corpus.commits.read().select(columns).collect())) == sorted(map(str, batch.commits.read().select(columns).collect()))
    assert corpus.vectors.read().count() == 30


def test_stream_dedup(spark, tmp_path):
    """Newest file first, with repeats: nothing is late."""
    logs = tmp_path / "logs"
    logs.mkdir()
    for i, year in enumerate(("2024", "2020", "2019", "2024")):
        (logs / f"part{i}").write_text(log_text(shas(10 * (i % 3), 10 * (i % 3) + 10)).replace("2024", year))
    distinct = ingest.distinct_commits(ingest.stream_commits(spark, str(logs), 1), "40 days")
    query = distinct.writeStream.format("memory").queryName("distinct_commits").option("checkpointLocation", str(tmp_path / "ck"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("distinct_commits").agg(F.count("*"), F.countDistinct("sha")).first()[:] == (30, 30)


def test_nothing_is_overwritten(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(2):
        (tmp_path / f"log{i}").write_text(log_text(shas(10 * i, 10 * i + 10)))
    (logs / "late").write_text(log_text(shas(20, 30)))
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    for i in range(2):
        assert corpus.build(read(spark, tmp_path / f"log{i}"), RULES, "community").first()[:] == (10, 0)
    commits = ingest.stream_commits(spark, str(logs), 1)
    ingest.ingest(corpus, commits, RULES, "enterprise", str(tmp_path / "new-checkpoint")).awaitTermination()
    assert corpus.commits.read().select("sha").distinct().count() == corpus.commits.read().count() == 30
    assert corpus.embed(EMBEDDER, limit=5).first().tokens > 0
    corpus.embed(EMBEDDER, slice_rows=4)
    assert corpus.vectors.read().count() == 30
    corpus.load("community")
    corpus.load("enterprise")
    rows = block_index.posting_rows(corpus.search_postings().index)
    assert corpus.points.read().count() == rows.select("sha").distinct().count() == 30
    want = sorted(map(str, rows.collect()))
    corpus.load("enterprise", resume=False)
    assert corpus.points.read().count() == 30
    assert corpus.postings.batches() == corpus.terms.batches() == corpus.points.batches() and len(corpus.points.batches()) == 1
    again = block_index.posting_rows(corpus.search_postings().index)
    assert sorted(map(str, again.collect())) == want


def test_paid_texts(spark, tmp_path):
    """Each text is sent once, however often the jobs run."""
    (tmp_path / "one").write_text(log_text(shas(0, 30)))
    corpus, sent = Corpus(spark, str(tmp_path / "corpus")), spark.sparkContext.accumulator(0)
    plain = embed.hashing_embedder(16)

    def counting(texts):
        sent.add(len(texts))
        return plain(texts)

    for _ in range(3):
        corpus.run(read(spark, tmp_path / "one"), RULES, "community", counting, 0.12)
        assert sent.value == 30
    assert corpus.vectors.read().count() == 30


def test_last_copy_wins_and_sources_share_ids(spark, tmp_path):
    (tmp_path / "log").write_text(log_text(shas(0, 6), "first") + log_text(shas(3, 6), "second") + log_text(shas(5, 6), "third"))
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    corpus.build(read(spark, tmp_path / "log"), RULES, "community")
    corpus.build(read(spark, tmp_path / "log"), RULES, "enterprise", resume=True)
    rows = {r.sha: (r.body, r.source) for r in corpus.commits.read().collect()}
    assert corpus.commits.read().count() == len(rows) == 6
    assert [rows[x][0] for x in shas(0, 6)] == ["first"] * 3 + ["second"] * 2 + ["third"]
    assert {source for _, source in rows.values()} == {"enterprise"}


def test_upsert_leaves_other_partitions(spark, tmp_path):
    (tmp_path / "log").write_text(log_text(["00" + "0" * 38, "11" + "0" * 38]))
    (tmp_path / "more").write_text(log_text(["00" + "0" * 38], "new"))
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    corpus.build(read(spark, tmp_path / "log"), RULES, "community")
    files = {str(x) for x in (tmp_path / "corpus" / "commits").rglob("shard=11/**/*.parquet")}
    corpus.build(read(spark, tmp_path / "more"), RULES, "community", resume=False)
    assert files and files == {str(x) for x in (tmp_path / "corpus" / "commits").rglob("shard=11/**/*.parquet")}
    assert sorted(r.body for r in corpus.commits.read().collect()) == ["body", "new"]


def test_changes_lie_beside_the_rows(spark, tmp_path):
    """Changes are appended, the last one counts, and folding them in changes no row; an upsert can be repeated."""
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    (tmp_path / "log").write_text(log_text(shas(0, 40)))
    corpus.build(read(spark, tmp_path / "log"), RULES, "community")
    files = {str(x) for x in (tmp_path / "corpus" / "commits").rglob("*.parquet")}
    columns = ["sha", "source", "tag", "body", "doc_text", "shard"]

    def rows():
        return sorted(map(tuple, corpus.commits.read().select(columns).collect()))

    for k, body in enumerate(("second", "third")):
        (tmp_path / body).write_text(log_text(shas(10 * k, 30 + 15 * k), body))
        for _ in range(2):
            corpus.build(read(spark, tmp_path / body), RULES, "enterprise", resume=False, replay=f"key{k}")
    found = {r[0]: (r[1], r[3]) for r in rows()}
    want = {x: ("community", "body") for x in shas(0, 40)} | dict.fromkeys(shas(0, 30), ("enterprise", "second")) | dict.fromkeys(shas(10, 45), ("enterprise", "third"))
    assert found == want and len(rows()) == 45
    assert files <= {str(x) for x in (tmp_path / "corpus" / "commits").rglob("*.parquet")}
    before, indexed = rows(), {r.sha: r.indexed_at for r in corpus.commits.read().select("sha", "indexed_at").collect()}
    corpus.compact()
    assert rows() == before and corpus.commits.changes.batches() == []
    assert {r.sha: r.indexed_at for r in corpus.commits.read().select("sha", "indexed_at").collect()} == indexed


def test_slices_are_read_once(spark, tmp_path):
    (tmp_path / "one").write_text(log_text(shas(0, 60)))
    corpus, seen = Corpus(spark, str(tmp_path / "corpus"), sharded=False), spark.sparkContext.accumulator(0)
    corpus.build(read(spark, tmp_path / "one"), RULES, "community")
    plain = embed.hashing_embedder(16)

    def counting(texts):
        seen.add(len(texts))
        return plain(texts)

    corpus.embed(counting, slice_rows=7)
    assert seen.value == 60 and len(corpus.vectors.batches()) >= 8 and corpus.vectors.read().count() == 60


def test_builds_write_no_patch_down(spark, tmp_path, monkeypatch):
    """Of a log only ids and curated rows are staged, copies among them; a run without news curates nothing."""
    staged, plain = [], jobs.staged_once
    monkeypatch.setattr(jobs, "staged_once", lambda df, name, by=(): staged.append((name, df.columns)) or plain(df, name, by))
    (tmp_path / "log").write_text(log_text(shas(0, 6)) + log_text(shas(4, 6), "again"))
    corpus = Corpus(spark, str(tmp_path / "corpus"), sharded=False)
    assert tuple(corpus.build(read(spark, tmp_path / "log"), RULES, "here").first()) == (8, 0)
    assert [name for name, _ in staged] == ["curated"] and not any("patch" in columns for _, columns in staged)
    assert sorted(r.body for r in corpus.commits.read().collect()) == ["again"] * 2 + ["body"] * 4
    staged.clear()
    assert tuple(corpus.build(read(spark, tmp_path / "log"), RULES, "here").first()) == (0, 8)
    assert staged == [("ids", ["sha"])]


def test_headers_are_parsed_without_the_patch(spark, tmp_path):
    """Bytes that are no text, line ends and separators fall to the header and the patch as they lie."""
    head = "\x1f".join(["s1", "n", "e", "2024-01-02T03:04:05Z", "", "sub\r\nject", "bo"]).encode()
    records = [head + b"\xe2\x1d\xff+a\r\n\x1d+b\r", head.replace(b"s1", b"s2"), head.replace(b"s1", b"s3") + b"\x1d", b"no header"]
    (tmp_path / "log").write_bytes(b"".join(b"\x1e" + r for r in records))
    parsed = read(spark, tmp_path / "log")
    rows = {r.sha: (r.subject, r.body, r.patch) for r in parsed.collect()}
    assert rows == {"s1": ("sub\nject", "bo\ufffd", "\ufffd+a\n\x1d+b\n"), "s2": ("sub\nject", "bo", ""), "s3": ("sub\nject", "bo", "")}
    plan = parsed.select("sha", "subject")._jdf.queryExecution().optimizedPlan().toString()
    assert "make_valid_utf8(value" not in plan and "as binary" not in plan


def test_state_of_distinct_commits_lies_on_disk(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "one").write_text(log_text(shas(0, 9)) + log_text(shas(3, 6)))
    distinct = ingest.distinct_commits(ingest.stream_commits(spark, str(tmp_path / "logs")).select("sha", "subject"), "2 days")
    writer = distinct.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    assert [*(tmp_path / "ck" / "state").rglob("*.changelog")]
