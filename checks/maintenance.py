"""Resume, upsert, pending work, point ids, embedding and job queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.curation import CURATED, CURATED_COLUMNS, RULES, curated_columns, written_log
from checks.registry import iso, query
from patchlake.functions import text as X
from patchlake.operators import block_index, embed, maintain
from patchlake.plans.jobs import Corpus
from patchlake.session import work_path
from patchlake.sources import changelog, files
from patchlake.streaming import ingest

CORPUS = f"corpus AS MATERIALIZED ({views.CORPUS_DUCK})"
DIM = 64


@query(
    """SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderpriority AS subject FROM orders
 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')"""
)
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.tables(spark, sf_dir, "orders", "lineitem")
    incoming = spark.sql("SELECT sha1(CAST(o_orderkey AS STRING)) AS sha, o_orderpriority AS subject FROM orders")
    stored = spark.sql(
        "SELECT sha1(CAST(l_orderkey AS STRING)) AS sha, 'community' AS source FROM lineitem WHERE l_returnflag = 'R'"
    )
    return maintain.new_rows(incoming, stored, "community")


@query(
    """SELECT count(*) FILTER (l_orderkey IS NULL) AS kept, count(*) FILTER (l_orderkey IS NOT NULL) AS skipped
 FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag='R') ON o_orderkey=l_orderkey"""
)
def resume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.tables(spark, sf_dir, "orders", "lineitem")
    incoming = spark.sql("SELECT sha1(CAST(o_orderkey AS STRING)) AS sha FROM orders")
    stored = spark.sql("SELECT sha1(CAST(l_orderkey AS STRING)) AS sha FROM lineitem WHERE l_returnflag = 'R'")
    return maintain.resume_counts(incoming, stored)


# Stored rows are orders before 1999; updates are the line items of orders since
# 1997, several per order, the last one (by line and part) winning.
_STORED = """SELECT sha1(CAST(o_orderkey AS {str})) AS sha, 'community' AS source, o_orderdate AS authored_at, 'OLD' AS tag,
 concat('order ', CAST(o_orderkey AS {str})) AS subject, 'body' AS body, concat('old ', o_orderpriority) AS doc_text
 FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'"""
_UPDATES = """SELECT DISTINCT sha1(CAST(l_orderkey AS {str})) AS sha, 'enterprise' AS source, o_orderdate AS authored_at,
 'NEW' AS tag, concat('line ', CAST(l_linenumber AS {str})) AS subject,
 CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('part ', CAST(l_partkey AS {str})) END AS body,
 concat('new ', CAST(l_partkey AS {str})) AS doc_text, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS arrival
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01'"""


@query(
    f"""WITH s AS ({_STORED.format(str="VARCHAR")}), u0 AS ({_UPDATES.format(str="VARCHAR")}),
u AS (SELECT * FROM u0 QUALIFY row_number() OVER (PARTITION BY sha ORDER BY arrival DESC) = 1)
SELECT coalesce(s.sha, u.sha) AS sha, CASE WHEN u.sha IS NULL THEN s.source ELSE u.source END AS source,
 {iso("CASE WHEN s.sha IS NULL THEN u.authored_at ELSE s.authored_at END")} AS authored_at,
 CASE WHEN s.sha IS NULL THEN u.tag ELSE s.tag END AS tag,
 CASE WHEN u.sha IS NULL THEN s.subject ELSE u.subject END AS subject,
 CASE WHEN u.sha IS NULL THEN s.body ELSE u.body END AS body,
 CASE WHEN u.sha IS NULL THEN s.doc_text ELSE u.doc_text END AS doc_text,
 CASE WHEN s.sha IS NULL THEN 'now' ELSE 'before' END AS indexed_at
FROM s FULL JOIN u ON s.sha = u.sha"""
)
def upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.tables(spark, sf_dir, "orders", "lineitem")
    stored = spark.sql(_STORED.format(str="STRING")).withColumn("indexed_at", F.lit("before"))
    updates = maintain.last_per_key(spark.sql(_UPDATES.format(str="STRING")), "arrival")
    merged = maintain.upsert(stored, updates, F.lit("now"))
    return merged.withColumn("authored_at", X.format_iso_time(F.col("authored_at")))


@query(
    f"""WITH {CORPUS}, v AS (SELECT sha1(CAST(vec_id*2 AS VARCHAR)) AS sha, embedding FROM embeddings)
SELECT c.sha, c.embedding IS NOT NULL AS had, v.sha IS NOT NULL AS given,
 round(list_sum(list_transform(coalesce(v.embedding, c.embedding), lambda x: CAST(x AS DOUBLE))), 4) AS total
FROM corpus c LEFT JOIN v ON c.sha = v.sha"""
)
def vector_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.spark_corpus(spark, sf_dir)
    vectors = spark.sql("SELECT sha1(CAST(vec_id*2 AS STRING)) AS sha, embedding FROM embeddings")
    had = docs.select("sha", F.col("embedding").isNotNull().alias("had"))
    given = vectors.select("sha", F.lit(True).alias("given"))
    filled = maintain.fill_vectors(docs.select("sha", "embedding"), vectors)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return (
        filled.select("sha", F.round(total, 4).alias("total"))
        .join(had, "sha")
        .join(given, "sha", "left")
        .select("sha", "had", F.coalesce("given", F.lit(False)).alias("given"), "total")
    )


@query(
    f"""WITH {CORPUS} SELECT sha, {iso("committed_at")} AS committed_at FROM corpus WHERE embedding IS NULL
 ORDER BY corpus.committed_at NULLS LAST, sha LIMIT 100"""
)
def pending_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    oldest = maintain.pending(views.spark_corpus(spark, sf_dir), 100)
    return oldest.select("sha", X.format_iso_time(F.col("committed_at")).alias("committed_at"))


@query(
    f"""WITH {CORPUS}, h AS (SELECT *, sha1(unhex('6f1e7c4a000040008000000000000001') || encode(sha)) AS h FROM corpus
 WHERE embedding IS NOT NULL)
SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
 substr('89ab', (strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) AS point_id,
 sha, source, tag, subject, {iso("authored_at")} AS authored_at, len(embedding) AS dims, length(doc_text) AS n_chars FROM h"""
)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.points(views.spark_corpus(spark, sf_dir)).select(
        "point_id",
        "payload.sha",
        "payload.source",
        "payload.tag",
        "payload.subject",
        "payload.authored_at",
        F.size("dense").cast("long").alias("dims"),
        F.length("doc_text").cast("long").alias("n_chars"),
    )


# Feature hashing: md5 of each token picks the cell and the sign.
HASHED = f"""tok AS (SELECT sha, unnest(list_filter(regexp_split_to_array(lower(doc_text), '[^\\p{{L}}\\p{{N}}]+'),
   lambda x: x <> '')) AS term FROM corpus),
tf AS (SELECT sha, term, count(*) AS tf FROM tok GROUP BY ALL),
coded AS (SELECT sha, tf, CAST('0x'||substr(md5(term),1,8) AS BIGINT) AS h FROM tf),
cells AS (SELECT sha, CAST((h // 2) % {DIM} AS INTEGER) AS cell, sum(CASE WHEN h % 2 = 1 THEN tf ELSE -tf END) AS s
  FROM coded GROUP BY ALL),
unit AS (SELECT sha, cell, CAST(s / sqrt(sum(s*s) OVER (PARTITION BY sha)) AS FLOAT) AS x FROM cells WHERE s <> 0)"""


@query(f"WITH {CORPUS}, {HASHED} SELECT sha, cell, round(CAST(x AS DOUBLE), 6) AS x FROM unit")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embed.hashed_vectors(views.spark_corpus(spark, sf_dir), dim=DIM)
    cells = vectors.select("sha", F.posexplode("embedding").alias("cell", "x")).where(F.col("x") != 0)
    return cells.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query(
    f"""WITH {CORPUS} SELECT sha, length(doc_text) AS n_chars, true AS batch_ok FROM corpus"""
)
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document lands in one batch and every batch keeps the limits of the packing rule."""
    packed = embed.batch_numbers(views.spark_corpus(spark, sf_dir), max_docs=16, max_chars=20_000)
    sizes = packed.groupBy("part", "batch").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    ok = (F.col("docs") <= 16) & ((F.col("chars") <= 20_000) | (F.col("docs") == 1))
    return packed.join(sizes.withColumn("batch_ok", ok), ["part", "batch"]).select("sha", "n_chars", "batch_ok")


def _ingested(spark: SparkSession, sf_dir: str, resume: bool) -> DataFrame:
    """The log read as a stream in several micro-batches, then once more without news."""
    log, root = written_log(spark, sf_dir), work_path(spark, "corpus")
    corpus = Corpus(spark, root, sharded=False)
    for _ in range(2):
        commits = ingest.stream_commits(spark, log, max_files=4).withColumn("source", F.col("author_name"))
        running = ingest.ingest(corpus, commits, RULES, None, f"{root}/checkpoint", resume=resume)
        running.awaitTermination()
    return curated_columns(corpus.commits.read())


@query(f"WITH {CURATED} SELECT {CURATED_COLUMNS} FROM curated")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, resume=True)


@query(f"WITH {CURATED} SELECT {CURATED_COLUMNS} FROM curated")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, resume=False)


@query(
    f"""WITH {CORPUS}, tok AS (SELECT sha, unnest(list_filter(regexp_split_to_array(lower(doc_text), '[^\\p{{L}}\\p{{N}}]+'),
  lambda x: x <> '')) AS term FROM corpus WHERE embedding IS NOT NULL),
tf AS (SELECT sha, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT sha, sum(tf) AS n FROM tf GROUP BY sha)
SELECT sha, term, tf, round(tf*2.2/(tf+1.2*(0.25+0.75*n/256)), 6) AS weight FROM tf JOIN len USING (sha)"""
)
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and postings of the embedded rows written as tables and read back."""
    corpus = Corpus(spark, work_path(spark, "corpus"), sharded=False)
    docs = views.spark_corpus(spark, sf_dir)
    corpus.commits.append(docs)
    corpus.vectors.append(docs.where("embedding IS NOT NULL").select("sha", "embedding"))
    corpus.load(recreate=True)
    corpus.load()
    rows = block_index.posting_rows(corpus.search_postings().index)
    return rows.select("sha", "term", "tf", F.round("weight", 6).alias("weight"))


INDEXED = f"""{CORPUS}, tok AS (SELECT sha, unnest(list_filter(regexp_split_to_array(lower(doc_text), '[^\\p{{L}}\\p{{N}}]+'),
  lambda x: x <> '')) AS term FROM corpus WHERE embedding IS NOT NULL), tf AS (SELECT sha, term, count(*) AS tf FROM tok GROUP BY ALL)"""


@query(
    f"""WITH {INDEXED} SELECT c.sha, 1::BIGINT AS points, coalesce(t.n, 0) AS terms, coalesce(t.tokens, 0)::BIGINT AS tokens FROM corpus c
 LEFT JOIN (SELECT sha, count(*) AS n, sum(tf) AS tokens FROM tf GROUP BY sha) t USING (sha) WHERE embedding IS NOT NULL"""
)
def load_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that fails between postings and points, then another: every point has its postings, once."""
    corpus = Corpus(spark, work_path(spark, "corpus"), sharded=False)
    docs = views.spark_corpus(spark, sf_dir)
    corpus.commits.append(docs)
    vectors = docs.where("embedding IS NOT NULL").select("sha", "embedding")
    corpus.vectors.append(vectors.where(F.col("sha") < "8"))
    stored, corpus.points = corpus.points, _Failing(corpus.points)
    try:
        corpus.load()
    except RuntimeError:
        pass
    corpus.points = stored
    corpus.vectors.append(vectors.where(F.col("sha") >= "8"))
    corpus.load()
    terms = block_index.posting_rows(corpus.search_postings().index).groupBy("sha").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))
    points = corpus.points.read().groupBy(F.col("payload.sha").alias("sha")).agg(F.count("*").alias("points"))
    none = F.lit(0).cast("long")
    return points.join(terms, "sha", "left").select("sha", "points", F.coalesce("terms", none).alias("terms"), F.coalesce("tokens", none).alias("tokens"))


class _Failing:
    """A table whose next append fails."""

    def __init__(self, table):
        self._table = table

    def __getattr__(self, name):
        return getattr(self._table, name)

    def append(self, *args, **options):
        raise RuntimeError("no space")


@query(
    f"""WITH {CURATED} SELECT source, count(*) AS commits, count(*) AS embedded, count(*) AS points,
 CAST(sum(length(doc_text)) AS BIGINT) AS chars FROM curated GROUP BY source"""
)
def run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log -> build -> embed -> load, run twice; the second run finds nothing to do."""
    corpus = Corpus(spark, work_path(spark, "corpus"), sharded=False)
    parsed = changelog.parse_records(changelog.read_log(spark, written_log(spark, sf_dir)))
    parsed = parsed.withColumn("source", F.col("author_name"))
    for _ in range(2):
        corpus.run(parsed, RULES, None, embed.hashing_embedder(DIM), 0.12)
    points = corpus.points.read().groupBy(F.col("payload.source").alias("source")).agg(F.count("*").alias("points"))
    stats = maintain.corpus_stats(corpus.documents(), 0.12, "source").select("source", "commits", "embedded", "chars")
    return stats.join(points, "source")



def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = changelog.parse_records(changelog.read_log(spark, written_log(spark, sf_dir)))
    return parsed.withColumn("source", F.col("author_name"))


def _share(parts: int, k: int):
    return F.pmod(F.crc32(F.col("sha").cast("binary")), F.lit(parts)) == k


@query(
    f"""WITH {CURATED}, n AS (SELECT sha, count(DISTINCT term) AS terms FROM (SELECT sha, unnest(list_filter(
  regexp_split_to_array(lower(doc_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM curated) GROUP BY sha)
SELECT {CURATED_COLUMNS}, 1::BIGINT AS points, terms FROM curated JOIN n USING (sha)"""
)
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in four parts: three builds, a stream with a checkpoint of its own, one embedding in slices, loads by source."""
    corpus, log, root = Corpus(spark, work_path(spark, "corpus"), sharded=False), work_path(spark, "log"), work_path(spark, "stream")
    parsed = _parsed(spark, sf_dir)
    for k in range(3):
        corpus.build(parsed.where(_share(4, k)), RULES, None)
    changelog.write_log(parsed.where(_share(4, 3)).withColumn("author_name", F.col("source")), log)
    commits = ingest.stream_commits(spark, log, max_files=2).withColumn("source", F.col("author_name"))
    ingest.ingest(corpus, commits, RULES, None, f"{root}/checkpoint").awaitTermination()
    corpus.embed(embed.hashing_embedder(DIM), slice_rows=5000)
    for source in ("community", "enterprise"):
        corpus.load(source)
    points = corpus.points.read().groupBy(F.col("payload.sha").alias("sha")).agg(F.count("*").alias("points"))
    terms = block_index.posting_rows(corpus.search_postings().index).groupBy("sha").agg(F.count("*").alias("terms"))
    return curated_columns(corpus.commits.read()).join(points, "sha", "left").join(terms, "sha", "left")


@query(
    f"""WITH {CURATED}, c AS (SELECT count(*) AS n FROM curated)
SELECT CAST(run AS INTEGER) AS run, n AS commits, n AS vectors, n AS points, CASE WHEN run = 0 THEN n ELSE 0 END AS sent FROM c, range(3) t(run)"""
)
def run_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over one log: stored rows, and texts that each run sent to the embedder."""
    corpus, parsed, rows = Corpus(spark, work_path(spark, "corpus"), sharded=False), _parsed(spark, sf_dir), []
    sent, plain = spark.sparkContext.accumulator(0), embed.hashing_embedder(DIM)

    def counting(texts):
        sent.add(len(texts))
        return plain(texts)

    for run in range(3):
        before = sent.value
        corpus.run(parsed, RULES, None, counting, 0.12)
        rows.append((run, corpus.commits.read().count(), corpus.vectors.read().count(), corpus.points.read().count(), sent.value - before))
    return spark.createDataFrame(rows, "run int, commits long, vectors long, points long, sent long")


@query(
    f"""WITH {CURATED} SELECT sha, CASE WHEN substr(sha,1,1) < '4' THEN 'elsewhere' ELSE 'here' END AS source, tag,
 CASE WHEN substr(sha,1,1) < '4' THEN 'moved' WHEN substr(sha,1,1) < '9' THEN body||' again' ELSE body END AS body, n_files FROM curated"""
)
def build_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies within a log, the last one winning, and ids that come again under another source."""
    corpus, parsed = Corpus(spark, work_path(spark, "corpus"), sharded=False), _parsed(spark, sf_dir).drop("source")
    first = F.substring("sha", 1, 1)
    late = parsed.where(first < "9").withColumn("body", F.concat("body", F.lit(" again")))
    both = parsed.withColumn("copy", F.lit(0)).unionByName(late.withColumn("copy", F.lit(1)))
    corpus.build(both.withColumn("arrival", F.struct("copy", "arrival")).drop("copy"), RULES, "here")
    corpus.build(parsed.where(first < "4").withColumn("body", F.lit("moved")), RULES, "elsewhere")
    return corpus.commits.read().select("sha", "source", "tag", "body", "n_files")


@query(
    f"""WITH {CURATED} SELECT sha, source, tag, CASE WHEN substr(sha,1,1) < '9' THEN body||' new' ELSE body END AS body, n_files FROM curated"""
)
def stream_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older and a newer file with the same ids in one micro-batch: the newer copies win."""
    corpus, parsed, root = Corpus(spark, work_path(spark, "corpus"), sharded=False), _parsed(spark, sf_dir), work_path(spark, "stream")
    named = parsed.withColumn("author_name", F.col("source"))
    changelog.write_log(named, f"{root}/log/a")
    changelog.write_log(named.where(F.substring("sha", 1, 1) < "9").withColumn("body", F.concat("body", F.lit(" new"))), f"{root}/log/b")
    commits = ingest.stream_commits(spark, f"{root}/log/*").withColumn("source", F.col("author_name"))
    ingest.ingest(corpus, commits, RULES, None, f"{root}/checkpoint").awaitTermination()
    return corpus.commits.read().select("sha", "source", "tag", "body", "n_files")


@query(f"WITH commit_src AS ({views.COMMIT_SRC_DUCK}) SELECT sha, length(subject) AS n_chars FROM commit_src")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is read twice in one stream, in any order of dates: each commit once."""
    log, root = written_log(spark, sf_dir), work_path(spark, "stream")
    twice = ingest.stream_commits(spark, log, max_files=2).unionByName(ingest.stream_commits(spark, log, max_files=3))
    distinct = ingest.distinct_commits(twice.select("sha", "subject"), "2 days")
    writer = distinct.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("sha string, subject string").parquet(f"{root}/out").select("sha", F.length("subject").cast("long").alias("n_chars"))


@query("SELECT l_orderkey AS sha, count(*) AS n_parents FROM lineitem GROUP BY 1 HAVING count(*) <= 1")
def merges_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, their line items as parents."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return changelog.drop_merges(items.groupBy(F.col("l_orderkey").alias("sha")).agg(F.count("*").alias("n_parents")))


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, round(sum(CAST(l_quantity AS BIGINT)) / 1e6 * 0.12, 9) AS cost FROM lineitem")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    total = maintain.usage(items.select(F.col("l_quantity").cast("long").alias("tokens")), 0.12)
    return total.select(F.col("tokens").cast("long").alias("tokens"), F.round("cost", 9).alias("cost"))


@query(
    f"""WITH {CORPUS}, o AS (SELECT sha FROM corpus ORDER BY committed_at NULLS LAST, sha LIMIT 150)
SELECT sha, len(list_filter(regexp_split_to_array(lower(doc_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) > 0 AS has_vector
 FROM corpus JOIN o USING (sha)"""
)
def embed_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding with a limit serves the oldest documents, twice 75 of them."""
    corpus = Corpus(spark, work_path(spark, "corpus"), sharded=False)
    corpus.commits.append(views.spark_corpus(spark, sf_dir))
    for _ in range(2):
        corpus.embed(embed.hashing_embedder(DIM), limit=75)
    direction = F.exists("embedding", lambda x: x != 0)
    return corpus.vectors.read().select("sha", direction.alias("has_vector"))


@query(f"WITH {CURATED} SELECT sha, 1::BIGINT AS vectors FROM curated")
def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that embeds each micro-batch as it stores it."""
    log, root = written_log(spark, sf_dir), work_path(spark, "corpus")
    corpus = Corpus(spark, root, sharded=False)
    commits = ingest.stream_commits(spark, log, max_files=4).withColumn("source", F.col("author_name"))
    ingest.ingest(corpus, commits, RULES, None, f"{root}/checkpoint", embedder=embed.hashing_embedder(DIM)).awaitTermination()
    return corpus.vectors.read().groupBy("sha").agg(F.count("*").alias("vectors"))


@query(
    f"""WITH t AS (SELECT DISTINCT text FROM benchmark), tok AS (SELECT text, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM t),
tf AS (SELECT text, term, count(*) AS tf FROM tok GROUP BY ALL), coded AS (SELECT text, tf, CAST('0x'||substr(md5(term),1,8) AS BIGINT) AS h FROM tf),
cells AS (SELECT text, CAST((h // 2) % {DIM} AS INTEGER) AS cell, sum(CASE WHEN h % 2 = 1 THEN tf ELSE -tf END) AS s FROM coded GROUP BY ALL)
SELECT text AS query, cell, round(CAST(CAST(s / sqrt(sum(s*s) OVER (PARTITION BY text)) AS FLOAT) AS DOUBLE), 6) AS x FROM cells QUALIFY s <> 0"""
)
def query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as a query file, read back and embedded."""
    path = work_path(spark, "queries")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").distinct()
    items.select(F.to_json(F.struct(F.col("text").alias("query"), F.lit("nl").alias("class")))).write.text(path)
    queries = embed.embed_queries(files.read_queries(spark, path), embed.hashing_embedder(DIM))
    cells = queries.select("query", F.posexplode("vector").alias("cell", "x")).where(F.col("x") != 0)
    return cells.withColumn("x", F.round(F.col("x").cast("double"), 6))
