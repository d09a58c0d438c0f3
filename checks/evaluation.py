"""Ranking quality, pooling and judgment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from checks.retrieval import HYBRID, LISTS, RRF_GAIN, VECTOR, rank_lists, search_queries
from patchlake.operators import relevance
from patchlake.plans import search
from patchlake.plans.judgments import Judgments
from patchlake.session import work_path

# An item is relevant for a user when a purchase of it was worth more than 20.
_QRELS = "SELECT DISTINCT user_id AS query_id, props AS sha FROM events WHERE event_type = 'purchase' AND value > 20"
_LATENCY = "SELECT event_type AS system, user_id AS query_id, avg(value) AS ms FROM events GROUP BY event_type, user_id"


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_lists(spark, sf_dir).select("system", "query_id", "rank", "sha")


METRICS = f"""{LISTS}, qrels AS ({_QRELS}), runs AS ({_LATENCY}),
n AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY ALL),
d AS (SELECT system, query_id, count(DISTINCT sha) AS hits, sum(1/log2(rank+2)) AS dcg FROM lists JOIN qrels USING (query_id, sha)
  WHERE rank < 10 GROUP BY ALL),
m AS (SELECT system, query_id, coalesce(hits,0)/n_rel AS recall,
  coalesce(dcg,0)/list_sum(list_transform(range(CAST(least(n_rel,10) AS BIGINT)), lambda i: 1/log2(i+2))) AS ndcg, ms
  FROM runs JOIN n USING (query_id) LEFT JOIN d USING (system, query_id))"""


@query(f"WITH {METRICS} SELECT system, query_id, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM m")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = _rankings(spark, sf_dir)
    metrics = relevance.query_metrics(rankings, spark.sql(_QRELS), 10, spark.sql(_LATENCY))
    return metrics.select("system", "query_id", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@query(
    f"""WITH {METRICS} SELECT system, count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(avg(ndcg), 6) AS mean_ndcg,
 round(avg(ms), 6) AS mean_ms, round(list_sort(list(ms))[count(*)//2 + 1], 6) AS p50_ms FROM m GROUP BY system"""
)
def ir_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = _rankings(spark, sf_dir)
    metrics = relevance.query_metrics(rankings, spark.sql(_QRELS), 10, spark.sql(_LATENCY))
    report = relevance.system_metrics(metrics)
    means = [F.round(c, 6).alias(c) for c in ("mean_recall", "mean_ndcg", "mean_ms", "p50_ms")]
    return report.select("system", "n_queries", *means)


@query("SELECT event_type, list_sort(list(value))[count(value)//2 + 1] AS value FROM events GROUP BY event_type")
def latency_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.upper_median(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")


SYSTEMS = [("click", "C"), ("error", "E"), ("purchase", "P"), ("signup", "S"), ("view", "V")]
POOL = f"""{LISTS}, r AS (SELECT *, CASE system WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS place,
  upper(left(system,1)) AS mark FROM lists),
g AS (SELECT query_id, sha, min({{'p': place, 'r': rank}}) AS seen, string_agg(DISTINCT mark, '' ORDER BY mark) AS found_by FROM r GROUP BY ALL),
pool AS (SELECT query_id, sha, found_by, row_number() OVER (PARTITION BY query_id ORDER BY seen, sha) - 1 AS rank FROM g QUALIFY rank < 24)"""


@query(f"WITH {POOL} SELECT query_id, CAST(rank AS INTEGER) AS rank, sha, found_by FROM pool")
def pool_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.pool(_rankings(spark, sf_dir), SYSTEMS, 12)


# Selections as people type them, made from the line items.
_RAW = """SELECT DISTINCT concat(' ', CAST(l_linenumber AS {str}), ',', CAST(l_suppkey % 9 AS {str}), '-', CAST(CAST(l_quantity AS INT) AS {str}),
  CASE l_returnflag WHEN 'R' THEN ' x -3' WHEN 'A' THEN ' 4-' ELSE ', 12 ' END) AS raw, CAST(l_partkey % 20 AS INT) AS n FROM lineitem"""


@query(
    f"""WITH s AS ({_RAW.format(str="VARCHAR")}), t AS (SELECT raw, n, unnest(string_split(replace(trim(raw), ',', ' '), ' ')) AS tok FROM s),
p AS (SELECT raw, n, CASE WHEN regexp_full_match(tok, '\\d+') THEN range(CAST(tok AS BIGINT), CAST(tok AS BIGINT)+1)
   WHEN regexp_full_match(tok, '\\d+-\\d+') THEN range(CAST(split_part(tok,'-',1) AS BIGINT), CAST(split_part(tok,'-',2) AS BIGINT)+1) END AS r FROM t),
x AS (SELECT DISTINCT raw, n, unnest(r) AS i FROM p)
SELECT s.raw, s.n, coalesce(string_agg(i, ',' ORDER BY i) FILTER (i BETWEEN 1 AND s.n), '') AS picked
FROM s LEFT JOIN x ON s.raw=x.raw AND s.n=x.n GROUP BY ALL"""
)
def selection_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.tables(spark, sf_dir, "lineitem")
    rows = spark.sql(_RAW.format(str="STRING"))
    return rows.withColumn("picked", F.array_join(relevance.selected_numbers(F.col("raw"), F.col("n")), ","))


_ANSWERS = """SELECT DISTINCT user_id AS query_id, CASE user_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'u' WHEN 2 THEN '2-4,1' ELSE '3 99' END AS raw
 FROM events WHERE event_type = 'purchase' AND value > 60"""


@query(
    f"""WITH {POOL}, qrels AS ({_QRELS}), ans AS ({_ANSWERS})
SELECT query_id, sha FROM qrels WHERE query_id NOT IN (SELECT query_id FROM ans)
UNION ALL SELECT query_id, sha FROM pool JOIN ans USING (query_id)
WHERE raw = 'a' OR (raw = '2-4,1' AND rank < 4) OR (raw = '3 99' AND rank = 2)"""
)
def judge_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered pools replace the judgments of their queries; the others stay."""
    pooled = relevance.pool(_rankings(spark, sf_dir), SYSTEMS, 12)
    answers = spark.sql(_ANSWERS)
    return relevance.replace_judgments(spark.sql(_QRELS), answers, relevance.judge(pooled, answers))


@query(
    f"""WITH {POOL}, qrels AS ({_QRELS}), ans AS ({_ANSWERS})
SELECT query_id, sha FROM qrels WHERE query_id NOT IN (SELECT query_id FROM ans) AND query_id % 5 <> 0
UNION ALL SELECT query_id, sha FROM pool JOIN ans USING (query_id)
WHERE query_id % 5 <> 0 AND (raw = 'a' OR (raw = '2-4,1' AND rank < 4) OR (raw = '3 99' AND rank = 2))
UNION ALL SELECT query_id, sha FROM pool WHERE query_id % 5 = 0 AND rank < 2 AND query_id IN (SELECT query_id FROM ans)
UNION ALL SELECT query_id, sha FROM qrels WHERE query_id % 5 = 0 AND query_id NOT IN (SELECT query_id FROM ans)"""
)
def judgments_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of judgments: filled, answered, folded, and a fifth of the answers given again."""
    pooled = relevance.pool(_rankings(spark, sf_dir), SYSTEMS, 12)
    answers = spark.sql(_ANSWERS)
    stored = Judgments(spark, work_path(spark, "judgments"), spark.table("events").schema["user_id"].dataType)
    stored.store(spark.sql(_QRELS))
    stored.answer(pooled, answers)
    stored.compact()
    stored.answer(pooled, answers.where("query_id % 5 = 0").withColumn("raw", F.lit("2,1")))
    return stored.read()


@query(
    f"""WITH h AS (WITH {HYBRID} SELECT 'hybrid' AS system, query_id, rank, sha FROM hybrid),
v AS (WITH {VECTOR.replace("<gain>", RRF_GAIN)} SELECT 'vector' AS system, query_id, rank, sha FROM ranked),
found AS (SELECT system, query_id, CAST(rank-1 AS INTEGER) AS rank, sha FROM (SELECT * FROM h UNION ALL SELECT * FROM v)),
qrels AS (SELECT e.label AS query_id, sha1(CAST(e.vec_id AS VARCHAR)) AS sha FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
n AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY ALL),
d AS (SELECT system, query_id, count(DISTINCT sha) AS hits, sum(1/log2(rank+2)) AS dcg FROM found JOIN qrels USING (query_id, sha) WHERE rank < 10 GROUP BY ALL),
runs AS (SELECT system, query_id FROM (VALUES ('hybrid'), ('vector')) s(system), range(10) q(query_id)),
m AS (SELECT system, query_id, coalesce(hits,0)/n_rel AS recall,
  coalesce(dcg,0)/list_sum(list_transform(range(CAST(least(n_rel,10) AS BIGINT)), lambda i: 1/log2(i+2))) AS ndcg
  FROM runs JOIN n USING (query_id) LEFT JOIN d USING (system, query_id))
SELECT system, count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(avg(ndcg), 6) AS mean_ndcg, true AS timed FROM m GROUP BY system"""
)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both systems on the query set, timed by block; vectors of a query's label are relevant."""
    docs = views.spark_corpus(spark, sf_dir)
    rankings, runs = search.timed_search(docs, search_queries(spark, docs))
    qrels = docs.where("label IS NOT NULL").select(F.col("label").alias("query_id"), "sha")
    report = relevance.system_metrics(relevance.query_metrics(rankings, qrels, 10, runs))
    timed = (F.col("p50_ms") > 0) & (F.col("mean_ms") > 0)
    return report.select("system", "n_queries", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_ndcg", 6).alias("mean_ndcg"), timed.alias("timed"))


@query(
    f"""WITH h AS (WITH {HYBRID} SELECT 'hybrid' AS system, query_id, rank, sha FROM hybrid),
v AS (WITH {VECTOR.replace("<gain>", RRF_GAIN)} SELECT 'vector' AS system, query_id, rank, sha FROM ranked)
SELECT system, query_id, CAST(rank-1 AS INTEGER) AS rank, sha FROM (SELECT * FROM h UNION ALL SELECT * FROM v)"""
)
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.spark_corpus(spark, sf_dir)
    return search.batch_search(docs, search_queries(spark, docs))


