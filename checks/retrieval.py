"""Literal, full-text, dense, BM25 and fused search queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.curation import CURATED, RULES
from checks.maintenance import CORPUS
from checks.registry import iso, query
from patchlake.functions import text as X
from patchlake.operators import cells, dense, fusion, lexical, literal, lookup
from patchlake.operators.curate import curate
from patchlake.plans import search
from patchlake.plans.jobs import Corpus
from patchlake.session import staged, work_path

LINKS = dict(repo_by_source={"src1": "example/first", "src2": "example/second"}, default_repo="example/other", link_base="https://example.org")
WS = X.WHITESPACE.replace("'", "''")
NOT_WORD = r"[^\p{L}\p{N}]+"

# (query_id, query, module, tag, source); the identifiers and rare words occur in the documents.
QUERY_ROWS = [
    (0, "example.com", None, None, None),
    (1, "worthless", None, None, None),
    (2, "the and", None, "EN", None),
    (3, "forrendsten", None, None, None),
    (4, "De la", "label4", None, None),
    (5, "worthless thouThe", None, "", None),
    (6, "of.", None, None, "src1"),
    (7, "in that of", "label7", "EN", ""),
    (8, "example.com the", None, None, None),
    (9, "no_such.token", None, None, None),
]


def sql_value(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else sql_value(v) for v in r) + ")" for r in rows)


def arrow_rows(rows: list, fields: list) -> pa.Table:
    """Rows as an Arrow table, which Spark keeps as a local relation."""
    return pa.Table.from_pylist([dict(zip([f[0] for f in fields], row)) for row in rows], schema=pa.schema(fields))


def spark_queries(spark: SparkSession) -> DataFrame:
    fields = [("query_id", pa.int32()), *[(name, pa.string()) for name in ("query", "module", "tag", "source")]]
    return spark.createDataFrame(arrow_rows(QUERY_ROWS, fields))


Q = f"q(query_id, query, qmodule, qtag, qsource) AS (VALUES {sql_rows(QUERY_ROWS)})"
# Filter test of a corpus row c against a query row q.
PASS = """(coalesce(q.qmodule,'')='' OR coalesce(c.module=q.qmodule, false)) AND (coalesce(q.qtag,'')='' OR c.tag=q.qtag)
 AND (coalesce(q.qsource,'')='' OR c.source=q.qsource)"""


# ---- literal -----------------------------------------------------------------

EXACT = f"""exact AS (SELECT query_id, sha, row_number() OVER (PARTITION BY query_id
  ORDER BY authored_at DESC NULLS FIRST, sha) - 1 AS rank
 FROM q JOIN corpus c ON contains(lower(c.doc_text), lower(q.query)) AND {PASS} QUALIFY rank < 50)"""


@query(f"WITH {CORPUS}, {Q}, {EXACT} SELECT query_id, CAST(rank AS INTEGER) AS rank, sha FROM exact")
def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = literal.literal_search(views.spark_corpus(spark, sf_dir), spark_queries(spark))
    return hits.select("query_id", "rank", "sha")


@query(f"WITH {CORPUS}, {Q}, {EXACT} SELECT query_id, CAST(rank AS INTEGER) AS rank, sha FROM exact")
def literal_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stored corpus: candidates by its trigram index, made in two parts."""
    corpus, docs = Corpus(spark, work_path(spark, "corpus"), sharded=False), views.spark_corpus(spark, sf_dir)
    for half in (F.col("sha") < "8", F.col("sha") >= "8"):
        corpus.commits.append(docs.where(half))
        corpus.index_texts()
    hits = literal.literal_search(corpus.commits.read(), spark_queries(spark), index=corpus.search_grams())
    return hits.select("query_id", "rank", "sha")


@query(
    f"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents
 UNION ALL SELECT unnest(string_split(text, ' ')) FROM conversations)
SELECT word, count(*) AS n, regexp_full_match(t, '[A-Za-z0-9_.]+') AND (contains(t,'_') OR contains(t,'.')
  OR regexp_matches(t,'[a-z][A-Z]')) AS is_identifier FROM (SELECT word, trim(word, '{WS}') AS t FROM w) GROUP BY ALL"""
)
def identifier_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents and conversations as a query: which route would it take?"""
    views.tables(spark, sf_dir, "documents", "conversations")
    texts = spark.table("documents").select("text").unionAll(spark.table("conversations").select("text"))
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("is_identifier", X.looks_like_identifier(F.col("word")))


# ---- tokens and full text ------------------------------------------------------

TOKENS = f"""tokd AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(lower(concat_ws(' ', subject, coalesce(body,''), diff_text)),
  '{NOT_WORD}'), lambda x: x <> '') AS ts FROM corpus)"""


@query(
    f"""WITH {CORPUS}, {TOKENS} SELECT sha, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos, unnest(ts) AS term FROM tokd"""
)
def tokens_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.spark_corpus(spark, sf_dir)
    return lexical.token_rows(docs, X.search_text(F.col("subject"), F.col("body"), F.col("diff_text")), "sha")


# (query_id, clause_id, elem_id, offset, term, negated): alternatives, phrases and refusals.
TERM_ROWS = [
    (0, 0, 0, 0, "the", False), (0, 0, 1, 0, "worthless", False),
    (1, 0, 0, 0, "the", False), (1, 0, 1, 0, "and", True),
    (2, 0, 0, 0, "worthless", False), (2, 1, 0, 0, "forrendsten", False), (2, 1, 1, 0, "der", False),
    (3, 0, 0, 0, "de", False), (3, 0, 1, 0, "la", False), (3, 0, 2, 0, "que", True),
]
PHRASE_ROWS = [
    (0, 0, 0, 0, "example", False), (0, 0, 0, 1, "com", False),
    (1, 0, 0, 0, "of", False), (1, 0, 0, 1, "the", False), (1, 0, 1, 0, "and", False),
    (2, 0, 0, 0, "de", False), (2, 0, 0, 1, "la", False), (2, 0, 1, 0, "en", True), (2, 0, 1, 1, "la", True),
    (3, 0, 0, 0, "document", False), (3, 0, 0, 1, "7", False),
]


def _match(spark: SparkSession, sf_dir: str, rows: list) -> DataFrame:
    numbers = [(name, pa.int32()) for name in ("query_id", "clause_id", "elem_id", "offset")]
    fields = [*numbers, ("term", pa.string()), ("negated", pa.bool_())]
    text = X.search_text(F.col("subject"), F.col("body"), F.col("diff_text"))
    return lexical.match(views.spark_corpus(spark, sf_dir), text, spark.createDataFrame(arrow_rows(rows, fields)))


def _match_sql(rows: list) -> str:
    """Each clause as containment tests in the blank-separated token text."""
    texts: dict = {}
    for query_id, clause, elem, _, term, negated in rows:
        texts.setdefault((query_id, clause), {}).setdefault((elem, negated), []).append(term)
    selects = []
    for (query_id, _), elements in texts.items():
        tests = [("NOT " if neg else "") + f"contains(norm, ' {' '.join(terms)} ')" for (_, neg), terms in elements.items()]
        selects.append(f"SELECT {query_id} AS query_id, sha FROM n WHERE {' AND '.join(tests)}")
    union = " UNION ".join(selects)
    return f"WITH {CORPUS}, {TOKENS}, n AS (SELECT sha, ' '||array_to_string(ts,' ')||' ' AS norm FROM tokd) {union}"


@query(_match_sql(TERM_ROWS))
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, TERM_ROWS)


@query(_match_sql(PHRASE_ROWS))
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, PHRASE_ROWS)


def _element_rows() -> list:
    """(query_id, slot, width, n, first word, second word) of the plain queries, at most three elements."""
    import re

    rows = []
    for query_id, text, *_ in QUERY_ROWS:
        elements = [[t for t in re.split(r"[^a-z0-9]+", w) if t] for w in text.lower().split()]
        elements = list(dict.fromkeys(tuple(e) for e in elements if e))
        for slot, parts in enumerate(elements):
            padded = [*parts, *[None] * (3 - len(parts))]
            rows.append((query_id, slot, len(parts), len(elements), *padded))
    return rows


# Windows over the places of each element: begin = least of the last places seen.
LEX = f"""el(query_id, slot, width, n, w0, w1, w2) AS (VALUES {sql_rows(_element_rows())}),
tokrow AS (SELECT sha, module, tag, source, ts, unnest(ts) AS term, generate_subscripts(ts, 1) AS i FROM tokd),
place AS (SELECT q.query_id, c.sha, c.i AS start, el.slot, el.width, el.n FROM el JOIN q USING (query_id)
  JOIN tokrow c ON c.term = el.w0 AND (el.w1 IS NULL OR c.ts[c.i+1] = el.w1) AND (el.w2 IS NULL OR c.ts[c.i+2] = el.w2) AND {PASS}),
run AS (SELECT *, sum(width) OVER w - width AS before,
  last_value(CASE WHEN slot=0 THEN start END IGNORE NULLS) OVER w AS l0,
  last_value(CASE WHEN slot=1 THEN start END IGNORE NULLS) OVER w AS l1,
  last_value(CASE WHEN slot=2 THEN start END IGNORE NULLS) OVER w AS l2
  FROM place WINDOW w AS (PARTITION BY query_id, sha ORDER BY start, slot ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT *, CASE WHEN l0 IS NULL OR (n > 1 AND l1 IS NULL) OR (n > 2 AND l2 IS NULL) THEN NULL
  ELSE least(l0, CASE WHEN n > 1 THEN l1 ELSE l0 END, CASE WHEN n > 2 THEN l2 ELSE l0 END) END AS b FROM run),
cover AS (SELECT query_id, sha, b, min(start) AS e, min(before) AS e_before FROM ends WHERE b IS NOT NULL GROUP BY ALL),
lexed AS (SELECT c.query_id, c.sha, round(sum(0.1 / (1 + greatest(0, c.e - c.b - (c.e_before - r.before)))), 9) AS score
  FROM cover c JOIN run r ON r.query_id=c.query_id AND r.sha=c.sha AND r.start=c.b GROUP BY ALL),
lex AS (SELECT query_id, sha, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sha) - 1 AS rank
  FROM lexed QUALIFY rank < 50)"""


@query(f"WITH {CORPUS}, {TOKENS}, {Q}, {LEX} SELECT query_id, CAST(rank AS INTEGER) AS rank, sha, round(score, 6) AS score FROM lex")
def fts_cover_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.search_text(F.col("subject"), F.col("body"), F.col("diff_text"))
    hits = lexical.fulltext_search(views.spark_corpus(spark, sf_dir), text, spark_queries(spark))
    return hits.select("query_id", "rank", "sha", F.round("score", 6).alias("score"))


# ---- dense ---------------------------------------------------------------------

MEANS = """cells AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM <vectors>),
means AS (SELECT label, list(m ORDER BY i) AS vector FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY ALL)
  GROUP BY label)"""


@query(
    f"""WITH {MEANS.replace("<vectors>", "embeddings")}, s AS (SELECT m.label AS query_id, vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.vector), 9)
  AS score FROM embeddings e CROSS JOIN means m)
SELECT query_id, vec_id, round(score, 6) AS score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 50"""
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to the mean of every label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    hits = dense.dense_search(vectors, dense.label_means(vectors), key="vec_id")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


PLANES = """planes AS MATERIALIZED (SELECT t, b, list(CAST('0x'||substr(md5(t||':'||b||':'||i),1,8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5 ORDER BY i) AS p
  FROM range(16) x(t), range(5) y(b), range((SELECT max(len(embedding)) FROM embeddings)) z(i) GROUP BY t, b)"""


@query(
    f"""WITH {MEANS.replace("<vectors>", "embeddings")}, {PLANES},
stored AS (SELECT vec_id, t, sum(CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), p) > 0 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS h FROM embeddings, planes GROUP BY ALL),
probe AS (SELECT label, t, sum(CASE WHEN list_dot_product(vector, p) > 0 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS h FROM means, planes GROUP BY ALL),
found AS (SELECT DISTINCT label, vec_id FROM stored JOIN probe USING (t, h)),
s AS (SELECT f.label AS query_id, f.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.vector), 9) AS score
  FROM found f JOIN embeddings e ON e.vec_id = f.vec_id JOIN means m ON m.label = f.label)
SELECT query_id, vec_id, round(score, 6) AS score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 50"""
)
def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: the nearest among the vectors that share a bucket with the mean of a label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    hits = dense.lsh_search(vectors, dense.label_means(vectors), key="vec_id")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


N_CELLS, PROBES = 24, 8


def _cells_sql(rounds: int = 8) -> str:
    """K-means by unrolled rounds: sums of whole numbers, first centers by md5."""
    unit = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"
    parts = [
        "raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
        f"unit AS MATERIALIZED (SELECT vec_id, u, list_transform(u, lambda x: round_even(x * 1048576, 0)) AS q FROM (SELECT vec_id, {unit} AS u FROM raw))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell, u AS c FROM unit QUALIFY cell < {N_CELLS})",
    ]
    for k in range(rounds + 1):
        assigned = f"(SELECT vec_id, arg_max(cell, (s, -cell)) AS cell FROM (SELECT vec_id, cell, list_dot_product(q, c) AS s FROM unit, c{k}) GROUP BY vec_id)"
        if k == rounds:
            parts.append(f"placed AS MATERIALIZED {assigned}")
            break
        sums = f"SELECT cell, i, sum(x) AS x FROM (SELECT cell, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM {assigned} JOIN unit USING (vec_id)) GROUP BY ALL"
        lists = f"SELECT cell, list(x ORDER BY i) AS v FROM ({sums}) GROUP BY cell"
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.cell, coalesce({unit}, c.c) AS c FROM c{k} c LEFT JOIN ({lists}) USING (cell))")
    return ", ".join(parts) + f", centers AS (SELECT * FROM c{rounds})"


@query(
    f"""WITH {_cells_sql()}, {MEANS.replace("<vectors>", "embeddings")},
probe AS (SELECT label, vector, cell FROM means, centers QUALIFY row_number() OVER (PARTITION BY label
  ORDER BY round(list_dot_product(list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))), c), 9) DESC, cell) <= {PROBES}),
s AS (SELECT label AS query_id, vec_id, round(list_cosine_similarity(u, vector), 9) AS score FROM probe JOIN placed USING (cell) JOIN unit USING (vec_id))
SELECT query_id, vec_id, round(score, 6) AS score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 50"""
)
def cells_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: the nearest to the mean of every label among the vectors in its eight nearest cells of 24."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centers = cells.fit(vectors, N_CELLS, "vec_id")
    stored = cells.Cells(staged(cells.placed(vectors, centers, "vec_id"), "cells"), centers, PROBES)
    hits = cells.search(stored, dense.label_means(vectors), key="vec_id")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# ---- BM25 ----------------------------------------------------------------------


def bm25_sql(where: str = "true") -> str:
    return f"""bt AS MATERIALIZED (SELECT sha, module, tag, source, unnest(list_filter(regexp_split_to_array(lower(doc_text), '{NOT_WORD}'),
  lambda x: x <> '')) AS term FROM corpus WHERE {where}),
btc AS (SELECT sha, module, tag, source, term, count(*) AS tf FROM bt GROUP BY ALL),
btf AS MATERIALIZED (SELECT *, sum(tf) OVER (PARTITION BY sha) AS len FROM btc),
bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term),
bn AS (SELECT count(*) AS n FROM corpus WHERE {where})"""


@query(
    f"WITH {CORPUS}, {bm25_sql()} SELECT sha, term, tf, round(tf*2.2/(tf+1.2*(0.25+0.75*len/256)), 6) AS weight FROM btf"
)
def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.postings(views.spark_corpus(spark, sf_dir))
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {CORPUS}, {bm25_sql()}, qt AS (SELECT DISTINCT item_id AS query_id,
  unnest(list_filter(regexp_split_to_array(lower(text), '{NOT_WORD}'), lambda x: x <> '')) AS term FROM benchmark),
s AS (SELECT query_id, sha, round(sum(tf*2.2/(tf+1.2*(0.25+0.75*len/256)) * ln(1+(n-df+0.5)/(df+0.5))), 9) AS score
  FROM qt JOIN btf USING (term) JOIN bdf USING (term), bn GROUP BY ALL)
SELECT query_id, sha, round(score, 6) AS score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, sha) - 1 AS INTEGER) AS rank FROM s QUALIFY rank < 50"""
)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query over all documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = lexical.bm25_search(views.spark_corpus(spark, sf_dir), items)
    return hits.select("query_id", "sha", F.round("score", 6).alias("score"), "rank")


# ---- fusion --------------------------------------------------------------------

# A rank list per user and event type; the items are the property values.
_LISTS = """SELECT user_id AS query_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
  WHEN 'error' THEN 3 ELSE 4 END AS INT) AS list_id, event_type AS system, props AS sha, max(value) AS score,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY max(value) DESC, props) - 1 AS rank
FROM events GROUP BY user_id, event_type, props"""
LISTS = f"lists AS MATERIALIZED ({_LISTS})"


def rank_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.tables(spark, sf_dir, "events")
    return spark.sql(_LISTS).withColumn("rank", F.col("rank").cast("int"))


FIRST = "min({'l': list_id, 'r': rank})"


@query(
    f"""WITH {LISTS}, f AS (SELECT query_id, sha, round(sum(1.0::DOUBLE/(60+rank+1)), 9) AS score, {FIRST} AS seen
  FROM lists GROUP BY ALL)
SELECT query_id, sha, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, sha) - 1 AS INTEGER) AS rank
FROM f QUALIFY rank < 20"""
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_top_k(fusion.rrf(rank_lists(spark, sf_dir)), 20).select("query_id", "sha", "score", "rank")


@query(
    f"""WITH {LISTS}, st AS (SELECT query_id, list_id, avg(score) AS m, stddev_samp(score) AS sd FROM lists GROUP BY ALL),
f AS (SELECT query_id, sha, round(sum(CASE WHEN sd > 0 THEN (score-(m-3*sd))/(6*sd) ELSE 0.5 END), 9) AS score, {FIRST} AS seen
  FROM lists JOIN st USING (query_id, list_id) GROUP BY ALL)
SELECT query_id, sha, round(score, 6) AS score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, seen, sha) - 1 AS INTEGER) AS rank FROM f QUALIFY rank < 20"""
)
def dbsf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fusion.fused_top_k(fusion.dbsf(rank_lists(spark, sf_dir)), 20)
    return top.select("query_id", "sha", F.round("score", 6).alias("score"), "rank")


# ---- search systems -------------------------------------------------------------


def search_queries(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query set, each with the mean vector of the label of its number."""
    means = dense.label_means(docs).withColumnRenamed("query_id", "label")
    queries = spark_queries(spark)
    return queries.join(means, queries["query_id"] == means["label"], "left").drop("label")


CORPUS_MEANS = MEANS.replace("<vectors>", "corpus WHERE embedding IS NOT NULL")
IDENT = "(regexp_full_match(q.query, '[A-Za-z0-9_.]+') AND (contains(q.query,'_') OR contains(q.query,'.') OR regexp_matches(q.query,'[a-z][A-Z]')))"
QVEC = f"""qv AS MATERIALIZED (SELECT q.*, vector, {IDENT} AS ident FROM q LEFT JOIN means ON label = query_id)"""
SEM = f"""sims AS (SELECT q.query_id, sha, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.vector), 9) AS score
  FROM qv q JOIN corpus c ON c.embedding IS NOT NULL AND q.vector IS NOT NULL AND {{which}} AND {PASS}),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sha) - 1 AS rank FROM sims QUALIFY rank < 50)"""
HYBRID = f"""{CORPUS}, {TOKENS}, {Q}, {CORPUS_MEANS}, {QVEC}, {EXACT}, {LEX}, {SEM.format(which="NOT q.ident")},
runs AS (SELECT query_id, 0 AS list_id, rank, sha FROM exact JOIN qv USING (query_id) WHERE ident
  UNION ALL SELECT query_id, 1, rank, sha FROM sem UNION ALL SELECT query_id, 2, rank, sha FROM lex),
fused AS (SELECT query_id, sha, round(sum(1.0::DOUBLE/(61+rank)), 9) AS score, {FIRST} AS seen,
  min(CASE WHEN list_id=0 THEN rank END) AS pinned FROM runs GROUP BY ALL),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned NULLS LAST, score DESC, seen, sha) AS rank
  FROM fused QUALIFY rank <= 10)"""
VECTOR = f"""{CORPUS}, {Q}, {CORPUS_MEANS}, {QVEC}, {SEM.format(which="true")}, {bm25_sql("embedding IS NOT NULL")},
qt AS (SELECT DISTINCT query_id, qmodule, qtag, qsource, unnest(list_filter(regexp_split_to_array(lower(query), '{NOT_WORD}'),
  lambda x: x <> '')) AS term FROM q),
bs AS (SELECT q.query_id, c.sha, round(sum(tf*2.2/(tf+1.2*(0.25+0.75*len/256)) * ln(1+(n-df+0.5)/(df+0.5))), 9) AS score
  FROM qt q JOIN btf c USING (term) JOIN bdf USING (term), bn WHERE {PASS} GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sha) - 1 AS rank FROM bs QUALIFY rank < 50),
runs AS (SELECT query_id, 0 AS list_id, rank, sha, score FROM sem UNION ALL SELECT query_id, 1, rank, sha, score FROM bm),
st AS (SELECT query_id, list_id, avg(score) AS m, stddev_samp(score) AS sd FROM runs GROUP BY ALL),
fused AS (SELECT query_id, sha, round(sum(<gain>), 9) AS score, {FIRST} AS seen FROM runs JOIN st USING (query_id, list_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, sha) AS rank FROM fused QUALIFY rank <= 10)"""
RRF_GAIN = "1.0::DOUBLE/(3+rank)"
DBSF_GAIN = "CASE WHEN sd > 0 THEN (score-(m-3*sd))/(6*sd) ELSE 0.5 END"
HIT = f"""query_id, CAST(rank AS INTEGER) AS rank, sha, c.tag, c.subject, coalesce(c.module,'') AS modules, {iso("authored_at")} AS authored_at,
 'https://example.org/'||CASE c.source WHEN 'src1' THEN 'example/first' WHEN 'src2' THEN 'example/second' ELSE 'example/other' END
 ||'/commit/'||sha AS link"""


def _hits(found: DataFrame) -> DataFrame:
    return found.withColumn("modules", F.array_join("modules", ",")).withColumn("snippet", F.md5("snippet"))


@query(f"WITH {HYBRID} SELECT {HIT}, md5(nullif(trim(left(diff_text,400), '{WS}'), '')) AS snippet FROM hybrid JOIN corpus c USING (sha)")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.spark_corpus(spark, sf_dir)
    return _hits(search.search(docs, search_queries(spark, docs), system="hybrid", **LINKS))


@query(f"WITH {VECTOR.replace("<gain>", RRF_GAIN)} SELECT {HIT}, CAST(NULL AS VARCHAR) AS snippet FROM ranked JOIN corpus c USING (sha)")
def dense_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.spark_corpus(spark, sf_dir)
    return _hits(search.search(docs, search_queries(spark, docs), system="vector", **LINKS))


@query(f"WITH {VECTOR.replace("<gain>", DBSF_GAIN)} SELECT query_id, CAST(rank AS INTEGER) AS rank, sha, round(score, 6) AS score FROM ranked")
def dense_bm25_dbsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.spark_corpus(spark, sf_dir)
    ranked = search.vector_rank(docs, search_queries(spark, docs), fuse="dbsf")
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), "sha", F.round("score", 6).alias("score"))


@query(f"WITH {VECTOR.replace("<gain>", RRF_GAIN)} SELECT {HIT}, CAST(NULL AS VARCHAR) AS snippet FROM ranked JOIN corpus c USING (sha)")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over what `load` has written: stored vectors and postings."""
    corpus, docs = Corpus(spark, work_path(spark, "corpus"), sharded=False), views.spark_corpus(spark, sf_dir)
    corpus.commits.append(docs)
    corpus.vectors.append(docs.where("embedding IS NOT NULL").select("sha", "embedding"))
    corpus.load()
    stored = dict(vectors=corpus.search_vectors(), postings=corpus.search_postings())
    return _hits(search.search(corpus.commits.read(), search_queries(spark, docs), system="vector", **stored, **LINKS))


CLAMPED = VECTOR.replace("<gain>", RRF_GAIN).replace("rank <= 10", "rank <= 50")


@query(
    f"""WITH {CLAMPED} SELECT query_id, CAST(rank AS INTEGER) AS rank, sha FROM ranked
WHERE rank <= least(50, greatest(1, CASE query_id % 4 WHEN 0 THEN -3 WHEN 1 THEN 7 WHEN 2 THEN 99 ELSE 5 END))"""
)
def search_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that ask for too few, too many and no stated number of hits."""
    docs = views.spark_corpus(spark, sf_dir)
    k = F.expr("CASE query_id % 4 WHEN 0 THEN -3 WHEN 1 THEN 7 WHEN 2 THEN 99 END")
    queries = search_queries(spark, docs).withColumn("k", k)
    return search.search(docs, queries, system="vector", k=5, **LINKS).select("query_id", "rank", "sha")


BATCH = f"""{VECTOR.replace("<gain>", RRF_GAIN).replace("rank < 50", "rank < 200").replace("rank <= 10", "rank <= 80")}"""


@query(f"WITH {BATCH} SELECT 'vector' AS system, query_id, CAST(rank - 1 AS INTEGER) AS rank, sha FROM ranked")
def batch_search_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings deeper than a search shows: 80 hits from pools of 200."""
    docs = views.spark_corpus(spark, sf_dir)
    return search.batch_search(docs, search_queries(spark, docs), ("vector",), k=80, pool=200)


# ---- lookup ----------------------------------------------------------------------

_LOOKUPS = """SELECT s_suppkey AS lookup_id, CASE s_suppkey % 7
 WHEN 0 THEN sha1(CAST(s_suppkey AS {str})) WHEN 1 THEN substr(sha1(CAST(s_suppkey AS {str})),1,12)
 WHEN 2 THEN concat(' ', substr(sha1(CAST(s_suppkey AS {str})),1,7), ' ') WHEN 3 THEN upper(sha1(CAST(s_suppkey AS {str})))
 WHEN 4 THEN concat(sha1(CAST(s_suppkey AS {str})), 'a') WHEN 5 THEN s_name
 ELSE substr(sha1(CAST(s_suppkey AS {str})),1,2) END AS sha FROM supplier"""


@query(
    f"""WITH {CURATED}, raw AS ({_LOOKUPS.format(str="VARCHAR")}), l AS (SELECT lookup_id, trim(sha, '{WS}') AS w FROM raw),
v AS (SELECT *, regexp_full_match(w, '[0-9a-fA-F]+') AS valid FROM l),
hit AS (SELECT lookup_id, count(*) AS n, min(c.sha) AS sha FROM v JOIN curated c ON valid AND (CASE WHEN length(w) >= 40
  THEN c.sha = w ELSE starts_with(c.sha, w) END) GROUP BY lookup_id)
SELECT v.lookup_id, CASE WHEN NOT valid THEN 'sha must be a hex commit id or prefix' WHEN n IS NULL THEN 'no commit matching '''||w||''''
  WHEN n > 1 THEN 'prefix '''||w||''' is ambiguous — give more characters' END AS error,
 c.sha, c.subject, array_to_string(mods,',') AS modules, files, n_files, {iso("c.authored_at")} AS authored_at,
 'https://example.org/example/'||CASE c.source WHEN 'enterprise' THEN 'second' ELSE 'first' END||'/commit/'||c.sha AS link,
 md5(CASE WHEN length(diff_text) > 5000 THEN left(diff_text,5000)||chr(10)||'... [truncated at 5000 chars]' ELSE diff_text END) AS diff_md5,
 length(diff_text) > 5000 AS truncated
FROM v LEFT JOIN hit USING (lookup_id) LEFT JOIN curated c ON hit.sha = c.sha AND hit.n = 1"""
)
def commit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full ids, prefixes, upper-case ids, too long ids and names, one request per supplier."""
    docs = staged(curate(views.spark_commit_src(spark, sf_dir), RULES), "commits")
    views.tables(spark, sf_dir, "supplier")
    found = lookup.lookup(
        docs,
        spark.sql(_LOOKUPS.format(str="STRING")),
        repo_by_source={"enterprise": "example/second"},
        default_repo="example/first",
        link_base="https://example.org",
        max_chars=5000,
    )
    return found.select(
        "lookup_id",
        "error",
        "sha",
        "subject",
        F.array_join("modules", ",").alias("modules"),
        F.array_join("files", ",").alias("files"),
        "n_files",
        "authored_at",
        "link",
        F.md5("diff_text").alias("diff_md5"),
        "truncated",
    )
