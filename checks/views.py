"""Inputs derived from the driver tables by the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.functions.arrays import let
from patchlake.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# One commit per order, one file block per line item.
_DIMENSIONS = """m(mi, module) AS (VALUES (0,'account'),(1,'sale'),(2,'stock'),(3,'mrp'),(4,'mail'),
  (5,'l10n_fr'),(6,'l10n_de_reports'),(7,'point_of_sale'),(8,'pos_restaurant'),(9,'postmark_mail'),
  (10,'spreadsheet_dashboard'),(11,'payment_stripe'),(12,'payment_paypal'),(13,'payment'),(14,'core')),
f(fi, file, mult) AS (VALUES (0,'models/model.py',1),(1,'views/view.xml',1),(2,'i18n/de.po',1),
  (3,'i18n/module.pot',1),(4,'static/lib/x/x.js',1),(5,'static/src/app.js',8),
  (6,'static/src/app.min.js',1),(7,'package-lock.json',1),(8,'static/src/style.scss',8),
  (9,'tests/test_model.py',40)),
n AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag, l_linestatus, l_shipdate, p_name, module, file, mult
  FROM lineitem JOIN part ON l_partkey=p_partkey JOIN m ON mi=l_partkey % 15 JOIN f ON fi=l_suppkey % 10)"""
_HEADER = """SELECT sha1(CAST(o_orderkey AS {str})) AS sha,
  CASE WHEN o_orderstatus='P' THEN 'enterprise' ELSE 'community' END AS source,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS authored_at,
  CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE o_orderdate END AS committed_at,
  concat(CASE substr(o_orderpriority,1,1) WHEN '1' THEN '[FIX] ' WHEN '2' THEN '[IMP] '
    WHEN '3' THEN '  [REF] ' WHEN '4' THEN '[MERGE] ' ELSE 'no tag [FIX] ' END,
    'order ', CAST(o_orderkey AS {str})) AS subject,
  concat('customer ', CAST(o_custkey AS {str})) AS body"""
_COMMIT_SRC = (
    "\nWITH "
    + _DIMENSIONS
    + """,
r AS (
  SELECT k, p_name, l_quantity, module, file, mult,
    row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos
  FROM n),
b AS (
  SELECT k, pos, CASE WHEN module='core' THEN concat('core/',file) ELSE concat('addons/',module,'/',file) END AS path,
    repeat(concat('+', p_name, chr(10)), CAST(l_quantity AS INT)*mult) AS body
  FROM r),
p AS (
  SELECT k, {agg} AS patch FROM (
    SELECT k, pos, concat('diff --git a/',path,' b/',path,chr(10),'@@ -0,0 +1 @@',chr(10),body) AS block
    FROM b) x GROUP BY k)
"""
    + _HEADER
    + """,
  patch
FROM orders JOIN p ON o_orderkey=k
"""
)

# The same for Spark: the line items of a commit are one array of narrow structs, ordered by their leading
# fields, until it has met its order.
_COMMIT_ITEMS = (
    "WITH "
    + _DIMENSIONS
    + """,
p AS (
  SELECT k, collect_list(struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag, l_linestatus, l_shipdate, p_name, module, file, mult)) AS items
  FROM (SELECT * FROM n DISTRIBUTE BY k) GROUP BY k)
"""
    + _HEADER
    + """,
  items
FROM orders JOIN p ON o_orderkey=k
"""
)

# Documents as stored commits: half have a vector, times come from the events.
_CORPUS = """
SELECT sha1(CAST(d.doc_id AS {str})) AS sha, d.source, upper(d.lang) AS tag,
  concat('document ', CAST(d.doc_id AS {str})) AS subject, CAST(NULL AS {str}) AS body,
  CASE WHEN e.label IS NULL THEN NULL ELSE concat('label', CAST(e.label AS {str})) END AS module,
  CASE WHEN d.doc_id % 20 = 0 THEN NULL ELSE t.ts END AS authored_at,
  CASE WHEN d.doc_id % 30 = 0 THEN NULL ELSE t.ts END AS committed_at,
  d.text AS diff_text, d.text AS doc_text, e.embedding, e.label
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN events t ON t.event_id = d.doc_id
"""

COMMIT_SRC_DUCK = _COMMIT_SRC.format(agg="string_agg(block, '' ORDER BY pos)", str="VARCHAR")
CORPUS_DUCK = _CORPUS.format(str="VARCHAR")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def spark_commit_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch is made last, row by row: no text of a patch is sorted, joined or shuffled."""
    tables(spark, sf_dir, "orders", "lineitem", "part")

    def block(x):
        path = F.when(x["module"] == "core", F.concat(F.lit("core/"), x["file"])).otherwise(F.concat(F.lit("addons/"), x["module"], F.lit("/"), x["file"]))
        body = F.repeat(F.concat(F.lit("+"), x["p_name"], F.lit("\n")), x["l_quantity"].cast("int") * x["mult"])
        return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n@@ -0,0 +1 @@\n"), body)

    blocks = F.filter(F.transform(F.sort_array("items"), block), lambda b: b.isNotNull())
    patch = let(blocks, lambda b: F.when(F.size(b) > 0, F.array_join(b, "")))
    return spark.sql(_COMMIT_ITEMS.format(str="STRING")).withColumn("patch", patch).drop("items")


def spark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with `modules` as an array, as search expects it."""
    tables(spark, sf_dir, "embeddings", "events")
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").createOrReplaceTempView("documents")
    rows = spark.sql(_CORPUS.format(str="STRING"))
    return rows.selectExpr(
        "sha", "source", "tag", "subject", "body",
        "CASE WHEN module IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE array(module) END AS modules",
        "authored_at", "committed_at", "1 AS n_files", "diff_text", "doc_text", "embedding", "label",
    )
