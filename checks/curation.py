"""Log parsing and curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.registry import iso, query
from patchlake.functions import text as X
from patchlake.functions.arrays import posexplode_rows
from patchlake.functions.rules import Rules
from patchlake.operators import curate as C
from patchlake.operators import maintain
from patchlake.session import work_path
from patchlake.sources import changelog, files

RULES = Rules()

SRC = f"commit_src AS MATERIALIZED ({views.COMMIT_SRC_DUCK})"

# File blocks by plain string splitting, rules as CASE.
BLOCKS = (
    SRC
    + r""",
parts AS (SELECT sha, subject, source, string_split(chr(10)||patch, chr(10)||'diff --git ') AS ps FROM commit_src),
blocks AS (SELECT sha, subject, source, CAST(i-2 AS INTEGER) AS pos,
  'diff --git '||ps[i]||CASE WHEN i < len(ps) THEN chr(10) ELSE '' END AS block
  FROM parts, unnest(range(2, len(ps)+1)) t(i)),
pathed AS (SELECT *, regexp_extract(split_part(block, chr(10), 1), '^diff --git a/(.+?) b/(\S+)', 2) AS path FROM blocks),
named AS (SELECT *, CASE WHEN starts_with(path,'addons/') THEN split_part(path,'/',2)
    WHEN starts_with(path,'core/') THEN 'core' ELSE split_part(path,'/',1) END AS module,
  split_part(path,'/',-1) AS base FROM pathed WHERE path <> ''),
ruled AS (SELECT *, CASE WHEN contains(base,'.') THEN lower(split_part(base,'.',-1)) ELSE '' END AS ext,
  CASE WHEN module='core' THEN false
    WHEN module LIKE 'l10n\_de%' ESCAPE '\' OR module LIKE 'l10n\_ch%' ESCAPE '\' OR module IN ('payment_custom',
      'payment_paypal','payment_novalnet','payment_novalnet_ext','payment_sepa_direct_debit') THEN false
    WHEN regexp_matches(module, '^(l10n_.*|point_of_sale|pos_.*|spreadsheet.*|payment_.*)$') THEN true
    ELSE false END AS excluded,
  (path LIKE '%.pot' OR (path LIKE '%/i18n/%' AND path LIKE '%.po') OR path LIKE '%/static/lib/%'
    OR base LIKE '%.min.%' OR base IN ('package-lock.json','yarn.lock','pnpm-lock.yaml','poetry.lock','Pipfile.lock'))
    AS skipped FROM named),
capped AS (SELECT *, CASE WHEN ext IN ('js','css','scss','less') AND length(block) > 2000
  THEN split_part(block,chr(10),1)||chr(10)||'[diff omitted: '||length(block)||' chars > 2000 ('||ext||' asset)]'||chr(10)
  ELSE block END AS cut FROM ruled WHERE NOT excluded AND NOT skipped)
"""
)
TAG = r"nullif(regexp_extract(subject, '^\s*\[([A-Z0-9_]+)\]', 1), '')"
CURATED = (
    BLOCKS
    + f""",
agg AS (SELECT sha, string_agg(cut,'' ORDER BY pos) AS full_diff, string_agg(path,',' ORDER BY pos) AS files,
  list_sort(list_distinct(list(module))) AS mods, CAST(count(*) AS INTEGER) AS n_files FROM capped GROUP BY sha),
cur AS (SELECT c.sha, c.source, c.authored_at, c.committed_at, {TAG} AS tag, c.subject, c.body, mods, files, n_files,
  CASE WHEN length(full_diff) > 24000 THEN left(full_diff,24000)||chr(10)||'[commit diff truncated at 24000 chars]'||chr(10)
    ELSE full_diff END AS diff_text FROM commit_src c JOIN agg USING (sha)
  WHERE coalesce({TAG},'') <> 'MERGE'),
curated AS MATERIALIZED (SELECT *, trim('modules: '||array_to_string(mods,', ')||chr(10)||subject||chr(10)||chr(10)||body
  ||chr(10)||chr(10)||diff_text, ' '||chr(9)||chr(10)||chr(13)) AS doc_text FROM cur)
"""
)
CURATED_COLUMNS = f"""sha, source, {iso("authored_at")} AS authored_at, {iso("committed_at")} AS committed_at, tag, subject, body,
 array_to_string(mods,',') AS modules, files, n_files, md5(diff_text) AS diff_md5, md5(doc_text) AS doc_md5"""


def curated_columns(df: DataFrame) -> DataFrame:
    """Comparable form: arrays as text, long texts as digests."""
    return df.select(
        "sha",
        "source",
        X.format_iso_time(F.col("authored_at")).alias("authored_at"),
        X.format_iso_time(F.col("committed_at")).alias("committed_at"),
        "tag",
        "subject",
        "body",
        F.array_join("modules", ",").alias("modules"),
        F.array_join("files", ",").alias("files"),
        "n_files",
        F.md5("diff_text").alias("diff_md5"),
        F.md5("doc_text").alias("doc_md5"),
    )


def written_log(spark: SparkSession, sf_dir: str) -> str:
    """commit_src as a log in a fresh folder of the shared work area."""
    path = work_path(spark, "log")
    src = views.spark_commit_src(spark, sf_dir)
    changelog.write_log(src.withColumn("author_name", F.col("source")).withColumn("author_email", F.lit("")), path)
    return path


@query(
    f"""WITH {SRC} SELECT sha, source AS author_name, {iso("authored_at")} AS authored_at, {iso("committed_at")} AS committed_at,
 subject, body, length(patch) AS n_chars, md5(patch) AS patch_md5 FROM commit_src"""
)
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = changelog.parse_records(changelog.read_log(spark, written_log(spark, sf_dir)))
    return parsed.select(
        "sha",
        "author_name",
        X.format_iso_time(F.col("authored_at")).alias("authored_at"),
        X.format_iso_time(F.col("committed_at")).alias("committed_at"),
        "subject",
        "body",
        F.length("patch").cast("long").alias("n_chars"),
        F.md5("patch").alias("patch_md5"),
    )


@query(f"WITH {BLOCKS} SELECT sha, pos, path, module, ext, length(block) AS n_chars, md5(block) AS block_md5 FROM ruled")
def curate_split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = C.explode_blocks(views.spark_commit_src(spark, sf_dir), RULES)
    return blocks.select(
        "sha",
        "pos",
        "path",
        "module",
        X.extension(F.col("path")).alias("ext"),
        F.length("block").cast("long").alias("n_chars"),
        F.md5("block").alias("block_md5"),
    )


@query(
    f"""WITH {BLOCKS} SELECT sha, pos, path, module, excluded, skipped, starts_with(path,'core/') AS in_core,
 NOT excluded AND NOT skipped AS kept FROM ruled"""
)
def curate_filter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, module = F.col("path"), F.col("module")
    blocks = C.explode_blocks(views.spark_commit_src(spark, sf_dir), RULES)
    return blocks.select(
        "sha",
        "pos",
        "path",
        "module",
        RULES.module_excluded(module).alias("excluded"),
        RULES.file_skipped(path).alias("skipped"),
        Rules(roots=("core/",)).in_roots(path).alias("in_core"),
        C.keeps(path, module, RULES).alias("kept"),
    )


@query(
    f"""WITH {BLOCKS} SELECT sha, path, length(cut) AS n_chars, md5(cut) AS cut_md5,
 CAST(row_number() OVER (PARTITION BY sha ORDER BY pos) - 1 AS INTEGER) AS kept_pos FROM capped"""
)
def curate_asset_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = views.spark_commit_src(spark, sf_dir)
    rows = posexplode_rows(src, C.kept_blocks(F.col("patch"), RULES), "b", "sha", pos="kept_pos")
    return rows.select(
        "sha",
        "kept_pos",
        "b.path",
        F.length("b.block").cast("long").alias("n_chars"),
        F.md5("b.block").alias("cut_md5"),
    )


@query(f"WITH {CURATED} SELECT {CURATED_COLUMNS} FROM curated")
def curate_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated_columns(C.curate(views.spark_commit_src(spark, sf_dir), RULES))


@query(f"WITH {SRC} SELECT {TAG} AS tag, source, count(*) AS n FROM commit_src GROUP BY ALL")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = views.spark_commit_src(spark, sf_dir)
    return src.groupBy(X.subject_tag(F.col("subject")).alias("tag"), "source").agg(F.count("*").alias("n"))


@query(
    f"""WITH corpus AS ({views.CORPUS_DUCK}) SELECT count(*) AS commits, count(embedding) AS embedded,
 count(*) FILTER (tag='FIX') AS fixes, CAST(sum(length(doc_text)) AS BIGINT) AS chars,
 round(sum(length(doc_text))/4, 6) AS est_tokens, round(sum(length(doc_text))/4/1e6*0.12, 6) AS est_cost FROM corpus"""
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = maintain.corpus_stats(views.spark_corpus(spark, sf_dir), 0.12)
    return stats.withColumn("est_tokens", F.round("est_tokens", 6)).withColumn("est_cost", F.round("est_cost", 6))


@query(
    f"""WITH {CURATED} SELECT source, count(*) AS commits, count(*) FILTER (tag='FIX') AS fixes,
 CAST(sum(length(doc_text)) AS BIGINT) AS chars FROM curated GROUP BY source"""
)
def curated_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.curate(views.spark_commit_src(spark, sf_dir), RULES).withColumn("embedding", F.lit(None).cast("array<float>"))
    return maintain.corpus_stats(docs, 0.12, "source").select("source", "commits", "fixes", "chars")


INSTALLED = ("account", "sale", "l10n_de_reports", "payment", "spreadsheet_dashboard", "core")


@query(
    f"""WITH {BLOCKS} SELECT sha, pos, path, module FROM ruled WHERE module='core' OR (NOT excluded AND
 (module IN ('account','sale','payment') OR module IN ('l10n_de_reports','payment_paypal')))"""
)
def installed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allow globs win over the installed list, which is read from a text file."""
    path = work_path(spark, "modules")
    lines = ["# installed", "", *[f"  {m} " for m in INSTALLED], "sale"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    blocks = C.explode_blocks(views.spark_commit_src(spark, sf_dir), RULES)
    return C.keep_installed(blocks, files.read_module_list(spark, path), RULES).select("sha", "pos", "path", "module")


@query(
    f"""WITH {BLOCKS} SELECT DISTINCT module, excluded FROM ruled
 WHERE sha NOT IN (SELECT sha1(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')"""
)
def module_prune_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules touched by the commits reachable at the end of a range and not at its start."""
    at_end = C.touched_modules(views.spark_commit_src(spark, sf_dir), RULES)
    at_start = spark.sql(
        "SELECT sha1(CAST(o_orderkey AS STRING)) AS sha FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"
    )
    return C.module_dim(changelog.in_range(at_end, at_start), RULES)
