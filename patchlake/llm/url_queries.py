"""Registered query of the URL filter and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlake.llm import urls
from patchlake.llm.registry import register, table

# The rules of the contract, and the sites whose pages make up the block list.
RULES = [
    urls.Rule.parse("allow", "org/"),
    urls.Rule.parse("block", "example.org/es/"),
    urls.Rule.parse("block", "example.org/en/1"),
    urls.Rule.parse("allow", "com/fr/"),
    urls.Rule.parse("block", "com/de/"),
]
BLOCKED_SITES = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$"

OP3_SQL = """
WITH rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM rests
), named AS (
  SELECT page_id, host, path, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref='))), '&'), ''), '') END AS name
  FROM parts
), listed AS (
  SELECT DISTINCT name FROM named WHERE regexp_matches(host, '(^|\\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$')
), rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), judged AS (
  SELECT p.page_id, p.host, p.path, p.name, max_by(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
    max_by(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
  FROM (SELECT *, row_number() OVER () AS row_no FROM named) p
  LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.row_no, p.page_id, p.host, p.path, p.name
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN name IN (SELECT name FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""


@register("op3_url_filter", OP3_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url: rules first, then the list of all canonical urls of the blocked sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(urls.host_of(F.col("url")).rlike(BLOCKED_SITES)).select(urls.canonical(F.col("url")).alias("canonical"))
    out = urls.judge(pages, listed, RULES)
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))
