"""Registered query of the ranked lexical search and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchlake.llm import shared_search
from patchlake.llm.registry import register, table

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS terms FROM documents
), counts AS MATERIALIZED (SELECT id, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), sums AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM counts
), tfs AS MATERIALIZED (SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY ALL
), dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term
), wanted AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), weighted AS (SELECT item_id, term, times, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM wanted JOIN dfs USING (term), sums
), lengths AS (SELECT id, doc_id, (25 + (75 * n::HUGEINT * n_docs) // n_terms)::BIGINT AS m FROM counts, sums
), scores AS (
  SELECT item_id, id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM weighted JOIN tfs USING (term) JOIN lengths USING (id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN lengths USING (id) WHERE score > 0 QUALIFY rank <= 10
"""


@register("op13_shared_search", OP13_SQL)
def op13_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return shared_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
