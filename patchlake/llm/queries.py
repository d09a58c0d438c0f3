"""All registered queries of this subpackage."""

from patchlake.llm import ann_queries, lang_queries, manifest_queries, near_queries, page_queries, search_queries, shard_queries, text_queries, url_queries, winnow_queries  # noqa: F401
from patchlake.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
