"""Registered query of the HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchlake.llm import wrapper
from patchlake.llm.registry import register, table


@register("op11_wrapper_text")
def op11_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
