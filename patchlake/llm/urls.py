"""URL filters: a blocked Bloom filter in front of an exact hash join, and host and path rules.

All steps are DataFrame operations. A null url, or one without `://`, has an empty host and path, is on no
list and fits no rule. Repeated rows stay repeated; the columns of the caller are kept under their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # 32-bit words of a block; a key sets one bit in each
BITS_PER_KEY = 16
BROADCAST_BYTES = 32 << 20
KEY = "__llm_canonical"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with the rule's path."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def parse(verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return Rule(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    return F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without `www.`, path without a slash at the end, sorted parameters without tracking ones; no scheme, no fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_") & ~x.startswith("ref=")))
    return F.concat(
        F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    )


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: (len(x.text), x.text)):  # the longest comes last, so outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    hashed = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(hashed, 5 * k).bitwiseAND(31).cast("int")) for k in range(WORDS)]


def build_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(block, w0..w7) of a blocked Bloom filter over the distinct keys, and its number of blocks."""
    n = keys.agg(F.count_distinct(F.xxhash64(key))).head()[0]
    blocks = max(1, -(-n * BITS_PER_KEY // (32 * WORDS)))
    words = [F.bit_or(mask).alias(f"__llm_w{k}") for k, mask in enumerate(_bits(F.col(key)))]
    return keys.groupBy(_block(F.col(key), blocks).alias("__llm_block")).agg(*words), blocks


def split_by_list(urls: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """urls with a boolean column __llm_listed: whether key is in listed (one column, the same name).

    The filter is broadcast up to BROADCAST_BYTES and shuffled by block beyond. Only rows that pass it enter
    the exact join; a listed key with very many rows is split there by the adaptive skew join.
    """
    listed = listed.select(key).where(F.col(key).isNotNull()).distinct()
    bloom, blocks = build_filter(listed, key)
    if blocks * 4 * (WORDS + 4) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    inside = reduce(lambda a, b: a & b, [F.col(f"__llm_w{k}").bitwiseAND(mask) != 0 for k, mask in enumerate(_bits(F.col(key)))])
    probed = urls.withColumn("__llm_block", _block(F.col(key), blocks)).join(bloom, "__llm_block", "left").withColumn("__llm_maybe", F.coalesce(inside, F.lit(False)))
    probed = probed.drop("__llm_block", *[f"__llm_w{k}" for k in range(WORDS)])
    exact = probed.where("__llm_maybe").join(listed.withColumn("__llm_hit", F.lit(True)), key, "left").select(*urls.columns, F.col("__llm_hit").isNotNull().alias("__llm_listed"))
    return exact.unionByName(probed.where(~F.col("__llm_maybe")).select(*urls.columns, F.lit(False).alias("__llm_listed")))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """pages with url_host, url_path, url_rule and url_verdict.

    listed: one column of blocked canonical urls. The rule decides where one fits; else the list blocks and
    anything else is allowed. Columns of these four names are replaced;
    those that begin with `__llm_` are left out.
    """
    pages = pages.select(*[F.col(f"`{name}`") for name in pages.columns if not name.startswith("__llm_")])
    address = F.col(url)
    split = split_by_list(pages.withColumn(KEY, canonical(F.coalesce(address, F.lit("")))), KEY, listed.toDF(KEY))
    host, path = F.coalesce(host_of(address), F.lit("")), F.coalesce(path_of(address), F.lit(""))
    rule, verdict = best_rule(F.col("url_host"), F.col("url_path"), rules)
    by_list = F.when(F.col("__llm_listed"), "block").otherwise("allow")
    out = split.withColumn("url_host", host).withColumn("url_path", path)
    return out.withColumn("url_rule", rule).withColumn("url_verdict", F.coalesce(verdict, by_list)).drop(KEY, "__llm_listed")
