"""Batch commit lookup by id or unique prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.functions import text as X
from patchlake.functions.bounds import is_small, settled
from patchlake.operators.fusion import hydrate
from patchlake.sources.store import MAX_PUSHED, SHARD_CHARS, one_of, pushed_lists

# A full id, the default cut, the columns of a record.
FULL_ID_CHARS = 40
MAX_DIFF_CHARS = 24000
# Prefixes that a scan tests one by one; beyond them only the shards of the requests are read.
MAX_PREFIXES = 256
RECORD = ("source", "tag", "subject", "body", "modules", "files", "n_files", "authored_at", "diff_text")


def lookup(
    commits: DataFrame,
    lookups: DataFrame,
    *,
    repo_by_source: dict[str, str],
    default_repo: str,
    link_base: str,
    max_chars: int = MAX_DIFF_CHARS,
) -> DataFrame:
    """One row per (lookup_id, sha) request: the commit record or an `error`.

    Ids are cut to the prefix lengths that were asked for and meet the requests
    in an equi join; matches are counted per request before anything is read
    in full, so a short prefix that fits a large part of the table stays cheap.
    """
    requests = lookups.select("lookup_id", X.strip(F.coalesce("sha", F.lit(""))).alias("wanted"))
    requests = requests.withColumn("valid", X.is_hex_id(F.col("wanted")))
    valid = requests.where("valid")
    is_full = F.length("wanted") >= FULL_ID_CHARS
    # A full id must equal the whole sha, which length 0 stands for.
    asked = valid.select("lookup_id", F.col("wanted").alias("part"), F.when(is_full, 0).otherwise(F.length("wanted")).alias("n"))
    small = is_small(requests)
    lengths = asked.agg(F.collect_set("n")).scalar()
    part = F.when(F.col("n") == 0, F.col("sha")).otherwise(F.expr("left(sha, n)"))
    ids = commits
    if small:
        named = asked.select("part", "n").distinct().collect()
        starts = {r["part"][:SHARD_CHARS] for r in named}
        if "shard" in commits.columns and all(len(start) == SHARD_CHARS for start in starts):
            # Requests that name a whole shard restrict the scan to it.
            ids = commits.where(F.col("shard").isin(sorted(starts)))
        whole, prefixes = [r["part"] for r in named if r["n"] == 0], [r["part"] for r in named if r["n"]]
        if len(whole) <= MAX_PUSHED and len(prefixes) <= MAX_PREFIXES:
            # Ids and prefixes reach the scan, which skips pages of a table clustered by id.
            pushed_lists(commits.sparkSession)
            fits = reduce(lambda a, b: a | b, [F.col("sha").startswith(p) for p in prefixes], one_of("sha", whole))
            ids = ids.where(fits)
    parts = ids.select("sha", F.explode(lengths).alias("n")).select("sha", "n", part.alias("part"))
    found = parts.join(F.broadcast(asked) if small else asked, ["n", "part"])
    counted = found.groupBy("lookup_id").agg(F.count("*").alias("n_found"), F.min("sha").alias("sha"))
    counted = settled(counted) if small else counted
    unique = counted.where(F.col("n_found") == 1).select("lookup_id", "sha")
    record = hydrate(unique, commits, *RECORD, few=small)

    outcome = requests.join(counted.select("lookup_id", "n_found"), "lookup_id", "left").join(record, "lookup_id", "left")
    quoted = F.concat(F.lit("'"), F.col("wanted"), F.lit("'"))
    error = (
        F.when(~F.col("valid"), F.lit("sha must be a hex commit id or prefix"))
        .when(F.col("n_found").isNull(), F.concat(F.lit("no commit matching "), quoted))
        .when(F.col("n_found") > 1, F.concat(F.lit("prefix "), quoted, F.lit(" is ambiguous — give more characters")))
    )
    diff, truncated = X.truncate_diff(F.col("diff_text"), max_chars)
    hit = F.col("sha").isNotNull()
    return outcome.select(
        "lookup_id",
        error.alias("error"),
        "sha",
        "source",
        "tag",
        "subject",
        "body",
        F.when(hit, F.coalesce("modules", F.array().cast("array<string>"))).alias("modules"),
        F.when(hit, F.coalesce("files", F.array().cast("array<string>"))).alias("files"),
        "n_files",
        X.format_iso_time(F.col("authored_at")).alias("authored_at"),
        X.commit_link(F.col("sha"), F.col("source"), repo_by_source, default_repo, link_base).alias("link"),
        F.when(hit, diff).alias("diff_text"),
        F.when(hit, truncated).alias("truncated"),
    )

