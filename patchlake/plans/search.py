"""Search systems: tables of queries in, ranked hits out, one plan for each block of queries."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlake.functions import text as X
from patchlake.functions.bounds import query_blocks, union_all
from patchlake.operators import block_index, cells, dense, fusion, lexical, literal
from patchlake.session import staged

POOL, DEFAULT_K = 50, 10
# Lists of the hybrid system, in the order fusion reads them.
EXACT, SEMANTIC, LEXICAL = 0, 1, 2


def _fulltext_column() -> Column:
    return X.search_text(F.col("subject"), F.col("body"), F.col("diff_text"))


def _as_list(hits: DataFrame, list_id: int, key: str) -> DataFrame:
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    return hits.select("query_id", F.lit(list_id).alias("list_id"), "rank", F.col(key), score.alias("score"))


def _cut(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries may carry their own `k`."""
    if "k" not in queries.columns:
        return ranked
    own = queries.select("query_id", F.coalesce("k", F.lit(k)).alias("own_k"))
    return ranked.join(F.broadcast(own), "query_id").where(F.col("rank") < F.col("own_k")).drop("own_k")


def _depth(queries: DataFrame, k: int) -> int:
    if "k" not in queries.columns:
        return k
    return queries.agg(F.max(F.coalesce("k", F.lit(k)))).first()[0] or k


def hybrid_rank(
    docs: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    pool: int = POOL,
    rrf_k: int = fusion.RRF_K,
    key: str = "sha",
    vectors: DataFrame | None = None,
    grams: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, key, score): literal + full-text for identifiers, dense + full-text else.

    `queries` has (query_id, query, vector) and optionally module, tag, source
    and k; identifier-shaped queries need no vector. Their literal hits come
    first in recency order; the rest follows by fused rank. Every branch applies
    the filters before its own cut. `vectors` names a table of its own for the
    dense branch (key, embedding, modules, tag, source), so that texts and
    vectors need not be joined; by default `docs` has them. `grams` names a
    trigram index of the documents, so that literal queries read candidates only.
    """

    def block_rank(block: DataFrame) -> DataFrame:
        is_identifier = X.looks_like_identifier(F.col("query"))
        lists = union_all(
            [
                _as_list(literal.literal_search(docs, block.where(is_identifier), pool, key, grams), EXACT, key),
                _as_list(dense.dense_search(docs if vectors is None else vectors, block.where(~is_identifier), pool, key), SEMANTIC, key),
                _as_list(lexical.fulltext_search(docs, _fulltext_column(), block, pool, key), LEXICAL, key),
            ]
        )
        return _cut(fusion.pinned_top_k(lists, EXACT, _depth(queries, k), rrf_k, key), block, k)

    return union_all([block_rank(block) for block in query_blocks(queries)])


def vector_rank(
    docs: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    pool: int = POOL,
    fuse: str = "rrf",
    rrf_k: int = fusion.VECTOR_RRF_K,
    key: str = "sha",
    vectors: DataFrame | None = None,
    postings: block_index.Postings | None = None,
    near: cells.Cells | None = None,
) -> DataFrame:
    """(query_id, rank, key, score): dense and BM25 pools merged by rank or by score.

    `vectors` (key, embedding, modules, tag, source) and `postings` name the stored index; then `docs` isn't read.
    With `near` the dense pool is approximate and reads the probed cells only.
    """
    if postings is not None and vectors is None:
        raise ValueError("stored postings need the stored vectors beside them")
    if fuse not in ("rrf", "dbsf"):
        raise ValueError(f"unknown fusion {fuse!r}")

    def block_rank(block: DataFrame) -> DataFrame:
        embedded = (docs if vectors is None else vectors).where(F.col("embedding").isNotNull())
        words = lexical.bm25_search(embedded, block, pool, key) if postings is None else block_index.search(postings, block, pool, key)
        found = dense.dense_search(embedded, block, pool, key) if near is None else cells.search(near, block, pool, key)
        lists = union_all([_as_list(found, 0, key), _as_list(words, 1, key)])
        fused = fusion.rrf(lists, rrf_k, key) if fuse == "rrf" else fusion.dbsf(lists, key, pooled=True)
        return _cut(fusion.fused_top_k(fused, _depth(queries, k), key), block, k)

    return union_all([block_rank(block) for block in query_blocks(queries)])


SYSTEMS = {"hybrid": hybrid_rank, "vector": vector_rank}


def search(
    docs: DataFrame,
    queries: DataFrame,
    *,
    system: str = "hybrid",
    repo_by_source: dict[str, str],
    default_repo: str,
    link_base: str,
    key: str = "sha",
    **options,
) -> DataFrame:
    """Hits: query_id, rank (from 1), sha, tag, subject, modules, authored_at, link, snippet.

    An unknown system means the hybrid one; only that one shows a snippet. The
    link follows the source of the hit, whatever the query filtered on. k is
    clamped to the allowed range here, and not in the rankings themselves.
    """
    system = system if system in SYSTEMS else "hybrid"
    k = max(X.MIN_K, min(options.pop("k", DEFAULT_K), X.MAX_K))
    if "k" in queries.columns:
        queries = queries.withColumn("k", X.clamp_k(F.coalesce("k", F.lit(k))))
    columns = ["tag", "subject", "modules", "source", "authored_at"]
    snippet = F.lit(None).cast("string")
    if system == "hybrid":
        columns.append("diff_text")
        snippet = X.snippet(F.col("diff_text"))

    def block_hits(block: DataFrame) -> DataFrame:
        # One block of queries times k hits is a bounded ranking: it is broadcast, and only its shards are read.
        ranked = SYSTEMS[system](docs, block, k=k, key=key, **options).select("query_id", "rank", key)
        return fusion.hydrate(ranked, docs, *columns, few=True, key=key)

    found = union_all([block_hits(block) for block in query_blocks(queries)])
    return found.select(
        "query_id",
        (F.col("rank") + 1).alias("rank"),
        key,
        "tag",
        "subject",
        F.coalesce("modules", F.array().cast("array<string>")).alias("modules"),
        X.format_iso_time(F.col("authored_at")).alias("authored_at"),
        X.commit_link(F.col(key), F.col("source"), repo_by_source, default_repo, link_base).alias("link"),
        snippet.alias("snippet"),
    )


def batch_search(docs: DataFrame, queries: DataFrame, systems: tuple[str, ...] = ("hybrid", "vector"), **options) -> DataFrame:
    """(system, query_id, rank, sha): rankings of a query set by each system, for evaluation and pooling."""
    return union_all(
        [
            SYSTEMS[name](docs, queries, **options).select(F.lit(name).alias("system"), "query_id", "rank", "sha")
            for name in systems
        ]
    )


def timed_search(docs: DataFrame, queries: DataFrame, systems: tuple[str, ...] = ("hybrid", "vector"), **options) -> tuple[DataFrame, DataFrame]:
    """(rankings, runs): `batch_search` with (system, query_id, ms) of everything that was searched.

    Each system answers one block of queries after the other; a query's time is its share of its block's.
    """
    rankings, runs = [], []
    for block in query_blocks(queries):
        n = block.count()
        for name in systems:
            started = time.perf_counter()
            rankings.append(staged(batch_search(docs, block, (name,), **options), "ranked"))
            ms = (time.perf_counter() - started) * 1000 / max(n, 1)
            runs.append(block.select(F.lit(name).alias("system"), "query_id", F.lit(ms).alias("ms")))
    return union_all(rankings), union_all(runs)
