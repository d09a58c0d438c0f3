"""Judgments and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patchlake.functions.bounds import settled_if_small
from patchlake.operators.ranking import top_k
from patchlake.session import staged


# A median is read off a list of at most so many rows; ranges are cut at so many quantiles.
FEW_VALUES, QUANTILES = 10_000, 1_024


# ---- metrics ----------------------------------------------------------------


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + F.lit(2.0))


def query_metrics(rankings: DataFrame, qrels: DataFrame, k: int = 10, runs: DataFrame | None = None) -> DataFrame:
    """(system, query_id, recall, ndcg, ms) of every run whose query has judgments.

    `rankings` has (system, query_id, rank, sha) with 0-based ranks. `runs`
    lists what was searched, (system, query_id[, ms]), so that a system which
    found nothing scores 0; by default every list in `rankings` counts.
    """
    if runs is None:
        latency = [F.max("ms").alias("ms")] if "ms" in rankings.columns else [F.lit(None).cast("double").alias("ms")]
        runs = rankings.groupBy("system", "query_id").agg(*latency)
    elif "ms" not in runs.columns:
        runs = runs.withColumn("ms", F.lit(None).cast("double"))
    judged = qrels.select("query_id", "sha").distinct()
    wanted = judged.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    head = rankings.where(F.col("rank") < k).select("system", "query_id", "rank", "sha")
    found = (
        head.join(judged, ["query_id", "sha"])
        .groupBy("system", "query_id")
        .agg(F.size(F.collect_set("sha")).alias("hits"), F.sum(_gain(F.col("rank"))).alias("dcg"))
    )
    ideal = F.aggregate(
        F.sequence(F.lit(0), F.least("n_relevant", F.lit(k)).cast("int") - 1),
        F.lit(0.0),
        lambda total, i: total + _gain(i),
    )
    scored = runs.join(wanted, "query_id").join(found, ["system", "query_id"], "left")
    return scored.select(
        "system",
        "query_id",
        (F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        "ms",
    )


def system_metrics(per_query: DataFrame) -> DataFrame:
    """Means over queries (NULLs skipped, NaN when nothing is left) and upper-median latency."""

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(name), F.lit(float("nan"))).alias(f"mean_{name}")

    means = per_query.groupBy("system").agg(F.count("*").alias("n_queries"), mean("recall"), mean("ndcg"), mean("ms"))
    p50 = upper_median(per_query.select("system", "ms"), "ms", "system").withColumnRenamed("ms", "p50_ms")
    return means.join(p50, "system", "left")


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Element n // 2 of the sorted values of each group, exactly.

    Each round is one pass that counts, in every task, the values below and inside a range of the group and
    sketches those inside; the next range lies between the sketched quantiles around the wanted rank. When no
    range holds more than FEW_VALUES rows, or only one value, what is left is folded to a row per value and
    summed up. A range that missed the rank, which the counts show, is replaced by the side that holds it.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    cuts = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])

    def sketch(values: Column) -> list[Column]:
        return [F.percentile_approx(values, cuts, F.lit(16 * QUANTILES)).alias("q"), F.min(values).alias("first"), F.max(values).alias("last")]

    # Before the first round a range is the whole group.
    start = rows.groupBy(*by).agg(F.count("*").alias("inside"), *sketch(F.col("v")))
    state = start.withColumn("below", F.lit(0).cast("long")).withColumn("wanted", F.floor(F.col("inside") / 2))
    state = staged(state.withColumn("low", F.col("first")).withColumn("high", F.col("last")), "median")
    while state.where((F.col("inside") > FEW_VALUES) & (F.col("low") < F.col("high"))).head(1):
        place = (F.col("wanted") - F.col("below")) / F.col("inside") * QUANTILES
        around = [F.greatest(F.floor(place).cast("int") - 1, F.lit(0)), F.least(F.ceil(place).cast("int") + 1, F.lit(QUANTILES))]
        done = (F.col("inside") <= FEW_VALUES) | (F.col("low") == F.col("high"))
        # Without a sketch, after a miss, the range itself is sketched.
        low = F.when(done, F.col("low")).otherwise(F.coalesce(F.get("q", around[0]), F.col("low")))
        high = F.when(done, F.col("high")).otherwise(F.coalesce(F.get("q", around[1]), F.col("high")))
        ranges = state.select(*by, "wanted", low.alias("low"), high.alias("high"), F.col("low").alias("from"), F.col("high").alias("to"))
        near = rows.join(settled_if_small(ranges), list(by)).where(F.col("v") <= F.col("to"))
        within = F.col("v").between(F.col("low"), F.col("high"))
        counted = near.groupBy(*by, "wanted", "low", "high", "from", "to").agg(
            F.count_if(F.col("v") < F.col("low")).alias("below"),
            F.count_if(within).alias("inside"),
            *sketch(F.when(within, F.col("v"))),
        )
        missed_low, missed_high = F.col("wanted") < F.col("below"), F.col("wanted") >= F.col("below") + F.col("inside")
        missed = missed_low | missed_high
        state = staged(
            counted.select(
                *by, "wanted", "below",
                F.when(~missed, F.col("q")).alias("q"),
                F.when(missed, F.lit(2**62)).otherwise(F.col("inside")).alias("inside"),
                F.when(missed_low, F.col("from")).when(missed_high, F.col("high")).otherwise(F.col("first")).alias("low"),
                F.when(missed_low, F.col("low")).when(missed_high, F.col("to")).otherwise(F.col("last")).alias("high"),
            ),
            "median",
        )
    near = rows.join(settled_if_small(state.select(*by, "wanted", "low", "high")), list(by)).where(F.col("v") <= F.col("high"))
    # NULL marks the rows below the range: they are only counted.
    inside = F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")
    counts = near.groupBy(*by, "wanted", inside).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*by).orderBy(F.asc_nulls_first("v")))
    reached = counts.withColumn("upto", upto).where((F.col("upto") > F.col("wanted")) & F.col("v").isNotNull())
    return reached.groupBy(*by).agg(F.min("v").alias(value))


# ---- pooling and judgments ----------------------------------------------------


def pool(rankings: DataFrame, systems: list[tuple[str, str]], k: int, key: str = "sha") -> DataFrame:
    """Union of the systems' rankings in first-seen order, cut to 2 k per query.

    `systems` lists (system, marker) in the order they are read; `found_by`
    strings the markers of the systems that returned a key together.
    """
    place, mark = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, marker) in reversed(list(enumerate(systems))):
        place = F.when(F.col("system") == name, F.lit(i)).otherwise(place)
        mark = F.when(F.col("system") == name, F.lit(marker)).otherwise(mark)
    rows = rankings.withColumn("place", place).withColumn("mark", mark).where(F.col("place").isNotNull())
    marks = F.array_sort(F.collect_set(F.struct("place", "mark")))
    seen = rows.groupBy("query_id", key).agg(F.min(F.struct("place", "rank")).alias("first_seen"), marks.alias("marks"))
    pooled = seen.withColumn("found_by", F.array_join(F.col("marks.mark"), ""))
    return top_k(pooled, 2 * k, ["query_id"], ["first_seen", key]).select("query_id", "rank", key, "found_by")


def selected_numbers(raw: Column, n: Column) -> Column:
    """'1 3-5, 7' -> sorted distinct numbers inside 1..n; other tokens do not count."""

    def number(text: Column, fallback: Column) -> Column:
        # More digits than a decimal holds is beyond any list.
        return F.least(F.coalesce(text.try_cast("decimal(38,0)"), fallback), fallback).cast("int")

    def numbers(token: Column) -> Column:
        low = F.greatest(number(F.regexp_extract(token, r"^(\d+)", 1), n + 1), F.lit(1))
        high = number(F.regexp_extract(token, r"(\d+)\z", 1), n + 1)
        high = F.least(high, n)
        listed = token.rlike(r"^\d+(-\d+)?\z") & (low <= high)
        return F.when(listed, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    tokens = F.split(F.translate(F.coalesce(raw, F.lit("")), ",", " "), r"(?U)\s+")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, numbers))))


def judge(pooled: DataFrame, answers: DataFrame, key: str = "sha") -> DataFrame:
    """Judgments of answered pools: (query_id, key, rank), in pool order.

    `answers` has (query_id, raw): numbers as above, `a` for all, `u` or
    nothing for none.
    """
    sizes = pooled.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    raw = F.trim(F.coalesce("raw", F.lit("")))
    picked = F.when(raw == "a", F.sequence(F.lit(1), F.col("n"))).otherwise(selected_numbers(raw, F.col("n")))
    numbers = answers.join(sizes, "query_id").select("query_id", F.explode(picked).alias("number"))
    return (
        pooled.withColumn("number", F.col("rank") + 1)
        .join(numbers, ["query_id", "number"])
        .select("query_id", key, "rank")
    )


def replace_judgments(qrels: DataFrame, answers: DataFrame, judged: DataFrame, key: str = "sha") -> DataFrame:
    """`qrels` in which every answered query has exactly its new judgments."""
    kept = qrels.select("query_id", key).join(answers.select("query_id"), "query_id", "left_anti")
    return kept.unionByName(judged.select("query_id", key))
