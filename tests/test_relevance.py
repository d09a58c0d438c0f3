import math
import random

import pytest
from pyspark.sql import functions as F

from patchlake.operators import relevance
from patchlake.sources import files


def test_metrics(spark):
    rng = random.Random(2)
    rankings, qrels = {}, {}
    for system in "AB":
        for query_id in range(6):
            rankings[system, query_id] = [f"d{i}" for i in rng.sample(range(20), rng.choice([0, 3, 15]))]
    for query_id in range(5):
        qrels[query_id] = {f"d{i}" for i in rng.sample(range(20), query_id * 3 + 1)}
    flat = [(s, q, rank, sha) for (s, q), found in rankings.items() for rank, sha in enumerate(found)]
    df = spark.createDataFrame(flat, "system string, query_id int, rank int, sha string")
    judged = spark.createDataFrame([(q, s) for q, found in qrels.items() for s in found], "query_id int, sha string")
    runs = spark.createDataFrame([(s, q, float(q)) for s, q in rankings], "system string, query_id int, ms double")
    got = {(r.system, r.query_id): (r.recall, r.ndcg) for r in relevance.query_metrics(df, judged, 10, runs).collect()}
    assert set(got) == {(s, q) for s, q in rankings if q in qrels}
    for (system, query_id), (recall, ndcg) in got.items():
        head, relevant = rankings[system, query_id][:10], qrels[query_id]
        gains = [1 / math.log2(i + 2) for i in range(10)]
        ideal = sum(gains[: min(len(relevant), 10)])
        assert recall == pytest.approx(len(set(head) & relevant) / len(relevant))
        assert ndcg == pytest.approx(sum(g for g, s in zip(gains, head) if s in relevant) / ideal)
    # Without `runs`, every list that has rows counts.
    listed = relevance.query_metrics(df, judged, 10)
    assert listed.count() == len({(s, q) for s, q in got if rankings[s, q]})
    report = {r.system: r for r in relevance.system_metrics(relevance.query_metrics(df, judged, 10, runs)).collect()}
    assert report["A"].n_queries == 5 and report["A"].mean_ms == 2.0 and report["A"].p50_ms == 2.0
    assert report["B"].mean_recall == pytest.approx(sum(got["B", q][0] for q in range(5)) / 5)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 99, 100, 101, 5000])
def test_upper_median(spark, n):
    rng = random.Random(n)
    values = [float(rng.choice([1, 1, 1, rng.randint(0, n)])) for _ in range(n)]
    rows = [("hot", v) for v in values] + [("one", 7.0), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.v for r in relevance.upper_median(df, "v", "g").collect()}
    assert got == {"hot": sorted(values)[n // 2], "one": 7.0}


@pytest.mark.parametrize("shape", ["even", "skewed", "hot", "negative"])
def test_upper_median_in_rounds(spark, monkeypatch, shape):
    """Many rounds over small ranges: extremes, a value that half of the rows hold, groups of different sizes."""
    monkeypatch.setattr(relevance, "FEW_VALUES", 5)
    monkeypatch.setattr(relevance, "QUANTILES", 8)
    rng = random.Random(shape)
    draw = {
        "even": lambda: rng.random(),
        "skewed": lambda: math.exp(rng.uniform(-600, 600)),
        "hot": lambda: 1.0 if rng.random() < 0.6 else rng.random() * 2,
        "negative": lambda: -math.exp(rng.gauss(0, 9)),
    }[shape]
    values = {f"g{n}": [draw() for _ in range(n)] for n in (1, 2, 7, 300, 3001)}
    df = spark.createDataFrame([(g, v) for g, found in values.items() for v in found], "g string, v double")
    got = {r.g: r.v for r in relevance.upper_median(df, "v", "g").collect()}
    assert got == {g: sorted(found)[len(found) // 2] for g, found in values.items()}


def test_pool(spark):
    rows = [("q", 0, i, s) for i, s in enumerate("cab")] + [("p", 0, i, s) for i, s in enumerate("xa")] + [("z", 0, 0, "n")]
    df = spark.createDataFrame(rows, "system string, query_id int, rank int, sha string")
    got = relevance.pool(df, [("p", "P"), ("q", "Q")], 2).orderBy("rank").collect()
    assert [(r.sha, r.found_by) for r in got] == [("x", "P"), ("a", "PQ"), ("c", "Q"), ("b", "Q")]


SELECTIONS = {
    "1 3-5, 7": [1, 3, 4, 5, 7], "9-2": [], "a": [], "": [], "-3": [], "2,2 2": [2], "0 11 10": [10], "3-": [], "1-2-3": [],
    "8-99999999999999999999999999999999999999999999": [8, 9, 10], "99999999999999999999999999999999999999999999": [],
    "0-2": [1, 2], "x 4": [4], " 5 ": [5],
}


def test_selections(spark):
    df = spark.createDataFrame([(s,) for s in SELECTIONS], "raw string").withColumn("n", F.lit(10))
    got = {r.raw: r.picked for r in df.select("raw", relevance.selected_numbers(F.col("raw"), F.col("n")).alias("picked")).collect()}
    assert got == SELECTIONS


def test_judging(spark):
    pooled = spark.createDataFrame(
        [(q, rank, f"{q}{s}") for q in range(5) for rank, s in enumerate("abc")], "query_id int, rank int, sha string"
    )
    answers = spark.createDataFrame([(0, "a"), (1, "3 1"), (2, "u"), (3, ""), (9, "a")], "query_id int, raw string")
    judged = relevance.judge(pooled, answers)
    assert {(r.query_id, r.sha) for r in judged.collect()} == {(0, "0a"), (0, "0b"), (0, "0c"), (1, "1a"), (1, "1c")}
    old = spark.createDataFrame([(1, "1b"), (3, "3a"), (4, "4a")], "query_id int, sha string")
    now = relevance.replace_judgments(old, answers, judged)
    assert {(r.query_id, r.sha) for r in now.collect()} == {(0, "0a"), (0, "0b"), (0, "0c"), (1, "1a"), (1, "1c"), (4, "4a")}


def test_query_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(
        '{"query": "a", "class": "nl", "module": null, "relevant": ["s1", "s2", "s1"]}\n{"query": "b", "tag": "FIX", "relevant": []}\n{"query": "a", "tag": "FIX"}\n'
    )
    queries = files.read_queries(spark, str(tmp_path / "q.json"))
    qrels = files.qrels_of(queries)
    assert queries.select("query_id").distinct().count() == 3
    assert sorted(r.sha for r in qrels.collect()) == ["s1", "s2"]
    assert files.labeled(queries, qrels).count() == 1 and files.unlabeled(queries, qrels).count() == 2
