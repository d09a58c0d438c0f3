"""The stages against brute force on a small table with odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_documents import brute_components, brute_removed

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "123", "en", "s", 3), (10_002, None, None, None, None)], docs.schema)
    one = corpus_pipeline.known_language(spark, docs.unionByName(odd), SF_DIR)
    assert one.columns == docs.columns and one.count() == docs.count()
    two = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    first = sorted(k for k, _, component in brute_components(texts, 5, 4, 5) if k == component)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == first
    three = corpus_pipeline.without_repeats(spark, docs, SF_DIR)
    kept = {k: n - gone for k, n, gone, *_ in brute_removed(texts, 100)}
    rows = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and set(rows) == {k for k, n in kept.items() if n or not dict(texts)[k]}
    assert all(len(r.text.encode()) <= kept[k] and r.n_chars == len(r.text) for k, r in rows.items())
    packed = corpus_pipeline.packed(spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.count() and packed.where("offset + length > 2048").count() == 0


def test_language_stage_rejects_other_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = [(20_000, "Это предложение на русском языке, совсем другое"), (20_001, "これは日本語の文章です。とても違います"), (20_002, "xqzv wkjh bnmt")]
    rows = spark.createDataFrame([(k, text, None, "s", len(text)) for k, text in other], docs.schema)
    kept = corpus_pipeline.known_language(spark, docs.unionByName(rows), SF_DIR).select("doc_id").collect()
    assert not {r.doc_id for r in kept} & {k for k, _ in other}
    assert len(kept) >= 0.998 * docs.where("text rlike '[a-zA-Z]'").count()


def test_rows_without_id_or_repeated(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sums.where("n <> end or n > 2048").count() == 0
