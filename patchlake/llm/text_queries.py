"""Registered queries of the operators on tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from patchlake.llm import bpe, packing, token_files
from patchlake.llm.registry import register, table
from patchlake.llm.storage import new_folder

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


@register("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents; digests of the ids and of the decoded text."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0)


@register("op8_rans_token_files")
def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as range-coded files and reads them back."""
    folder = new_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), tokenizer_path(), folder, end_id=2)
    n_tokens = len(bpe.load_vocabulary(tokenizer_path()).tokens)
    return token_files.document_digests(token_files.read_pieces(spark, folder, n_tokens, digest=True))
