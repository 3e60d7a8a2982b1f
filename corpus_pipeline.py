"""From raw documents to token files in five stages: quality, near copies, benchmark leaks, mix, tokens.

Every stage reads all rows its predecessor kept and returns the columns of ``documents``
(rows it drops are gone, rows the mix repeats are there as often); the last one returns
what was read back from the token files.

Defined cases, beside those of the operators: a null or empty text passes the quality and
leak stages like any other; near copies keep rows with a null id, and one row of each
other id; the mix drops a document it takes no time, so one without words; an empty
table gives empty stages; further columns of the input are carried through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from oddsmith.llm import decontaminate, minhash, mixing, quality, tokens
from oddsmith.llm.store import stored
from oddsmith.session import prepare

#: a fitted model and tokenizer output: SQL cannot express them
ORACLE_SQL = None
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant, learnt from the labels of these documents, accepts."""
    return quality.accepted(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    prepare(spark)
    return minhash.kept_documents(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files."""
    return tokens.tokenize(prepare(spark), docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", leak_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
