"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens.

Every stage takes the documents its predecessor kept. The first four return the columns of ``documents``; the last one
returns the token ids of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import decontaminate, jaccard_join, language_id, secret_ownership, trie_bpe
from tradewind.llm.common import read_table
from tradewind.llm.queries import tokenizer_file
from tradewind.session import configure, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the others carry the language that was found."""
    return language_id.accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_passages(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced by a mark; ``n_chars`` follows the text. All documents stay."""
    repository = F.concat_ws("/", "source", "lang")
    marked = secret_ownership.redact(docs, owner_col="source", repository_col=repository)
    return marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the token ``ids`` of every document."""
    return trie_bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), columns=("n_tokens", "ids"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]
# Joins by similarity and tokenization have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = read_table(configure(spark), sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
