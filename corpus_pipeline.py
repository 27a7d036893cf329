"""A corpus made ready for training: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of `documents`: the
classifier drops documents that it predicts to be bad, near-dedup keeps one document of each
group, substring dedup removes repeated passages from the texts, the secret scan replaces what it
finds by a mark, and packing returns the pieces of the documents in their sequences. Documents
without an id or with a null text go through: each operator's docstring says how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stintwise.llm import chosen_path, neighbours, packing, repeated_windows, secrets
from stintwise.llm.queries import tokenizer_file
from stintwise.llm.text import documents
from stintwise.operators.lookup import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neighbours.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated_windows.strip(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
