"""A corpus through five of the text operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm import bpe, decontamination, ngram_join, secrets, toxicity
from tidelane.llm.common import durable, table
from tidelane.llm.queries import vocabulary


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five words a shingle, Jaccard of 0.8 or more."""
    return ngram_join.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and hashes of the documents' tokens."""
    return bpe.bpe(docs, vocabulary())


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_join", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("secret_scan", secrets_masked),
    ("bpe", tokens),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
