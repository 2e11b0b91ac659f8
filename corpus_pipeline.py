"""From raw documents to token ids: toxicity, quality, near duplicates, benchmark, tokens.

Every stage is a call of an operator of ``srcloom.llm`` on what the stage before it kept, written as Parquet
in the shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcloom.llm import bpe, decontaminate, quality, simhash, toxicity
from srcloom.llm.common import table
from srcloom.llm.queries import WORD_BPE, bpe_digests
from srcloom.session import written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject_poor(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Document ids with counts and digests of their token ids and of the decoded text."""
    vocabulary = bpe.read_vocabulary(bpe.tokenizer_path(WORD_BPE))
    encoded = bpe.with_ids(docs, vocabulary, ["doc_id"])
    return bpe_digests(bpe.with_decoded(encoded, vocabulary, ["doc_id", "ids"]))


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good_quality),
    ("near duplicates", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("tokens", tokens),
]

# Trained classifiers, fingerprints and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
