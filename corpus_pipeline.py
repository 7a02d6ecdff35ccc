"""From raw documents to token files: five stages, each over all that the one before kept.

toxicity          documents that score 0.7 or more go
jaccard           one document of each class of near copies stays
decontamination   documents with benchmark passages go
mixing            sources are taken up to their targets, some documents twice
tokens            token files are written and read back: one row per document in them

A null text passes every filter (it has no words) and ends as an empty document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixlake.llm import decontamination, jaccard, mixing, token_files, toxicity
from helixlake.llm.common import table
from helixlake.session import save, ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, ordered=False).select(*docs.columns)  # token files are in the order of keys


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files.token_digest(docs, token_files.default_vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Scores, classes and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
