"""From raw documents to encoded training text: five stages, each one operator over all that its predecessor kept.

In every stage null and empty texts, repeated rows, ties, very long texts and columns beside those of documents are
treated as the stage's operator defines it; an empty table stays empty. The first four return the columns that they got.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanternfish.llm import bpe, common, mixing, neardup, quality, rule_classifier


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule classifier does not reject; a null text is scored as the empty one, repeated rows alike."""
    return rule_classifier.classifier_filter(docs, common.table(spark, sf_dir, "labels"))


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules do not reject; texts of fewer than 20 words go, null ones too."""
    return quality.quality_filter(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id; repeated rows are one class, as are null texts."""
    return neardup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each epoch; documents without words go, a null source is its own."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every text, and of the text decoded from them, with all columns but the text."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", judge), ("near_dedup", deduplicate), ("source_mix", mix), ("bpe_round_trip", encode)]

#: Fitted models, signatures and random draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder, and removed once it was read."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            common.remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    out = common.checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    common.remove(spark, folder)
    return out
