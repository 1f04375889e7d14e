"""Corpus pipeline: quality rules, quality classifier, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns packed pieces. A document is named by
doc_id: rows that repeat an id stay or go together (it stays if one of its rows is kept).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendtrace.llm import convnet, oddsketch, outliers, packing
from spendtrace.llm.filtering import kept_only
from spendtrace.llm.staging import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: null and empty texts have too few words and go."""
    return kept_only(docs, outliers.quality_verdicts(docs), "rejected-rules")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more, null and empty texts by the net's constant; without usable labels all stay."""
    # Learned from the whole table: the stages before leave hardly any label 0 to learn from.
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = convnet.train_classifier(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdicts = convnet.quality_scores(docs, net).select("doc_id", F.expr("predicted = 1").alias("kept"))
    return kept_only(docs, verdicts, "rejected-classifier")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies; null and empty texts link with nothing and stay."""
    return kept_only(docs, oddsketch.near_duplicates(docs), "rejected-copies")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents; null and empty texts are the closing id alone."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
