"""A training-data pipeline over `documents`: five stages, each written and read again.

Toxic documents go, documents of no recognisable language go, one document of each
near-duplicate group stays, sources are mixed to their target weights (a document that the mix
takes twice stands twice), and what is left is encoded.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlens.llm import bpe, language, mixing, simhash, toxicity
from lendlens.llm.queries import vocabulary
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A language must hold this share of a document's words.
LEAST_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is below the threshold; learns from all labels of the kept rows' ids."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.toxicity(spark, docs["text"], model) < toxicity.THRESHOLD)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters, most of whose words are of one language; without any language to learn from, all."""
    model = language.fit_language(docs)
    if not model.labels:
        return docs
    return docs.where(language.language(spark, docs["text"], model)["score"] >= LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, 0 to 3."""
    return mixing.mixed(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids and the number of tokens of every row."""
    rows = docs.select("doc_id", "source", bpe.token_ids(spark, docs["text"], vocabulary()).alias("ids"))
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources), ("encoding", encode)]

# Trained models, fingerprints and merges have no SQL; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
