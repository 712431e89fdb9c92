"""A corpus pipeline of the operators in fleetspectra.llm, one stage after the other.

Each stage takes the documents that the one before it left and returns the columns of documents; the last
one adds where each document goes. Null and empty texts have no words and fail the quality rules; rows that repeat
are judged each, but only one of equal texts stays as a near duplicate; null ids, sources and languages are kept as
they are; extra columns come along, but one named like a result of the last stage gives way to it; empty tables stay
empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspectra.llm import decontam, mixing, rules, sharding, similar
from fleetspectra.llm.common import shared_folder

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or that the model rejects go."""
    return rules.kept_documents(docs, rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    folder = f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    placed = sharding.shard_records(docs, SHARDS, folder, carry=True)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]
# The stages train models and draw at random, which SQL can't express; tests/llm compares each stage with a plain
# computation on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are stored and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
