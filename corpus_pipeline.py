"""From raw documents to sharded training data: rules, near-duplicates, decontamination, mixing, shards."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hectara.llm import decontamination, mixing, near_duplicates, quality_rules, sharding
from hectara.llm.common import table
from hectara.session import shared_dir

SHARD_BYTES = 64 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified threshold of their language go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    return near_duplicates.keep_first(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter item, go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the weights 3, 1, 2 to 150 % of all words, none more than twice."""
    return mixing.mix(docs, share=1.5, cap=2.0, weights=(3, 1, 2))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed rows with the shard of each."""
    return sharding.assign_shards(docs, SHARD_BYTES)


STAGES = [("quality rules", quality), ("near-duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Binomial bounds and sketches are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
