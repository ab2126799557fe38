"""From raw documents to training shards: five stages, each one of the operators of flowsentry.llm.

Every stage gets what the one before has kept, as a table reread from Parquet, and all but the last
return the columns of documents. The stages handle nulls, ties, repeated rows, empty tables and extra
columns as their operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsentry.llm import decontamination, mixing, quality_rules, sharding, simhash_dedup
from flowsentry.llm.frames import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or the repetition rules go."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash_dedup.keep_one(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target shares: rows are left out, repeated, or cut where a run of blocks ends."""
    return mixing.mixed_documents(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_each),
    ("decontamination", free_of_benchmarks),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Suffix arrays, fingerprints and encoders are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
