"""The corpus pipeline: from ``documents`` to sharded training text. Each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontamination, mixing, near_copies, quality_rules, sharding
from vellum.llm.common import persist, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document rules and whose host stands."""
    return quality_rules.keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at a similarity of 0.8 (shingles of five words)."""
    return near_copies.keep_one_of_each(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the domains ask."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place in it."""
    return sharding.add_shards(docs)


STAGES = [("quality rules", keep_good), ("near copies", keep_one_of_each), ("decontamination", remove_leaks), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None  # fingerprints and a fitted classifier are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
