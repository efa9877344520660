"""A training corpus from `documents`: good documents, without copies and near copies, mixed by source, packed.

Each stage takes what its predecessor kept and returns the columns of documents, but for the last, which returns pieces of
documents with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import exact_dedup, mixing, packing, quality, simhash
from keelson.llm.common import documents, remove_path, shared_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, whole."""
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs, carry=("source",))


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("mixing", mixed), ("packing", packed)]

#: Votes among latent vectors and 64-bit XXH64 fingerprints aren't expressible; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what stands between two of them is written to the shared folder and goes when the next has read it."""
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        out = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if path:
            remove_path(spark, path)
        docs, path = spark.read.parquet(out), out
    made = STAGES[-1][1](spark, docs, sf_dir)  # holds its pieces, so its input may go
    remove_path(spark, path)
    return made
