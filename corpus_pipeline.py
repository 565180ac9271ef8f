"""Quality rules, near-duplicates, repeated passages, source mixing and packing, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolith.llm.common import cut
from geolith.llm.mix import mixed
from geolith.llm.pack import pack
from geolith.llm.quality_rules import passing
from geolith.llm.shingles import keep_one
from geolith.llm.suffix import remove_repeats


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return passing(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, the one with the least id."""
    return keep_one(docs)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a repeated passage are cut from the texts; all documents stay."""
    return remove_repeats(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target needs: not at all, or up to three times."""
    return mixed(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the bins they are in."""
    return pack(docs)


STAGES = [
    ("quality rules", _quality),
    ("simhash near-dedup", _near_duplicates),
    ("suffix-array dedup", _repeats),
    ("source mix", _mix),
    ("best-fit packing", _pack),
]

#: Fingerprints, merged transforms and packing have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
