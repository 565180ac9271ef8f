"""The registered queries of this subpackage, each over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolith.llm.common import fold, table
from geolith.llm.embedding_dedup import embedding_dedup
from geolith.llm.license_scan import license_scan
from geolith.llm.mix import mix_table
from geolith.llm.oracle import ORACLE_SQL
from geolith.llm.pack import pack
from geolith.llm.quality_model import quality_scores
from geolith.llm.quality_rules import quality_rules
from geolith.llm.simhash import simhash
from geolith.llm.suffix import suffix_dedup
from geolith.llm.toxicity import toxicity_scores
from geolith.llm.url_filter import url_filter


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_quality_classifier, op3_best_fit_packing, op4_simhash, op5_url_filter, op6_embedding_dedup, op7_source_mix, op8_license_scan, op9_suffix_dedup, op10_toxicity)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
