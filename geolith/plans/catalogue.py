"""The engine's own registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolith.plans import evidence, formulas, spatial
from geolith.session import prepared



def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(prepared(spark), sf_dir)

    run.__name__ = f.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _prepared(f) for k, f in (spatial.QUERIES | evidence.QUERIES | formulas.QUERIES).items()}
ORACLE_SQL: dict[str, str] = spatial.ORACLE_SQL | evidence.ORACLE_SQL | formulas.ORACLE_SQL
