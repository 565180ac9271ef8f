"""The driver's tables seen as points, sweeps, vectors and graphs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.operators import tiling
from geolith.schema import Box

BOX = Box((0.0, 0.0, 0.0), (64.0, 131072.0, 16.0))
SIDE, DEPTH, LIMIT, MIN_POINTS = 8, 3, 500, 3
KEYS = ["k1", "k2", "k3", "k4"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points: quantity, price, discount in percent."""
    t = load(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_linenumber").cast("long").alias("k4"),
        F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), F.round(F.col("l_discount") * 100).cast("double").alias("z"),
        F.col("l_returnflag").alias("flag"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long").alias("file"),
    )


def tiled(spark: SparkSession, sf_dir: str, min_points: int = 1) -> DataFrame:
    return tiling.tile_points(points(spark, sf_dir), BOX, SIDE, min_points, "file")


POINTS_SQL = """p AS (
  SELECT l_orderkey k1, l_partkey k2, l_suppkey k3, CAST(l_linenumber AS BIGINT) k4,
         CAST(l_quantity AS DOUBLE) x, CAST(l_extendedprice AS DOUBLE) y, CAST(round(l_discount * 100) AS DOUBLE) z,
         l_returnflag flag, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) file
  FROM lineitem
), t AS (
  SELECT *, (ix * 8 + iy) * 8 + iz AS cell FROM (
    SELECT *, CAST(floor(x * 8 / 64) AS BIGINT) % 8 ix, CAST(floor(y * 8 / 131072) AS BIGINT) % 8 iy, CAST(floor(z * 8 / 16) AS BIGINT) % 8 iz
    FROM p WHERE x BETWEEN 0 AND 64 AND y BETWEEN 0 AND 131072 AND z BETWEEN 0 AND 16)
)"""

CELLS_SQL = POINTS_SQL + """, c AS (SELECT cell, ix, iy, iz, count(*) n FROM t GROUP BY ALL)"""

LEAVES_SQL = CELLS_SQL + """, lv AS (
  SELECT cell, ix, iy, iz, n, n AS n3, sum(n) OVER (PARTITION BY ix // 2, iy // 2, iz // 2) n2,
         sum(n) OVER (PARTITION BY ix // 4, iy // 4, iz // 4) n1, sum(n) OVER () n0 FROM c
), lf AS (
  SELECT cell, n, CAST(level AS BIGINT) AS level,
    CAST(CASE level WHEN 0 THEN 0 WHEN 1 THEN 1 + (iz // 4 * 2 + iy // 4) * 2 + ix // 4 WHEN 2 THEN 9 + (iz // 2 * 4 + iy // 2) * 4 + ix // 2
         ELSE 73 + (iz * 8 + iy) * 8 + ix END AS BIGINT) AS node,
    CAST(CASE level WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS BIGINT) AS leaf_n
  FROM (SELECT *, CASE WHEN n0 <= 500 THEN 0 WHEN n1 <= 500 THEN 1 WHEN n2 <= 500 THEN 2 ELSE 3 END AS level FROM lv)
), tl AS (
  SELECT level, node, first(leaf_n) n_points, count(*) n_cells,
         CAST(row_number() OVER (ORDER BY first(leaf_n) DESC, level, node) AS BIGINT) - 1 AS tile_id
  FROM lf GROUP BY level, node
)"""
