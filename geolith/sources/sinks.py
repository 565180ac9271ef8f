"""Text sinks: GeoJSON features, CSV tables, JSON parameters and timings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def box_feature(xmin: Column, xmax: Column, ymin: Column, ymax: Column, tile: Column) -> Column:
    """A tile's box as a polygon."""
    ring = F.array(F.array(xmin, ymin), F.array(xmax, ymin), F.array(xmax, ymax), F.array(xmin, ymax), F.array(xmin, ymin))
    return _feature("Polygon", F.array(ring), F.struct(tile.alias("tile")))


def point_feature(x: Column, y: Column, **properties: Column) -> Column:
    return _feature("Point", F.array(x, y), F.struct(*[c.alias(n) for n, c in properties.items()]))


def simplex_feature(corners: list[tuple[Column, Column]], **properties: Column) -> Column:
    """A triangle (three corners) or a segment (two)."""
    at = [F.array(x, y) for x, y in corners]
    if len(at) == 2:
        return _feature("LineString", F.array(*at), F.struct(*[c.alias(n) for n, c in properties.items()]))
    return _feature("Polygon", F.array(F.array(*at, at[0])), F.struct(*[c.alias(n) for n, c in properties.items()]))


def merge_graph_features(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """boxes (tile, xmin, xmax, ymin, ymax), edges (src, dst) -> features: a polygon for each box, a line between the centres of each edge's."""
    centre = lambda p: ((F.col(f"{p}.xmin") + F.col(f"{p}.xmax")) / 2, (F.col(f"{p}.ymin") + F.col(f"{p}.ymax")) / 2)
    poly = boxes.select(box_feature(*[F.col(c) for c in ("xmin", "xmax", "ymin", "ymax", "tile")]).alias("value"))
    lines = edges.join(boxes.alias("s"), F.col("src") == F.col("s.tile")).join(boxes.alias("d"), F.col("dst") == F.col("d.tile"))
    return poly.unionByName(lines.select(simplex_feature([centre("s"), centre("d")], src=F.col("src"), dst=F.col("dst")).alias("value")))


def write_features(features: DataFrame, path: str) -> None:
    """One feature on each line."""
    features.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def convergence(stats: DataFrame) -> DataFrame:
    """stats (it, diff, tot) with the ratio, 0 of nothing being 0."""
    return stats.select("it", "diff", "tot", (F.col("diff") / F.when(F.col("tot") == 0, 1).otherwise(F.col("tot"))).alias("ratio"))


def stage_times(times: DataFrame, label: str = "label", seconds: str = "seconds") -> DataFrame:
    """Seconds and times run by label, digits in labels taken off."""
    return times.groupBy(F.regexp_replace(label, "[0-9]", "").alias("label")).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n"))


def params_json(params: dict[str, list[str]]) -> str:
    return json.dumps(params, indent=2, sort_keys=True)
