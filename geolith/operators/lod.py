"""Levels of detail: merging and simplifying tile meshes up a tree, earth coordinates, and relative transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clustered_faces(faces: DataFrame, cell: float, node: str = "node") -> DataFrame:
    """faces (node, corners: array of structs x, y, z) with corners moved to the mean of their grid cell's; faces that fall together go.

    Vertex clustering: it bounds the number of faces by the number of grid cells; it is not a quadric collapse.
    """
    each = faces.withColumn("face", F.xxhash64("corners")).select(node, "face", F.posexplode("corners").alias("k", "p"))
    keyed = each.withColumn("g", F.struct(*[F.floor(F.col(f"p.{a}") / cell).alias(a) for a in "xyz"]))
    means = keyed.groupBy(node, "g").agg(F.struct(*[F.avg(f"p.{a}").alias(a) for a in "xyz"]).alias("q"))
    moved = keyed.join(means, [node, "g"]).groupBy(node, "face").agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("c"))
    out = moved.select(node, F.col("c.q").alias("corners"))
    return out.where(F.size(F.array_distinct("corners")) == 3).dropDuplicates([node, "corners"])


def merged_levels(faces: DataFrame, depth: int, cell: float, target: int = 100_000) -> list[DataFrame]:
    """faces (code<k> for k = 1..depth, corners) -> for each level from the deepest up: (node, corners), a node having its children's faces.

    Nodes above the deepest level with over `target` faces are clustered, with cells doubling up the tree.
    """
    out, now = [], faces.select(F.col(f"code{depth}").alias("node"), "corners")
    for level in range(depth, -1, -1):
        if level < depth:
            now = now.withColumn("node", F.shiftright("node", 3))
            big = now.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > target).select("node")
            fine = now.join(big, "node", "left_anti")
            now = fine.unionByName(clustered_faces(now.join(big, "node", "left_semi"), cell * 2 ** (depth - level - 1)))
        now = now.checkpoint()
        out.append(now)
    return out


def lambert93_to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees (RGF93, which is WGS 84 for this) of Lambert-93 metres, by the closed formulas of the conformal conic."""
    # Fixed values of the projection: GRS 80, parallels 44 and 49 north, origin 46.5 north 3 east, false origin 700 km, 6600 km.
    e = 0.0818191910428158
    n, c, xs, ys = _conic(e)
    dx, dy = x - xs, ys - y
    r = F.sqrt(dx * dx + dy * dy)
    lon = F.radians(F.lit(3.0)) + F.atan2(dx, dy) / n
    iso = -F.log(r / c) / n
    lat = 2 * F.atan(F.exp(iso)) - np.pi / 2
    for _ in range(6):
        s = e * F.sin(lat)
        lat = 2 * F.atan(F.pow((1 + s) / (1 - s), e / 2) * F.exp(iso)) - np.pi / 2
    return F.degrees(lon), F.degrees(lat)


def _conic(e: float) -> tuple[float, float, float, float]:
    a = 6378137.0
    p1, p2, p0 = np.radians(44.0), np.radians(49.0), np.radians(46.5)
    iso = lambda p: np.log(np.tan(np.pi / 4 + p / 2) * ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2))
    big = lambda p: a / np.sqrt(1 - (e * np.sin(p)) ** 2)
    n = np.log(big(p2) * np.cos(p2) / (big(p1) * np.cos(p1))) / (iso(p1) - iso(p2))
    c = big(p1) * np.cos(p1) / n * np.exp(n * iso(p1))
    return float(n), float(c), 700000.0, 6600000.0 + float(c * np.exp(-n * iso(p0)))


def geocentric(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Earth-centred metres of degrees and height on WGS 84."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    lam, phi = F.radians(lon), F.radians(lat)
    n = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + height) * F.sin(phi)


def relative_transforms(node: dict, parent: np.ndarray | None = None) -> dict:
    """A tileset node whose 'transform' entries (4 x 4 by columns) are absolute, with each relative to its parent's."""
    own = np.array(node["transform"], float).reshape(4, 4).T if "transform" in node else None
    base = np.eye(4) if parent is None else parent
    out = dict(node)
    if own is not None:
        out["transform"] = (np.linalg.inv(base) @ own).T.ravel().tolist()
    if "children" in node:
        out["children"] = [relative_transforms(c, own if own is not None else base) for c in node["children"]]
    return out


def finalised(tileset: dict) -> dict:
    return {**tileset, "root": relative_transforms(tileset["root"])}


