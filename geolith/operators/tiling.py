"""Grid cells, octree leaves and tile ids: how points are dealt to tiles of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.schema import Box


def cell_coordinates(box: Box, side: int) -> dict[str, Column]:
    """Cell coordinate on each axis: the upper bound of the box wraps to cell 0."""
    return {f"i{a}": F.pmod(F.floor((F.col(a) - lo) * side / (hi - lo)), F.lit(side)).cast("long") for a, lo, hi in zip(box.axes, box.low, box.high)}


def cell_id(side: int, axes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """One number for a cell, the first axis most significant."""
    return reduce(lambda acc, a: acc * side + F.col(f"i{a}"), axes, F.lit(0).cast("long"))


def inside(box: Box) -> Column:
    """Bounds belong to the box."""
    return reduce(lambda a, b: a & b, (F.col(a).between(lo, hi) for a, lo, hi in zip(box.axes, box.low, box.high)))


def tile_points(points: DataFrame, box: Box, side: int, min_points: int = 1, file: str | None = None) -> DataFrame:
    """Points inside the box with their cell; a file's share of a cell that has under min_points points is dropped."""
    out = points.where(inside(box)).withColumns(cell_coordinates(box, side)).withColumn("cell", cell_id(side, box.axes))
    if min_points <= 1:
        return out
    keys = [file, "cell"] if file else ["cell"]
    full = out.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_points).drop("__n")
    return out.join(full, keys, "left_semi")


def cell_counts(tiled: DataFrame) -> DataFrame:
    """cell, its coordinates, n."""
    at = [c for c in ("ix", "iy", "iz") if c in tiled.columns]
    return tiled.groupBy("cell", *at).agg(F.count("*").alias("n"))


def fullest(counts: DataFrame, limit: int) -> DataFrame:
    """One row: points in all, points in the fullest cell, and whether that is over the limit."""
    return counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"), (F.max("n") > limit).alias("over"))


def nodes_up_to(level: int, dim: int = 3) -> int:
    """Nodes of a full tree down to a level."""
    return ((1 << dim) ** (level + 1) - 1) // ((1 << dim) - 1)


def parent_node(node: Column, level: int, dim: int = 3) -> Column:
    """The node above a node of a level (1 or more): half its coordinates, a level up."""
    side, half = 1 << level, 1 << (level - 1)
    local = node - nodes_up_to(level - 1, dim)
    coordinates = [F.floor(local / side**k).cast("long") % side for k in range(dim)]
    above = sum((F.shiftright(c, 1) * half**k for k, c in enumerate(coordinates[1:], 1)), F.shiftright(coordinates[0], 1))
    return above + (nodes_up_to(level - 2, dim) if level > 1 else 0)


def is_ancestor(upper: Column, upper_level: int, lower: Column, lower_level: int, dim: int = 3) -> Column:
    """Whether a node is above (or is) another, whose level is at least its own."""
    for level in range(lower_level, upper_level, -1):
        lower = parent_node(lower, level, dim)
    return upper == lower


def grid_side(depth: int) -> int:
    """Cells a side for a tree of a depth, 256 at most."""
    return min(1 << depth, 256)


def octree_leaves(counts: DataFrame, depth: int, limit: int) -> DataFrame:
    """counts (cell, ix, iy, iz, n) on a grid of 2**depth cells a side -> (cell, level, node, leaf_n).

    A leaf is a cell of the last level with over `limit` points, or a node with at most `limit` points whose parent
    has more. If the whole tree has at most `limit` points, the root is the only leaf. Every counted cell is
    under one leaf.
    """
    axes = [a for a in ("x", "y", "z") if f"i{a}" in counts.columns]
    out = counts
    for level in range(depth + 1):
        at = reduce(lambda acc, a: acc * (1 << level) + F.shiftright(F.col(f"i{a}"), depth - level), reversed(axes), F.lit(0).cast("long"))
        first = nodes_up_to(level - 1, len(axes)) if level else 0
        out = out.withColumn(f"node{level}", (at + first).cast("long"))
    # Points under each node, level by level; the last level's are the cell's own.
    for level in range(depth):
        out = out.join(out.groupBy(f"node{level}").agg(F.sum("n").alias(f"n{level}")), f"node{level}")
    out = out.withColumn(f"n{depth}", F.col("n"))
    leaf = F.lit(depth)
    for level in range(depth, -1, -1):
        leaf = F.when(F.col(f"n{level}") <= limit, F.lit(level)).otherwise(leaf)
    pick = lambda prefix: F.coalesce(*[F.when(F.col("level") == k, F.col(f"{prefix}{k}")) for k in range(depth + 1)])
    return out.withColumn("level", leaf.cast("int")).select("cell", "n", F.col("level").cast("long").alias("level"), pick("node").alias("node"), pick("n").alias("leaf_n"))


def renumbered(leaves: DataFrame) -> DataFrame:
    """Leaves by falling count, then level and node: tile_id from 0. leaves: (cell, n, level, node, leaf_n)."""
    tiles = leaves.groupBy("level", "node").agg(F.first("leaf_n").alias("n_points"), F.count("*").alias("n_cells"))
    return tiles.withColumn("tile_id", F.row_number().over(Window.orderBy(F.desc("n_points"), "level", "node")).cast("long") - 1)


def remap(tiled: DataFrame, leaves: DataFrame, tiles: DataFrame) -> DataFrame:
    """Points with the tile id of the leaf over their cell."""
    ids = leaves.join(tiles, ["level", "node"]).select("cell", "tile_id")
    return tiled.join(ids, "cell")


def bounding_boxes(tiled: DataFrame, tile: str = "cell", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Box and count of each tile, and of all tiles (tile null), in one pass."""
    sides = [f(a).alias(f"{a}{n}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))]
    return tiled.rollup(tile).agg(F.count("*").alias("n"), *sides)


def extreme_points(tiled: DataFrame, keys: list[str], tile: str = "cell", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The points that attain a tile's least or greatest coordinate on an axis: at most two for each axis, the first by key if
    several do, each once."""
    row = F.struct(*axes, *keys)
    picks = []
    for a in axes:
        picks += [F.min(F.struct(F.col(a).alias("v"), *keys, row.alias("row")))["row"], F.min(F.struct((-F.col(a)).alias("v"), *keys, row.alias("row")))["row"]]
    out = tiled.groupBy(tile).agg(F.array(*picks).alias("rows"))
    return out.select(tile, F.explode(F.array_distinct("rows")).alias("r")).select(tile, *[F.col(f"r.{c}").alias(c) for c in (*keys, *axes)])


def random_tile(tiles: int, seed: int) -> Column:
    """A uniformly random tile, the same on each run for the same input partitions."""
    return F.floor(F.rand(seed) * tiles).cast("long")


def neighbour_cells(side: int, axes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """Ids of the cells that share a face with a cell (its coordinates in columns), inside the grid."""
    out = []
    for a in axes:
        for step in (-1, 1):
            moved = reduce(lambda acc, b: acc * side + (F.col(f"i{b}") + (step if b == a else 0)), axes, F.lit(0).cast("long"))
            out.append(F.when((F.col(f"i{a}") + step).between(0, side - 1), moved))
    return F.array_compact(F.array(*out))
