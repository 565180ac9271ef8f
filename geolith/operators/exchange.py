"""What tiles send each other, ownership of simplices, and global numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broadcast_extremes(extremes: DataFrame, tile: str = "cell") -> DataFrame:
    """For each tile, how many extreme points are its own and how many come from the others."""
    total = extremes.agg(F.count("*").alias("total"))
    return extremes.groupBy(tile).agg(F.count("*").alias("n_own")).withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select(tile, "n_own", (F.col("total") - F.col("n_own")).alias("n_foreign"))


def send_once(outbox: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Messages (dst, keys) that were not sent to the same tile before, each once."""
    return outbox.select("dst", *keys).distinct().join(sent.select("dst", *keys), ["dst", *keys], "left_anti")


def touched(tiles: DataFrame, messages: DataFrame, tile: str = "cell") -> DataFrame:
    """Tiles with a flag whether any message is for them: only those run again."""
    to = messages.select(F.col("dst").alias(tile)).distinct()
    active = tiles.join(to, tile, "left_semi").withColumn("touched", F.lit(True))
    return active.unionByName(tiles.join(to, tile, "left_anti").withColumn("touched", F.lit(False)))


def exclusive_offsets(counts: DataFrame, columns: list[str], tile: str = "cell", buckets: int = 64) -> DataFrame:
    """For each tile the sums of the columns over all tiles before it, 0 for the first.

    Ids are split into `buckets` ranges; sums run within each range, and the ranges' totals, one row each, are
    added: no task sees all tiles.
    """
    low = counts.agg(F.min(tile).alias("lo"), F.max(tile).alias("hi")).withColumn("one", F.lit(1))
    at = F.floor((F.col(tile) - F.col("lo")) * buckets / (F.col("hi") - F.col("lo") + 1)).cast("int")
    rows = counts.withColumn("one", F.lit(1)).join(F.broadcast(low), "one").withColumn("bucket", at).drop("one", "lo", "hi")
    before = Window.partitionBy("bucket").orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("bucket").agg(*[F.sum(c).alias(f"t_{c}") for c in columns])
    all_before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("bucket", *[F.coalesce(F.sum(f"t_{c}").over(all_before), F.lit(0)).alias(f"b_{c}") for c in columns])
    out = rows.join(F.broadcast(base), "bucket")
    return out.select(tile, *columns, *[(F.col(f"b_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).cast("long").alias(f"{c}_offset") for c in columns])


def global_ids(rows: DataFrame, offsets: DataFrame, offset: str, order: list[str], tile: str = "cell") -> DataFrame:
    """Rows with gid: their tile's offset plus their rank within the tile, 0 for the first by `order`."""
    rank = F.row_number().over(Window.partitionBy(tile).orderBy(*order)) - 1
    return rows.withColumn("lid", rank.cast("long")).join(offsets.select(tile, offset), tile).withColumn("gid", F.col("lid") + F.col(offset)).drop(offset)


def adjacency(cells: DataFrame, neighbours: Column) -> DataFrame:
    """cells (cell, ...) -> pairs (a, b) of cells that both exist and are neighbours, in both directions."""
    out = cells.select(F.col("cell").alias("a"), F.explode(neighbours).alias("b"))
    return out.join(cells.select(F.col("cell").alias("b")), "b", "left_semi").select("a", "b")


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without their reverse, with multiplicity: none if the adjacency is symmetric."""
    return edges.select("a", "b").exceptAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def main_tile(owners: Column) -> Column:
    """The tile that a simplex belongs to: the least owner of its vertices."""
    return F.array_min(owners)


def kind(owners: Column, tile: Column) -> Column:
    """local if all vertices belong to the tile, foreign if none does, mixed otherwise."""
    own = F.size(F.filter(owners, lambda o: o == tile))
    return F.when(own == F.size(owners), "local").when(own == 0, "foreign").otherwise("mixed")


def facet_main_tile(owners: Column, cell_a: Column, cell_b: Column) -> Column:
    """The least owner of a facet's vertices of which both adjacent cells have a vertex."""
    return F.array_min(F.array_intersect(F.array_intersect(owners, cell_a), cell_b))


def overwrite_from_main(rows: DataFrame, key: str, tile: str, main: str, values: list[str]) -> DataFrame:
    """Each copy of a shared cell takes the values of the copy in its main tile, if there is one."""
    w = Window.partitionBy(key)
    return rows.select(*[c for c in rows.columns if c not in values], *[F.coalesce(F.max(F.when(F.col(tile) == F.col(main), F.col(v))).over(w), F.col(v)).alias(v) for v in values])
