"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a min-aggregate and a join; the number of rounds grows with the logarithm of
the longest path. Edges stay distributed; the driver sees one row of sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node links its larger neighbours to the least node it sees; small: its smaller ones."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long), any order, repeats and loops allowed -> (node, root), root the least
    node of the component; nodes without an edge to another node don't appear. No edges: no rows.
    Raises if the rounds don't settle."""
    e = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    before = _state(e)
    if before[0]:
        for _ in range(max_rounds):
            e = cut(_star(_star(e, True), False))
            now = _state(e)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
