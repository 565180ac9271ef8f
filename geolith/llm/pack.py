"""Best-fit packing of documents into sequences, under conflicts.

Documents are cut into pieces of at most `capacity` words. Two pieces conflict if they have the same source
or belong to the same cluster of duplicates; what conflicts never shares a bin. Pieces are dealt to
shards of bounded size by a hash; within a shard, in order of decreasing size, each piece goes to
the tightest bin that takes it. Bins are kept by residual, and by the bitmaps of their sources
and clusters; the search goes from residual to the next until a compatible bin is found.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import WORD, cut, session

CAPACITY, SHARD = 2048, 20000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in the bin) of each piece, in the given order. Sources and clusters are anything
    hashable; None conflicts with nothing."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    levels: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
    occupied = 0  # bit r: some bin has residual r
    blocked: dict[int, int] = {}  # source bit -> residuals at which every bin has that source
    n_bins, out = 0, []
    for size, s, c in zip(sizes, sources, clusters):
        sb, cb = source_bit.get(s, 0), cluster_bit.get(c, 0)
        free = (occupied & ~blocked.get(sb, 0)) >> size
        level, chosen = size, None
        while free:
            skip = (free & -free).bit_length() - 1
            level += skip
            free >>= skip
            all_have = True
            for masks in levels[level]:
                if not masks[0] & sb:
                    all_have = False
                    if not masks[1] & cb:
                        chosen = masks
                        break
            if chosen is not None:
                break
            if all_have and sb:
                blocked[sb] = blocked.get(sb, 0) | 1 << level
            level += 1
            free >>= 1
        if chosen is None:
            b, level, masks = n_bins, capacity, (0, 0)
            n_bins += 1
        else:
            masks, group = chosen, levels[level][chosen]
            b = group.pop()
            if not group:
                del levels[level][masks]
                if not levels[level]:
                    occupied &= ~(1 << level)
        out.append((b, capacity - level))
        rest, masks = level - size, (masks[0] | sb, masks[1] | cb)
        levels[rest].setdefault(masks, []).append(b)
        occupied |= 1 << rest
        for other, at in blocked.items():
            if not masks[0] & other:
                blocked[other] = at & ~(1 << rest)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, piece, start (first word), n_words, bin_id, bin_offset: one row for
    each piece of each row of docs, pieces of `capacity` words and the rest.

    `cluster` names a column with the cluster of duplicates; without it, texts with the same words are
    one. Documents without words (or null text) have one piece of no words and no bin. A null source
    conflicts with nothing. Pieces of one document are duplicates of each other, so a bin has one at
    most. Repeated rows are packed one by one. An empty table gives no rows.
    """
    session(docs.sparkSession)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.xxhash64(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))) if cluster is None else F.xxhash64(F.col(cluster))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), words.alias("words"), F.when(F.col("source").isNotNull(), F.xxhash64("source")).alias("source"), same.alias("cluster"))
    last = F.greatest(F.ceil(F.col("words") / capacity).cast("long") - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.select("doc_id", "th", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).alias("n_words"), "source", "cluster")
    # Repeated rows are counted and numbered, so that they too are spread over the shards.
    pieces = cut(pieces.groupBy(*pieces.columns).agg(F.count("*").alias("copies")))
    shards = max(1, -(-(pieces.agg(F.sum("copies")).first()[0] or 0) // shard))
    pieces = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", "piece", "copy"), F.lit(shards)))

    order = [("n_words", "descending"), ("th", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        sizes = t["n_words"].to_pylist()
        put = t.num_rows - sizes.count(0)  # pieces without words come last
        at = best_fit(sizes[:put], t["source"].to_pylist()[:put], t["cluster"].to_pylist()[:put], capacity)
        name, none = t["shard"][0].as_py(), [None] * (t.num_rows - put)
        out = t.select(["doc_id", "piece", "start", "n_words"])
        out = out.append_column("bin_id", pa.array([f"{name}-{b}" for b, _ in at] + none, pa.string()))
        return out.append_column("bin_offset", pa.array([o for _, o in at] + none, pa.int64()))

    return pieces.groupBy("shard").applyInArrow(run, "doc_id long, piece long, start long, n_words long, bin_id string, bin_offset long")
