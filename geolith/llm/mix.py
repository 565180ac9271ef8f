"""Mixing sources to target weights: a subset-sum fit of each source's word budget.

Each source's target is its weighted share of all words, at most `most` times what it has. A
target is whole passes over the source plus a rest. For the rest, documents are counted by
exact length; a proportional, seeded fill takes most of it, and a bounded-knapsack dynamic program
over the lengths left fits what remains. Documents of a length are then picked by seeded tickets.
"""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.llm.common import WORD, cut, session

WEIGHTS = (1, 2, 3)
#: Budget that is left to the dynamic program, in words, where documents are shorter; else it is less than the longest one left.
REMAINING = 1 << 16
#: Rows that are broadcast at most.
SMALL = 200_000


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> dict:
    """source -> words -> source -> target. Sources by code point, null last, weigh `weights` in turn and
    share all words; what exceeds `most` times a source is shared again by weight until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = Fraction(sum(sizes.values())), {}, list(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > most * sizes[s]]
        for s in over or free:
            out[s] = Fraction(most * sizes[s]) if over else weight[s] * share
            left -= out[s]
        free = [s for s in free if s not in out]
    return {s: float(t) for s, t in out.items()}


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their words add up to `budget`, or as near below
    it as the lengths allow. 0 <= budget <= the words there are."""
    total = int((lengths * counts).sum())
    if not total or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    for k in order:
        if left <= REMAINING:
            break
        if 0 < lengths[k] <= left and take[k] < counts[k]:
            take[k] += 1
            left -= int(lengths[k])
    # Sums that the lengths seen so far reach, as bits; stages hold what each batch of one length added.
    reach, stages, full = 1, [], (1 << (left + 1)) - 1
    for k in order:
        if reach >> left & 1:
            break
        n, step = int(min(counts[k] - take[k], left // lengths[k])) if lengths[k] else 0, 1
        while n > 0:
            batch = min(step, n)
            stages.append((k, batch, reach))
            reach |= reach << batch * int(lengths[k]) & full
            n, step = n - batch, 2 * step
    at = reach.bit_length() - 1
    for k, batch, before in reversed(stages):
        if not before >> at & 1:
            take[k] += batch
            at -= batch * int(lengths[k])
    return take


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """docs (doc_id, text, source, ...) -> (row: struct of all columns, size, source_size, target, times:
    how often the mix takes the row, 0 to `most`), one row per row of docs.

    A size is the number of words (null text: 0). Rows with null source are a source of their own, the last.
    Rows of the same id and text share a ticket: where the last document that is taken of a length is one of them, as many of them
    are taken as are needed, whichever they are. Long texts count as a whole. Columns of docs may have any names. Empty texts are taken in proportion and change nothing. Only one row
    for each source reaches the driver: the targets are a parameter table of that size. An
    empty table gives no rows.
    """
    spark = session(docs.sparkSession)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    ticket = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    sized = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), words.alias("size"), ticket.alias("ticket"))
    base = cut(sized.drop("row"))
    lengths = cut(base.groupBy("source", "size").agg(F.count("*").alias("count")))
    totals = {r[0]: r[1] for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count"))).collect()}
    goal = targets(totals, weights, most)
    table = spark.createDataFrame([(s, totals[s], goal[s]) for s in totals], "s string, source_size long, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable")
        have, want = int(pdf["source_size"].iloc[0]), round(pdf["target"].iloc[0])
        passes = min(want // have, most) if have else 0
        take = fit(pdf["size"].to_numpy(), pdf["count"].to_numpy(), want - passes * have if passes < most else 0, seed)
        return pdf.assign(passes=passes, take=take)

    joined = lengths.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    schema = "source string, size long, count long, source_size long, target double, passes long, take long"
    quota = cut(joined.groupBy("source").applyInPandas(plan, schema))
    # The ticket up to which documents of a length are taken: first which of 4096 ranges it is in, then where.
    part = quota.where("take > 0 and take < count").select(F.col("source").alias("s"), F.col("size").alias("z"), "take")
    of_length = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    rows = base.join(part, of_length).select("s", "z", "take", F.shiftright("ticket", 52).alias("bin"), "ticket")
    bins = rows.groupBy("s", "z", "take", "bin").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("s", "z").orderBy("bin")))
    edge = bins.where("upto >= take and upto - n < take").select(F.col("s").alias("es"), F.col("z").alias("ez"), F.col("bin").alias("eb"), (F.col("take") - F.col("upto") + F.col("n")).alias("need"))
    inner = rows.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.col("z") == F.col("ez")) & (F.col("bin") == F.col("eb")))
    inner = inner.groupBy("s", "z", "need", "bin", "ticket").agg(F.count("*").alias("n"))
    inner = inner.withColumn("rank", F.sum("n").over(Window.partitionBy("s", "z").orderBy("ticket")))
    whole = F.col("rank") <= F.col("need")
    below = F.when(F.max("bin") > -2048, F.shiftleft(F.max("bin"), 52) - 1)
    some = F.max("need") - F.coalesce(F.max(F.when(whole, F.col("rank"))), F.lit(0))
    last = inner.groupBy("s", "z").agg(F.coalesce(F.max(F.when(whole, F.col("ticket"))), below).alias("last"), F.min(F.when(~whole, F.col("ticket"))).alias("next"), some.alias("some"))
    last = last.select(F.col("s").alias("ls"), F.col("z").alias("lz"), "last", F.when(F.col("some") > 0, F.col("next")).alias("split"), "some")
    quota = quota.join(last, F.col("source").eqNullSafe(F.col("ls")) & (F.col("size") == F.col("lz")), "left")
    upto = F.when(F.col("take") >= F.col("count"), F.lit((1 << 63) - 1)).when(F.col("take") > 0, F.col("last"))
    quota = cut(quota.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "passes", upto.alias("last"), "split", "some"))
    # One row for each source and length: it goes to the rows as long as it is small, so that no text is shuffled.
    n, parted = quota.agg(F.count("*"), F.count("split")).first()
    out = sized.join(F.broadcast(quota) if n <= SMALL else quota, of_length)
    once = out.withColumn("more", F.coalesce(F.col("ticket") <= F.col("last"), F.lit(False)))
    if parted:
        split = F.col("ticket").eqNullSafe(F.col("split"))
        once = once.where(~split).union(_some(out.where(split)))
    return once.select("row", "size", "source_size", "target", (F.col("passes") + F.col("more").cast("long")).alias("times"))


def _some(rows: DataFrame) -> DataFrame:
    """rows that share their source's and length's one ticket to be parted (s, z, some, ...) -> the same with more: true for `some` of each. They are
    numbered by where they lie: only the partition in which the last one is taken is ranked, so no task gets them all."""
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    own = rows.select("s", "z", "some", F.shiftright("at", 33).alias("p"), "at")
    parts = own.groupBy("s", "z", "some", "p").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("s", "z").orderBy("p")))
    edge = parts.where("upto >= some and upto - n < some").select(F.col("s").alias("es"), F.col("z").alias("ez"), F.col("p").alias("ep"), (F.col("some") - F.col("upto") + F.col("n")).alias("need"))
    inner = own.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.col("z") == F.col("ez")) & (F.col("p") == F.col("ep")))
    inner = inner.withColumn("rank", F.row_number().over(Window.partitionBy("s", "z").orderBy("at"))).where("rank = need")
    end = cut(inner.select("es", "ez", F.col("at").alias("end")))
    found = rows.join(F.broadcast(end) if end.count() <= SMALL else end, F.col("s").eqNullSafe(F.col("es")) & (F.col("z") == F.col("ez")))
    return found.withColumn("more", F.col("at") <= F.col("end")).drop("at", "es", "ez", "end")


def mix_table(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted): one row per row of docs."""
    out = mix(docs.select("doc_id", "text", "source"), seed)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    out = mix(docs, seed).where("times > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
