"""Factor graphs: tables over any number of variables in the log domain, and loopy belief propagation on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.session import written

TINY = float(np.finfo(float).tiny)


def parse_factor_graph(text: str) -> list[tuple[int, list[int], list[int], list[float]]]:
    """Text of a factor graph -> (factor id, variables, states of each, values in the log domain, the first variable running fastest).

    The text begins with the number of factors. Each factor has: '###' and its id (or nothing), the number of variables, their numbers, their states, how many
    values are given, and lines 'index value'. Values not given, and zeros, are the least positive number.
    """
    lines = [w for line in text.splitlines() if (w := line.strip()) and not (w.startswith("#") and not w.startswith("###"))]
    out, at, n_factors = [], 0, None
    if lines and not lines[0].startswith("###"):
        n_factors, at = int(lines[0]), 1
    while at < len(lines):
        fid = len(out)
        if lines[at].startswith("###"):
            fid = int(lines[at].strip("# ") or fid)
            at += 1
        n = int(lines[at])
        variables, sizes = ([int(x) for x in lines[at + k].split()] for k in (1, 2))
        if len(variables) != n or len(sizes) != n:
            raise ValueError(f"factor {fid}: {n} variables expected")
        given = int(lines[at + 3])
        values = np.full(int(np.prod(sizes)), TINY)
        for line in lines[at + 4 : at + 4 + given]:
            k, v = line.split()
            values[int(k)] = max(float(v), TINY)
        out.append((fid, variables, sizes, np.log(values).tolist()))
        at += 4 + given
    if n_factors is not None and n_factors != len(out):
        raise ValueError(f"{n_factors} factors announced, {len(out)} found")
    return out


def read_factor_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A folder of factor-graph files -> priors (id, values) from factors of one variable, factors (factor, variables, sizes, values) of the others. Logs."""

    def run(batches):
        for b in batches:
            rows = [r for text in b["value"] for r in parse_factor_graph(text)]
            yield pd.DataFrame(rows, columns=["factor", "variables", "sizes", "values"])

    every = spark.read.text(path, wholetext=True).mapInPandas(run, "factor long, variables array<long>, sizes array<int>, values array<double>")
    one = every.where("size(variables) = 1").select(F.col("variables")[0].alias("id"), "values")
    return one, every.where("size(variables) > 1")


def _log_sum(a: np.ndarray, axis: tuple[int, ...], largest: bool) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return top.squeeze(axis) if largest else (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def factor_messages(sizes: list[int], values: list[float], inbox: list[np.ndarray], largest: bool = False) -> list[np.ndarray]:
    """What a factor tells each of its variables, given what they told it: its table with the others' messages, summed (or maximised) over the others; normalised logs."""
    n = len(sizes)
    table = np.array(values, float).reshape(sizes, order="F")
    for k, m in enumerate(inbox):
        table = table + np.asarray(m, float).reshape([-1 if j == k else 1 for j in range(n)])
    out = []
    for k, m in enumerate(inbox):
        got = _log_sum(table, tuple(j for j in range(n) if j != k), largest) - np.asarray(m, float)
        out.append(got - (got.max() + np.log(np.exp(got - got.max()).sum())))
    return out


def factor_bp(priors: DataFrame, factors: DataFrame, rounds: int = 50, tolerance: float = 1e-3, largest: bool = False) -> DataFrame:
    """priors (id, values), factors (factor, variables, sizes, values), logs -> (id, belief: probabilities).

    Each round, variables tell factors the product of their prior and what the other factors told them, factors answer. It ends when no message to a variable
    moves by `tolerance` in probability, or after `rounds`. Variables without a prior are uniform; without factors they keep their prior. With `largest`, sums become
    maxima (max-product). A factor's messages are one group of as many rows as it has variables.
    """
    sizes = factors.select(F.explode(F.arrays_zip("variables", "sizes")).alias("z")).select(F.col("z.variables").alias("id"), F.col("z.sizes").alias("n")).distinct()
    every = sizes.join(priors, "id", "full")
    prior = written(every.select("id", F.coalesce("values", F.transform(F.sequence(F.lit(1), "n"), lambda _: F.lit(0.0))).alias("prior")))
    links = factors.select("factor", F.posexplode("variables").alias("k", "id"), "sizes")
    state = written(links.select("factor", "k", "id", F.transform(F.sequence(F.lit(1), F.col("sizes")[F.col("k")]), lambda _: F.lit(0.0)).alias("m"), F.lit(1.0).alias("moved")))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def sums(messages: DataFrame) -> DataFrame:
        at = messages.select("id", F.posexplode("m").alias("s", "v")).groupBy("id", "s").agg(F.sum("v").alias("v"))
        return at.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "v"))), lambda x: x["v"]).alias("total"))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        got = factor_messages(list(pdf["sizes"].iloc[0]), pdf["values"].iloc[0], [np.array(x) for x in pdf["told"]], largest)
        moved = [float(np.abs(np.exp(a) - np.exp(np.array(b) - np.logaddexp.reduce(b))).max()) for a, b in zip(got, pdf["m"])]
        return pd.DataFrame({"factor": pdf["factor"], "k": pdf["k"], "id": pdf["id"], "m": [g.tolist() for g in got], "moved": moved})

    for _ in range(rounds):
        told = state.join(sums(state), "id").join(prior, "id").select("factor", "k", "id", "m", F.zip_with(add("prior", "total"), "m", lambda x, y: x - y).alias("told"))
        state = written(told.join(factors.select("factor", "sizes", "values"), "factor").groupBy("factor").applyInPandas(answer, "factor long, k int, id long, m array<double>, moved double"))
        if (state.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    belief = prior.join(sums(state), "id", "left").select("id", F.coalesce(add("prior", "total"), "prior").alias("b"))
    top = F.array_max("b")
    e = F.transform("b", lambda x: F.exp(x - top))
    return belief.select("id", F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)).alias("belief"))


def graph_text(cells: DataFrame, facets: DataFrame, kind: int, scale: float = 1.0) -> DataFrame:
    """cells (gid, cost0, cost1), facets (a, b: gids, coef) as lines of text: value.

    Kind 0: 'v gid -cost0 -cost1' and 'e a b -coef', scaled. Kind 1: capacities with the terminals 0 (source) and 1 (sink). Kind 2: '1 id source sink' and
    '2 a b cap 0'.
    """
    n = lambda c: F.format_string("%.6f", c * scale)
    gid = F.col("gid").cast("string")
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    if kind == 0:
        v, e = F.concat_ws(" ", F.lit("v"), gid, n(-F.col("cost0")), n(-F.col("cost1"))), F.concat_ws(" ", F.lit("e"), a, b, n(-F.col("coef")))
        return cells.select(v.alias("value")).unionByName(facets.select(e.alias("value")))
    if kind == 1:
        two = F.array(F.concat_ws(" ", F.lit("0"), gid, n(F.col("cost0"))), F.concat_ws(" ", gid, F.lit("1"), n(F.col("cost1"))))
        return cells.select(F.explode(two).alias("value")).unionByName(facets.select(F.concat_ws(" ", a, b, n(F.col("coef"))).alias("value")))
    if kind == 2:
        v, e = F.concat_ws(" ", F.lit("1"), gid, n(F.col("cost0")), n(F.col("cost1"))), F.concat_ws(" ", F.lit("2"), a, b, n(F.col("coef")), F.lit("0"))
        return cells.select(v.alias("value")).unionByName(facets.select(e.alias("value")))
    raise ValueError(f"unknown kind of graph text {kind}")


def read_cut_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of kind 2 (value) -> cells (tile 0, cell, cost0, cost1), facets (tile 0, a, b, coef)."""
    w = lines.select(F.split(F.trim("value"), r"\s+").alias("w"))
    at = lambda k, t: F.col("w")[k].cast(t)
    tile = F.lit(0).cast("long").alias("tile")
    cells = w.where("w[0] = '1'").select(tile, at(1, "long").alias("cell"), at(2, "double").alias("cost0"), at(3, "double").alias("cost1"))
    return cells, w.where("w[0] = '2'").select(tile, at(1, "long").alias("a"), at(2, "long").alias("b"), at(3, "double").alias("coef"))
