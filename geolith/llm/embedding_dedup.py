"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product exceeds `alpha`. The directions are products of
random codes: the space, after a random rotation, is cut into blocks, each with a list of random unit
vectors, and a direction takes one from each block. The filters that a vector passes are listed without
looking at all of them: the codes of each block are sorted by inner product, and combined only as long
as the sum can exceed the threshold. Near vectors pass many filters in common. Vectors meet by filter,
and each pair is verified in double precision, in the first filter that both pass.
"""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut, session
from geolith.llm.components import components

#: Filters that a vector passes on average; vectors that a filter holds on average.
PASSED, HELD = 24.0, 64.0


class Codes:
    """Filters for n vectors of a dimension: numbers of a code in each block, and the threshold."""

    def __init__(self, n: int, dim: int, seed: int = 5):
        wanted = max(PASSED * n / HELD, 4 * PASSED)
        self.blocks = max(1, min(2 if wanted < 1 << 24 else 4, dim))
        self.codes = int(np.ceil(wanted ** (1 / self.blocks)))
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        self.vectors = []
        for p in self.parts:
            c = rng.normal(size=(self.codes, p.stop - p.start))
            self.vectors.append(c / np.linalg.norm(c, axis=1, keepdims=True) / sqrt(self.blocks))
        share, lo, hi = PASSED / self.codes**self.blocks, 0.0, 40.0
        for _ in range(80):  # the normal quantile that `share` of the filters exceed
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 0.5 * erfc(mid / sqrt(2)) > share else (lo, mid)
        self.alpha = lo / sqrt(dim)

    def passed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors -> (row, filter) of all filters passed, in order of row and filter. A vector that passes fewer than a
        quarter of the average gets that many of its best, so that none is left out."""
        y = x @ self.rotation
        scores = [y[:, p] @ c.T for p, c in zip(self.parts, self.vectors)]
        rows, sums, ids = np.repeat(np.arange(len(x)), 1), np.zeros(len(x)), np.zeros(len(x), np.int64)
        best = [s.max(1) for s in scores]
        floor = np.minimum(self.alpha, self._floor(scores))
        for k, s in enumerate(scores):
            rest = sum((b for b in best[k + 1 :]), np.zeros(len(x)))
            order = np.argsort(-s, axis=1, kind="stable")
            ranked = np.take_along_axis(s, order, axis=1)
            need = floor[rows] - rest[rows] - sums
            # Codes in falling order: how many of them still reach what is needed.
            many = np.array([np.searchsorted(-ranked[r], -t, side="right") for r, t in zip(rows, need)], np.int64)
            which = np.repeat(np.arange(len(rows)), many)
            rank = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            rows = rows[which]
            sums = sums[which] + ranked[rows, rank]
            ids = ids[which] * self.codes + order[rows, rank]
        order = np.lexsort((ids, rows))
        return rows[order], ids[order]

    def _floor(self, scores: list[np.ndarray], least: int = int(PASSED / 4)) -> np.ndarray:
        """The sum that the best `least` combinations reach, from the best few codes of each block."""
        top = [np.sort(s, axis=1)[:, ::-1][:, :least] for s in scores]
        total = top[0]
        for t in top[1:]:
            total = np.sort((total[:, :, None] + t[:, None, :]).reshape(len(t), -1), axis=1)[:, ::-1][:, :least]
        return total[:, min(least, total.shape[1]) - 1] - 1e-12


def _unit(column, dim: int) -> np.ndarray:
    """Vectors of a column at length one, in double precision; by the largest component first, so that no square overflows or vanishes."""
    x = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(-1, dim).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(batches):
    """(vec_id, embedding) -> with a key that equal vectors share, null if the vector is null, empty, zero or holds a null or non-finite component."""
    for b in batches:
        e = b.column(1)
        values = e.flatten()
        bad = pc.or_kleene(pc.is_null(values), pc.invert(pc.is_finite(pc.cast(values, pa.float64()))))
        x, bad = values.to_numpy(zero_copy_only=False), bad.fill_null(True).to_numpy(zero_copy_only=False)
        sizes = np.diff(pc.list_value_length(e).fill_null(0).to_numpy(zero_copy_only=False).cumsum(), prepend=0)
        ends = sizes.cumsum()
        keys = []
        for a, z in zip((ends - sizes).tolist(), ends.tolist()):
            good = z > a and not bad[a:z].any() and x[a:z].any()
            keys.append(int.from_bytes(xxhash.xxh64_digest(np.ascontiguousarray(x[a:z]).tobytes()), "big", signed=True) if good else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), e], ["vec_id", "key", "v"])


def _filters(codes: Codes, dim: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = _unit(part.column(1), dim)
                rows, ids = codes.passed(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *(part.column(k).take(pa.array(rows)) for k in (0, 1, 2))], ["filter", "key", "v", "copies"])

    return run


def _meet(codes: Codes, dim: int, cosine: float):
    """Rows in order of (filter, x, y) -> for each vector the copies of vectors linked in this group, and links that span it."""

    def solve(flt: int, x: int, y: int, key, side, vec, copies) -> list[tuple]:
        first, member = np.unique(key, return_index=True)
        if len(first) < 2:
            return []
        vec, copies, side = vec[member], copies[member], side[member]

        def linked(lo: int) -> np.ndarray:
            s = vec[lo : lo + 512] @ vec.T >= cosine
            s[np.arange(len(s)), lo + np.arange(len(s))] = False
            if x != y:  # two different blocks: pairs within one meet elsewhere
                s &= side[lo : lo + 512, None] != side[None, :]
            return s

        some = np.concatenate([linked(lo).any(axis=1) for lo in range(0, len(first), 512)])
        if not some.any():
            return []
        first, vec, copies, side = first[some], vec[some], copies[some], side[some]
        rows, ids = codes.passed(vec)
        earlier = ids < flt
        seen, at = np.unique(ids[earlier], return_inverse=True)
        mark = np.zeros((len(first), len(seen)), np.float32)
        mark[rows[earlier], at] = 1
        count, out, left = np.zeros(len(first), np.int64), [], np.ones(len(first), bool)
        near = []
        for lo in range(0, len(first), 512):
            s = linked(lo)
            r, c = np.nonzero(s)
            near.append(((r + lo).astype(np.int32), c.astype(np.int32)))
            s &= mark[lo : lo + 512] @ mark.T == 0  # else the pair is counted in an earlier filter
            count[lo : lo + 512] = s @ copies
        r, c = (np.concatenate([n[k] for n in near]) for k in (0, 1))
        bounds = np.searchsorted(r, np.arange(len(first) + 1))
        for s in range(len(first)):  # a spanning forest: fewer links than members
            if not left[s] or bounds[s] == bounds[s + 1]:
                continue
            left[s], queue = False, [s]
            while queue:
                u = queue.pop()
                v = c[bounds[u] : bounds[u + 1]]
                v = v[left[v]]
                left[v] = False
                queue += v.tolist()
                out += [(int(first[u]), int(first[w]), 0) for w in v]
        return out + [(int(first[k]), None, int(count[k])) for k in np.flatnonzero(count)]

    def run(batches):
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def groups(t: pa.Table, last: bool):
            names = [t.column(k).to_numpy() for k in (0, 1, 2)]
            new = np.flatnonzero((np.diff(names[0], prepend=-1) != 0) | (np.diff(names[1], prepend=-1) != 0) | (np.diff(names[2], prepend=-1) != 0))
            ends = np.append(new[1:], t.num_rows)
            stop = len(new) if last else len(new) - 1
            key, side, copies = (t.column(k).to_numpy() for k in (3, 4, 6))
            vec = _unit(t.column(5), dim)
            out = []
            for a, b in zip(new[:stop], ends[:stop]):
                if b - a > 1:
                    out += solve(int(names[0][a]), int(names[1][a]), int(names[2][a]), key[a:b], side[a:b], vec[a:b], copies[a:b])
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema), t.slice(new[stop]) if stop < len(new) else t.slice(t.num_rows)

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= 4096:
                got, rest = groups(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                yield got
        if held:
            yield groups(pa.Table.from_batches(held), True)[0]

    return run


def embedding_links(classes: DataFrame, n: int, dim: int, cosine: float, block: int) -> DataFrame:
    """classes (key, v, copies) -> (a, null, n: copies linked with a, to be added up) and (a, b, 0):
    links that span what is linked. Filters with over `block` vectors are dealt out as pairs of blocks."""
    codes, kind = Codes(n, dim), classes.schema["v"].dataType.simpleString()
    rows = cut(classes.select("key", "v", "copies")).mapInArrow(_filters(codes, dim), f"filter long, key long, v {kind}, copies long")
    hot = cut(rows.groupBy("filter").count().where(F.col("count") > block).select("filter", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    one = F.lit(0)
    if hot.count():
        rows = rows.join(hot, "filter", "left").withColumn("side", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = rows.select("filter", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "key", "side", "v", "copies")
    else:
        rows = rows.select("filter", one.alias("x"), one.alias("y"), "key", one.alias("side"), "v", "copies")
    rows = rows.repartition("filter", "x", "y").sortWithinPartitions("filter", "x", "y")
    return rows.mapInArrow(_meet(codes, dim, cosine), "a long, b long, n long")


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95, block: int = 2048) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept: one row per row of vectors.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing: n_links 0 and a component of
    their own. Vectors of different lengths are compared within their length. Copies link with each other; they
    are compared once, with their number. Rows without an id count as links; a component of them alone has a null id and
    they are not kept. Repeated rows are vectors like others, and share a component. No rows: no rows.
    """
    session(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    rows = cut(rows.mapInArrow(_keyed, f"vec_id long, key long, v {kind}"))
    classes = rows.where("key is not null").groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = cut(classes)
    sizes = classes.groupBy(F.size("v").alias("dim")).count().collect()  # one row for each length
    found = None
    for dim, n in sizes:
        got = embedding_links(classes.where(F.size("v") == dim), n, dim, cosine, block)
        found = got if found is None else found.union(got)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut(found)
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    classes = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    classes = classes.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    # Written tables on one side: then Spark can split the other side's large partitions, of a large component or many copies.
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut(classes.join(least, "root").select(F.col("key").alias("k"), "n_links", "component_id"))
    out = rows.join(classes, F.col("key") == F.col("k"), "left")
    own = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
