"""SimHash near-duplicates, joined by the generalised pigeonhole principle.

A fingerprint has 64 bits, the majority of the XXH64 values of a text's word shingles. Two
fingerprints within `radius` differing bits must, for any split of the bits into m parts with
thresholds that sum to radius - m + 1, lie within the threshold in at least one part. The
parts hold bits that correlate; thresholds, and m itself, come from a dynamic program
over candidate counts that are estimated from the bit statistics of all fingerprints. Each
fingerprint is indexed under its value in a part and probes the values within the threshold;
what meets under a key is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut, session
from geolith.llm.components import components

#: Microseconds for one probe row (shuffled and sorted) and one pair (verified in numpy), for the plan only.
ROW_COST, PAIR_COST = 1.0, 0.015


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values. No words (or null): 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - width + 1].tolist()
    h, view = xxhash.xxh64_digest, ends[width - 1 :].tolist()
    ones, m = np.zeros(64, np.int64), n - width + 1
    for k in range(0, m, 1 << 16):
        got = b"".join([h(joined[s:e], seed) for s, e in zip(starts[k : k + (1 << 16)], view[k : k + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, th long: a hash of the text, fp long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits in how many both are set: 64 x 64 sums
    over all rows, added up on the executors."""

    def run(batches):
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(bits), 1 << 20):
                both += bits[k : k + (1 << 20)].T @ bits[k : k + (1 << 20)]
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["i", "v"])

    got = dict(fps.select("fp").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect())
    return got.get(4096, 0), np.array([got.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def _parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of 64/m bits: each is seeded with the most correlated bit left and filled with its companions."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, parts = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        part = [max(left, key=lambda b: (corr[b][left].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in left if b not in part), key=lambda b: (corr[b][part].sum(), -b)))
        left = [b for b in left if b not in part]
        parts.append(sorted(part))
    return parts


def plan(n: int, both: np.ndarray, radius: int = 4) -> list[tuple[list[int], int]]:
    """The parts (bit numbers, threshold) of least estimated cost. A threshold of -1 leaves a part out."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, radius + 2):
        parts, total = _parts(n, both, m), radius - m + 1
        cost = []
        for part in parts:
            at = np.zeros(radius + 1)  # chance that a random pair differs in k bits of the part
            at[0] = 1
            for b in part:
                at = at * (1 - differ[b]) + np.append([0], at[:-1]) * differ[b]
            cost.append([0.0] + [n * sum(comb(len(part), j) for j in range(t + 1)) * ROW_COST + n * (n - 1) / 2 * at[: t + 1].sum() * PAIR_COST for t in range(radius + 1)])
        table = {0: (0.0, [])}  # sum of (threshold + 1) so far -> cost, thresholds
        for c in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (so_far, ts) in table.items():
                for t in range(-1, radius + 1):
                    if used + t + 1 <= total + m and (x := so_far + c[t + 1]) < nxt.get(used + t + 1, (float("inf"),))[0]:
                        nxt[used + t + 1] = (x, [*ts, t])
            table = nxt
        x, ts = table[total + m]
        if x < best[0]:
            best = (x, [(part, t) for part, t in zip(parts, ts) if t >= 0])
    return best[1]


def _masks(bits: int, t: int) -> np.ndarray:
    """All masks of 1 to t of `bits` bits."""
    out, layer = [], [(0, 0)]
    for _ in range(t):
        layer = [(mask | 1 << b, b + 1) for mask, first in layer for b in range(first, bits)]
        out += [m for m, _ in layer]
    return np.array(out, np.int64)


def _keys(parts: list[tuple[list[int], int]]):
    """Index and probe rows (key, fp, probe) of each fingerprint. A pair that differs within a part is
    probed from the side that has the mask's top bit set, so it meets once."""
    masks = [_masks(len(bits), t) for bits, t in parts]
    tops = [np.int64(1) << np.array([int(x).bit_length() - 1 for x in m], np.int64) for m in masks]

    def run(batches):
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(every), 2000):
                fp = every[lo : lo + 2000]
                keys, fps, probes = [], [], []
                for i, (bits, _) in enumerate(parts):
                    v = np.zeros(len(fp), np.int64)
                    for k, bit in enumerate(bits):
                        v |= ((fp >> np.int64(bit)) & 1) << np.int64(k)
                    salt = np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * i + 1) if len(bits) == 64 else np.uint64(i) << np.uint64(56)
                    keys.append(v ^ salt.astype(np.int64))
                    fps.append(fp)
                    probes.append(np.zeros(len(fp), bool))
                    if len(masks[i]):
                        r, c = np.nonzero(v[:, None] & tops[i][None, :])
                        keys.append(v[r] ^ masks[i][c] ^ salt.astype(np.int64))
                        fps.append(fp[r])
                        probes.append(np.ones(len(r), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, fps, probes)], ["key", "fp", "probe"])

    return run


def _differ(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count the absolute value's bits


def _forest(fp: np.ndarray, probe: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span what is linked within one large group: each fingerprint is expanded once, so there
    are fewer links than members however dense the group."""
    fp, first = np.unique(fp, return_index=True)
    left, out = np.ones(len(fp), bool), []
    for s in range(len(fp)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[_differ(fp[rest], fp[u]) <= radius]
            if len(near):
                left[near] = False
                queue.extend(near.tolist())
                out.append((np.full(len(near), fp[u]), fp[near]))
    return out


def _links(radius: int, small: int = 64):
    """Rows in key order -> verified links (a, b). A key's rows may span batches."""

    def solve(key, fp, probe):
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, sizes = np.append(0, cuts), np.diff(np.append(np.append(0, cuts), len(key)))
        out = []
        size = np.repeat(sizes, sizes)
        at = np.arange(len(key)) - np.repeat(starts, sizes)
        row = np.flatnonzero((size > 1) & (size <= small))
        d = 1
        while len(row := row[at[row] + d < size[row]]):
            ok = (_differ(fp[row], fp[row + d]) <= radius) & ~(probe[row] & probe[row + d]) & (fp[row] != fp[row + d])
            out.append((fp[row[ok]], fp[row[ok] + d]))
            d += 1
        for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
            if not probe[s : s + n].all():
                out += _forest(fp[s : s + n], probe[s : s + n], radius)
        a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield solve(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield solve(*held)

    return run


def fingerprint_links(fps: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect whatever is connected by pairs within
    `radius` bits. Keys with more than `block` rows are dealt out as pairs of blocks, so no task gets a
    group whole; every pair of the group still meets."""
    n, both = bit_statistics(fps)
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    rows = fps.select("fp").mapInArrow(_keys(plan(n, both, radius)), "key long, fp long, probe boolean")
    hot = cut(rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    rows = rows.withColumn("pair", F.lit(0))
    if hot.count():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.drop("pair").join(hot, "key", "left").select("key", "fp", "probe", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        rows = rows.select("*", own.alias("x"), other.alias("y")).select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "fp", "probe")
    return rows.select("key", "fp", "probe").repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, block: int = 4096) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, th, fp, root long, component_id), one row per row of docs.

    component_id is the least doc_id reachable over links of at most `radius` differing bits. Null and
    empty texts and texts without words have fingerprint zero and link like any other. Rows without an
    id count as documents; a component of them alone has component_id null. Repeated rows and copies
    share a fingerprint and are handled as one. Other columns of docs are ignored. An empty table
    gives no rows.
    """
    session(docs.sparkSession)
    each = cut(fingerprints(docs, width))
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(each.select("fp").distinct(), radius, block))
    classes = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written tables on one side: then Spark can split the other side's large partitions, of a large component or many copies.
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut(classes.join(least, "root").select("fp", "root", "component_id"))
    return each.join(classes, "fp").select("doc_id", "th", "fp", "root", "component_id")


def simhash(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """As simhash_components, with the fingerprint as 16 hex digits."""
    return simhash_components(docs, width, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs that stand for their component: those with its least id, one of them if rows repeat.
    A component without any id keeps one row."""
    found = simhash_components(docs, width, radius)
    # By the root as text: not the key that the rows are already dealt by, so a large component is combined before it is shuffled.
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("root").cast("string")).agg(F.min(F.struct("doc_id", "th")).alias("s"))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))
    chosen = chosen.select("s.doc_id", F.col("s.th").alias("th")).select(own.alias("id"), "th")
    rows = docs.select(F.struct("*").alias("row"), own.alias("id"), F.xxhash64("text").alias("th"))
    # Repeated rows go first, before the shuffle as far as they meet there; the join is on the same keys, so the texts are shuffled once.
    kept = rows.dropDuplicates(["id", "th"]).join(chosen, ["id", "th"], "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
