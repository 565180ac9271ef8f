"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes a vector of statistics of its bytes, words and lines. Cosines of random projections
approximate a Gaussian kernel on the standardised vectors. Each partition sums its share of the normal
equations; the driver adds a fixed number of such sums and solves for the ridge weights. Labelled rows are
in two halves: each half is scored with the other half's weights, and those scores, counted in bins,
give the isotonic curve from score to probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut, session

#: Random features, kernel width (in standard deviations, for each root of a dimension), ridge, bins of the curve.
FEATURES, WIDTH, RIDGE, BINS = 256, 1.0, 1e-3, 2000
#: Labelled rows to fit on, about, at most (chosen by a hash), and partial sums that reach the driver.
MOST_ROWS, SUMS = 200_000, 8

_CLASSES = {"digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "space": b" \t\n\v\f\r", "symbol": b"#*$%&|<>@^~_={}[]\\/+", "stop": b".,;:", "mark": b"!?", "quote": b"\"'()-"}
_TABLE = np.zeros((256, len(_CLASSES) + 1), np.float32)
for _k, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v), _k] = 1
_TABLE[128:, -1] = 1
DIM = _TABLE.shape[1] + 13


def statistics(text: bytes | None) -> list[float]:
    """DIM numbers of a text: shares of byte classes, lengths, repeats of words and lines. Empty or null: zeros but finite."""
    text = text or b""
    n = max(len(text), 1)
    bins = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = bins[bins > 0] / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    m = max(len(words), 1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    tails = [w[-1:] for w in words]
    return [
        *np.sqrt(bins @ _TABLE / n).tolist(),
        np.log1p(len(text)), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()), float(sizes.max()) ** 0.5,
        distinct / m, pairs / max(m - 1, 1), len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)),
        float(-(p * np.log2(p)).sum()), sum(t in b"!?#*$%&|" for t in tails) / m, sum(t in b".," for t in tails) / m, sum(w.isupper() for w in words) / m,
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, f array<float>), one row per row of docs."""

    def run(batches):
        for b in batches:
            got = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float32).reshape(b.num_rows, DIM)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * DIM)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))], ["doc_id", "f"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f array<float>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, DIM)


class Features:
    """Standardisation, then cosines of random projections, and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.maximum(sd, 1e-3)
        self.w = rng.normal(size=(DIM, FEATURES - 1)) / (WIDTH * np.sqrt(DIM))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES)])


def _summed(rows: DataFrame, fold) -> np.ndarray:
    """Add up fold(batch) -> array over all rows, in SUMS partial sums."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = fold(b)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    got = rows.coalesce(SUMS).mapInArrow(run, "v array<double>").toArrow().column("v").combine_chunks()
    return got.flatten().to_numpy()  # SUMS or fewer arrays, one after the other


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the nondecreasing means of y (weights n) over increasing x, as points to interpolate."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    at = np.array(blocks, float)
    return at[:, 0] / at[:, 2], at[:, 1] / at[:, 2]


def fit(train: DataFrame):
    """train (key, f, y in 0..1) -> score(matrix of statistics) -> probabilities. No rows: 0.5 for all."""
    rows = train.where("y is not null").select(F.col("key").cast("long").alias("key"), "f", F.col("y").cast("double").alias("y"))
    n = rows.count()
    if not n:
        return lambda x: np.full(len(x), 0.5)
    if n > MOST_ROWS:
        rows = rows.where(F.pmod(F.col("key"), F.lit(1 << 20)) < MOST_ROWS * (1 << 20) // n)
    rows = cut(rows)

    def moments(b):
        x = _matrix(b.column(1))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    s = _summed(rows, moments).reshape(-1, 2 * DIM + 1).sum(0)
    mean = s[1 : DIM + 1] / s[0]
    feature = Features(mean, np.sqrt(np.maximum(s[DIM + 1 :] / s[0] - mean**2, 0)))

    def normal(b):
        phi, y = feature(_matrix(b.column(1))), b.column(2).to_numpy()
        half = b.column(0).to_numpy() & 1
        return np.stack([np.vstack([phi[half == k].T @ phi[half == k], phi[half == k].T @ y[half == k], np.full(FEATURES, (half == k).sum())]) for k in (0, 1)])

    eq = _summed(rows, normal).reshape(-1, 2, FEATURES + 2, FEATURES).sum(0)
    solve = lambda e: np.linalg.solve(e[:FEATURES] + RIDGE * max(e[-1, 0], 1) * np.eye(FEATURES), e[FEATURES])
    weights, whole = [solve(e) for e in eq], solve(eq.sum(0))

    def curve(b):
        phi, y = feature(_matrix(b.column(1))), b.column(2).to_numpy()
        half = b.column(0).to_numpy() & 1
        s = np.where(half == 0, phi @ weights[1], phi @ weights[0])
        at = np.clip(((s + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, s, BINS)]).astype(float)

    count, ones, sums = _summed(rows, curve).reshape(-1, 3, BINS).sum(0)
    used = count > 0
    xs, ys = isotonic(sums[used] / count[used], ones[used] / count[used], count[used])
    return lambda x: np.interp(feature(x) @ whole, xs, ys)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality), held_out: a boolean column of doc_id -> doc_id, held_out,
    score (0 to 1), predicted (score >= 0.7), one row per row of docs.

    Only labels of rows that are not held out are learnt; several labels of an id are averaged, null ones ignored,
    and an id that repeats is learnt once for each row. Null and empty texts are scored as texts of length 0. A null id
    is not held out and has no label. No labels: every score is 0.5. An empty table gives no rows.
    """
    session(docs.sparkSession)
    every = cut(vectors(docs.select("doc_id", "text")))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    train = every.where(~F.coalesce(held_out, F.lit(False))).join(known, "doc_id").select(F.shiftright(F.xxhash64("doc_id"), 1).alias("key"), "f", "y")
    score = fit(train)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score(_matrix(b.column(1))), 0, 1))], ["doc_id", "score"])

    out = every.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
