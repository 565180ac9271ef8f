"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words and the beginnings of its words, hashed to 2^20 slots. Slots are counted by label
over the training rows, and the `TERMS` whose log-odds stand out most are kept, so a term weighs the same in a
short and in a long text. The machine has a weight for each term and a vector of `RANK` factors; the products
of factors are weights of pairs of terms. It is fitted by Adam with the logistic loss, in batches whose order a hash of the id sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.llm.common import cut, session

SLOTS, TERMS, RANK, RATE, DECAY = 1 << 20, 4096, 4, 0.05, 1e-5
#: Texts in a step, and steps at least; every row is seen five times at least.
BATCH, STEPS = 1000, 400
#: Labelled rows to fit on, about, at most (chosen by a hash). The driver gets a list of at most TERMS numbers for each.
MOST_ROWS = 50_000
#: Beginnings of words that count as terms, by length in characters.
PREFIXES = (4, 5, 6, 7)
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def term_slots(word: str) -> tuple[int, ...]:
    """Slots of a lower-case word: the word itself and its beginnings. Without letters or digits: none."""
    word = word.strip(_EDGE)
    if not word:
        return ()
    terms = ["=" + word] + [word[:n] for n in PREFIXES if len(word) > n]
    return tuple(xxhash.xxh64_intdigest(t.encode()) % SLOTS for t in terms)


def _slots_of(texts, chosen: dict[int, int] | None) -> list[list[int]]:
    """The distinct slots of each text, or the numbers of those that are chosen."""
    known: dict[str, tuple[int, ...]] = {}
    out = []
    for t in texts:
        found: set[int] = set()
        for w in set(t.lower().split()) if t else ():
            at = known.get(w)
            if at is None:
                at = term_slots(w)
                if chosen is not None:
                    at = tuple(chosen[k] for k in at if k in chosen)
                if len(known) > 200_000:
                    known.clear()
                known[w] = at
            found.update(at)
        out.append(sorted(found))
    return out


def choose_terms(train: DataFrame) -> dict[int, int]:
    """train (text, y) -> slot -> number, for the slots of greatest weighted log-odds, seen in three texts at least."""

    def run(batches):
        count = np.zeros((2, SLOTS), np.int32)
        for b in batches:
            for slots, y in zip(_slots_of(b.column(0).to_pylist(), None), b.column(1).to_pylist()):
                count[0, slots] += 1
                count[1, slots] += y >= 0.5
        at = np.flatnonzero(count[0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at].astype(np.int64)), pa.array(count[1, at].astype(np.int64))], ["slot", "n", "ones"])

    counts = train.select("text", "y").mapInArrow(run, "slot long, n long, ones long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where("n >= 3")
    total = train.agg(F.count("*"), F.sum((F.col("y") >= 0.5).cast("long"))).first()
    rows, ones = total[0], total[1] or 0
    rest = F.col("n") - F.col("ones")
    odds = F.log((F.col("ones") + 0.5) / (ones - F.col("ones") + 0.5)) - F.log((rest + 0.5) / (rows - ones - rest + 0.5))
    error = 1 / (F.col("ones") + 0.5) + 1 / (rest + 0.5)
    best = counts.select("slot", F.abs(odds / F.sqrt(error)).alias("z")).orderBy(F.desc("z"), "slot").limit(TERMS)
    return {r[0]: k for k, r in enumerate(best.collect())}


class Machine:
    """score = sigmoid(w0 + sum of w + sum over pairs of terms of their factors' product)."""

    def __init__(self, terms: int, seed: int = 3):
        self.w0, self.w = 0.0, np.zeros(terms + 1)
        self.v = np.random.default_rng(seed).normal(scale=0.01, size=(terms + 1, RANK))
        self.w[terms] = self.v[terms] = 0  # stands for "no term"

    def raw(self, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[ids]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(RANK)], axis=1)
        squares = np.bincount(rows, (v * v).sum(1), n)
        return self.w0 + np.bincount(rows, self.w[ids], n) + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, lists: list[list[int]]) -> np.ndarray:
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        ids = np.array([k for x in lists for k in x], np.int64)
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, rows, len(lists))[0], -30, 30)))

    def fit(self, flat: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> Machine:
        """Text i has the terms flat[offsets[i]:offsets[i + 1]]."""
        n, size = len(y), len(self.w)
        self.w0 = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        params = [self.w, self.v]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        starts = range(0, n, BATCH)
        steps = max(STEPS, 5 * len(starts))
        for t in range(1, steps + 1):
            lo = starts[(t - 1) % len(starts)]
            hi = min(lo + BATCH, n)
            ids, rows = flat[offsets[lo] : offsets[hi]], np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            raw, sums = self.raw(ids, rows, hi - lo)
            g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[lo:hi]
            gi = g[rows]
            pull = gi[:, None] * (sums[rows] - self.v[ids])
            grads = [np.bincount(ids, gi, size), np.stack([np.bincount(ids, pull[:, f], size) for f in range(RANK)], axis=1)]
            rate = RATE * (1 - (t - 1) / steps)
            self.w0 -= rate * g.mean()
            for p, d, a, b in zip(params, grads, m, s):
                d = d / (hi - lo) + DECAY * p
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, toxic), held_out: a boolean column of doc_id -> doc_id, held_out,
    score (0 to 1), predicted (score >= 0.5), one row per row of docs.

    Only labels of rows that are not held out are learnt; several labels of an id are averaged, null ones ignored.
    Of rows that share an id the machine learns the one of the least text hash, so reruns agree; repeated rows are scored alike. Long texts
    count whole, a score of 0.5 is predicted 1, other columns are ignored whatever their names.
    Null and empty texts have no terms: their score is the base rate's. A null id is not held out and has no label.
    No labels: every score is 0.5. An empty table gives no rows.
    """
    session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("y"))
    known = cut(known.where(~F.coalesce(held_out, F.lit(False))))
    n = known.count()
    if n > MOST_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < MOST_ROWS * (1 << 20) // n)
    # About MOST_ROWS ids and labels at most: small enough to go to the texts, which then need no shuffle.
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    chosen = choose_terms(train)

    def lists(batches):
        for b in batches:
            got = _slots_of(b.column(0).to_pylist(), chosen)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), *b.columns[1:]], ["ids", "y", "key", "th"])

    keyed = train.select("text", "y", F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("th"))
    rows = keyed.mapInArrow(lists, "ids array<int>, y double, key long, th long")
    # One row for each id, the same in every run: that of the least hash of its text.
    rows = rows.groupBy("key").agg(F.min(F.struct("th", "ids", "y")).alias("m")).select("key", "m.ids", "m.y").toArrow().sort_by("key")
    if rows.num_rows:
        ids = rows["ids"].combine_chunks()
        model = Machine(len(chosen)).fit(ids.flatten().to_numpy(), ids.offsets.to_numpy(), rows["y"].to_numpy())
    else:
        model = Machine(0)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_slots_of(b.column(1).to_pylist(), chosen)))], ["doc_id", "score"])

    out = docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
