"""Classifiers: held-out accuracy, what they learn from, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith.llm import quality_model, toxicity
from geolith.llm.common import fold
from tests.llm.test_dedup import words

SF = "/root/testdata/sf0.01"


def scored(spark, f, modulus, rest, label, docs=None, labels=None):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if docs is None else docs
    labels = spark.read.parquet(f"{SF}/labels.parquet") if labels is None else labels
    return f(docs, labels, fold("doc_id", modulus) == rest)


@pytest.mark.parametrize("f, modulus, rest, label, at, least", [(quality_model.quality_scores, 4, 2, "quality", 0.7, 0.93), (toxicity.toxicity_scores, 5, 0, "toxic", 0.5, 0.9)])
def test_held_out(spark, f, modulus, rest, label, at, least):
    got = scored(spark, f, modulus, rest, label)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert got.count() == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= at) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in out]) >= least
    # Held-out labels change nothing.
    turned = spark.read.parquet(f"{SF}/labels.parquet").withColumn(label, F.when(fold("doc_id", modulus) == rest, 1 - F.col(label)).otherwise(F.col(label)))
    a = {r["doc_id"]: r["score"] for r in got.collect()}
    b = {r["doc_id"]: r["score"] for r in scored(spark, f, modulus, rest, label, labels=turned).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


@pytest.mark.parametrize("f, label", [(quality_model.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_odd_inputs(spark, f, label):
    rng = random.Random(0)
    rows = [(k, words(rng, 60) + (" zzzz" if k % 2 else "")) for k in range(60)] + [(100, None), (101, ""), (102, " \n"), (None, "some words"), (3, "again"), (103, words(rng, 20000))]
    docs = spark.createDataFrame([(d, t, 0.5, True) for d, t in rows], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (5, None), (7, 0)], f"doc_id long, {label} int")
    got = f(docs, labels, fold("doc_id", 4) == 2).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == 0.5 for r in f(docs, labels.limit(0), fold("doc_id", 4) == 2).collect())
    assert f(docs.limit(0), labels, fold("doc_id", 4) == 2).count() == 0
    one = f(docs, labels.where(f"{label} = 1"), F.lit(False)).collect()  # one class only
    assert all(0 <= r["score"] <= 1 for r in one)


def test_machine_learns_a_pair():
    """Two terms that are harmless alone and toxic together: an additive model can't tell, the pair's factors can."""
    rng = np.random.default_rng(0)
    lists = [[k for k in range(12) if rng.random() < 0.35] for _ in range(3000)]
    y = np.array([float(0 in x and 1 in x) for x in lists])
    offsets = np.cumsum([0] + [len(x) for x in lists])
    model = toxicity.Machine(12).fit(np.array([k for x in lists for k in x]), offsets, y)
    got = model.scores([[0], [1], [0, 1], [0, 1, 5], [5, 6]]) >= 0.5
    assert got.tolist() == [False, False, True, True, False]


def test_isotonic():
    x, y = quality_model.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 3, 1]))
    assert x.tolist() == [0, 1.75, 3] and y.tolist() == [0, 0.25, 1]


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    f = quality_model.Features(np.zeros(quality_model.DIM), np.ones(quality_model.DIM))
    x = rng.normal(size=(40, quality_model.DIM))
    phi = f(x)[:, 1:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * quality_model.DIM * quality_model.WIDTH**2))
    assert np.abs(phi @ phi.T - want).max() < 0.3


def test_repeated_ids_fit_alike(spark):
    """Rows that share an id and differ in text: the fit doesn't depend on which comes first."""
    docs = spark.createDataFrame([(k % 40, f"{'vile' if k % 3 else 'mild'} word{k % 7} other{k}") for k in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(40)], "doc_id long, toxic int")
    held = F.col("doc_id") % 5 == 0
    ways = (docs.coalesce(1), docs.repartition(6), docs.orderBy(F.desc("text")))
    got = [sorted(map(tuple, toxicity.toxicity_scores(d.select("doc_id", "text"), labels, held).join(docs.select("doc_id").distinct(), "doc_id").collect())) for d in ways]
    assert got[0] == got[1] == got[2] and len(got[0]) == 160
