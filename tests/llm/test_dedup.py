"""SimHash, repeated passages and embeddings against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolith.llm import embedding_dedup, simhash, suffix
from geolith.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key long, fp long, did long, a long, row string, kept string, v string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


def documents(seed=0):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (0, 1, 3, 4, 5, 40, 80, 400)]
    near = [base[6].replace("a", "A", 3) + (" x" if k else "") for k in range(2)]
    texts = [None, "", " \n\t ", *base, *near, base[7], base[7][:1500] + words(rng, 30), "é" * 150 + base[6], words(rng, 5) + "é" * 150 + base[6], words(rng, 9000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (9, texts[9]), (None, texts[7]), (None, None), (None, words(rng, 60))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, 4, "r", "k", None) for d, t in rows], DOCS)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    want = brute.components(200, links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got.get(k, k) == want[k] for k in range(200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash(spark, block):
    rows = documents()
    got = simhash.simhash_components(frame(spark, rows), block=block).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.simhash(rows), key=key)


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.simhash(docs).collect())) == sorted(brute.simhash(rows))


def test_simhash_empty_and_keep_one(spark):
    assert simhash.simhash(frame(spark, [])).count() == 0
    rows = documents()
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    want = brute.simhash(rows)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in want if c is not None})
    assert kept.where("doc_id is null").count() == 1  # its only text without an id that no other text is near to


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 4), st.integers(2, 3000))
def test_plan_loses_no_pair(seed, radius, n):
    """Parts and thresholds bring every pair within the radius together, whatever the bits."""
    rng = np.random.default_rng(seed)
    bits = (rng.random((64, 64)) < 0.5).astype(float)
    parts = simhash.plan(n, bits.T @ bits * n / 64, radius)
    assert sum(t + 1 for _, t in parts) >= radius + 1 and sorted(b for p, _ in parts for b in p) == sorted({b for p, _ in parts for b in p})
    for _ in range(50):
        flips = set(rng.choice(64, radius, replace=False).tolist())
        assert any(len(flips & set(p)) <= t for p, t in parts)


@pytest.mark.parametrize("most", [1000, 1])
def test_suffix(spark, most):
    rows = documents()
    got = suffix.repeated_passages(frame(spark, rows), most=most).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute.suffix([t for _, t in rows]))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix_table_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, suffix.suffix_dedup(docs).collect())) == sorted((d, *x) for (d, _), x in zip(rows, brute.suffix([t for _, t in rows])))
    assert suffix.suffix_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated_passages(docs, 120)


def test_removal_keeps_columns_and_characters(spark):
    rows = documents()
    out = suffix.remove_repeats(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and out.count() == len(rows)
    assert "�" not in "".join(r["text"] for r in out.collect())


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from([1, 2, 4]))
def test_merged_windows(seed, n, letters):
    """Repeated windows of small alphabets, periodic texts included, as found by merging transforms."""
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"abcd"[:letters]) for _ in range(rng.randint(200, 420))) for _ in range(max(1, n // 2))]
    texts = [rng.choice(base)[rng.randint(0, 60) :] + bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 200))) for _ in range(n)]
    texts = [t for t in texts if len(t) >= 200] or [b"a" * 230]
    where = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 199):
            where.setdefault(t[i : i + 200], []).append((k, i))
    want = sorted(x for v in where.values() if len(v) > 1 for x in v)
    assert sorted((k, int(i)) for k, at in enumerate(suffix._repeats(texts, 200, np.ones(len(texts)))) for i in at) == want


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, 16))
    rows = [(k, (c + rng.normal(scale=s, size=16)).tolist()) for k, (c, s) in enumerate((centre[i % 3], 0.25) for i in range(60))]
    rows += [(100 + k, rng.normal(size=16).tolist()) for k in range(60)]
    x = rows[0][1]
    rows += [(200, x), (200, x), (201, [2 * v for v in x]), (202, [1e200 * v for v in x]), (203, [1e-200 * v for v in x]), (None, x), (None, [0.0] * 16), (204, [0.0] * 16), (205, None), (206, [])]
    return rows + [(207, [float("nan")] * 16), (208, [float("inf")] + [1.0] * 15), (209, [None] + [1.0] * 15), (210, [1.0, 0.0]), (211, [1.0, 0.1])]


@pytest.mark.parametrize("block", [2048, 4])
def test_embeddings(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(v, e, 1, 2, 3) for v, e in rows], "vec_id long, embedding array<double>, key long, filter long, copies long")
    got = sorted(map(tuple, embedding_dedup.embedding_dedup(df, block=block).collect()), key=key)
    assert got == sorted(brute.embedding(rows), key=key)


def test_embeddings_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_dedup(df).count() == 0
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_dedup(df).collect() == [(1, 0, 1, True)]


def test_codes_find_all_filters():
    """The list decoder passes exactly the filters over the threshold, or the best few."""
    codes = embedding_dedup.Codes(500, 16)
    x = np.random.default_rng(0).normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, ids = codes.passed(x)
    y = x @ codes.rotation
    a, b = ((y[:, p] @ c.T) for p, c in zip(codes.parts, codes.vectors))
    score = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for r in range(20):
        got = set(ids[rows == r].tolist())
        over = set(np.flatnonzero(score[r] >= codes.alpha).tolist())
        assert over <= got and len(got) >= embedding_dedup.PASSED / 4
        assert min(score[r][list(got)]) >= max(np.delete(score[r], list(got)))


def digest(df):
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()


def test_suffix_tells_texts_apart(spark):
    """Texts without ids whose 32-bit hashes agree keep their own cuts; ids may be strings and may repeat."""
    texts = spark.range(200000).select(F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(4)]).alias("text"))
    pair = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("x")).where("size(x) > 1").first()["x"][:2]
    rows = [(None, pair[0]), (None, pair[1]), (None, pair[1] + pair[1][:10]), ("a", "x" * 300), ("a", "y" * 199), ("b", None)]
    got = digest(suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id string, text string")))
    want = [(d, *x) for (d, _), x in zip(rows, brute.suffix([t for _, t in rows]))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert [r["n_removed"] for r in got if r["kept_sha256"] == brute.suffix([pair[0]])[0][3]] == [0]


def test_suffix_many_repeated_rows(spark):
    """The cost is linear in the repeats, whether rows or near copies."""
    rng = random.Random(8)
    text = words(rng, 1200)
    rows = [(1, text)] * 5000 + [(None, text)] * 500 + [(2 + k, text[:2000] + words(rng, 40) + text[2000:]) for k in range(300)]
    got = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    want = {(len(t), n) for (_, t), (_, n, *_) in zip(rows[-301:], brute.suffix([t for _, t in rows[-302:]])[1:])}
    assert got.count() == len(rows)
    assert {(r["n_bytes"], r["n_removed"]) for r in got.collect()} == want


def test_weights_of_contexts():
    """A string that occurs several times is repeated as a whole; one that occurs once only where it meets another."""
    rng = random.Random(3)
    a, b, c = (words(rng, 90).encode()[:280] for _ in range(3))
    got = suffix._repeats([a, b, c, a[:240] + c[240:]], 200, np.array([3.0, 1, 1, 1]))
    assert [len(x) for x in got] == [81, 0, 0, 41]
