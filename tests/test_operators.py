"""Operators that no registered query covers."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geolith.functions import geometry as g
from geolith.operators import energy, fusion, knn, messages, orientation, pca, simplify, surface, tiling
from geolith.schema import Box
from geolith.sources import ply, points, sinks
from geolith.streaming import ingest


def cloud(spark, n=300, seed=0):
    p = np.random.default_rng(seed).random((n, 3))
    return p, spark.createDataFrame(pd.DataFrame({"pid": range(n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))


def test_grid_neighbours_are_the_nearest(spark):
    p, df = cloud(spark, 200)
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = knn.knn_grid(df, 5, "pid", 0.1).toPandas().sort_values(["query", "rank"])
    assert got["key"].to_numpy().reshape(-1, 5).tolist() == np.argsort(d, axis=1)[:, :5].tolist()


def test_shapes_of_a_plane(spark):
    rng = np.random.default_rng(2)
    p = np.column_stack([rng.random((60, 2)) * 10, rng.normal(0, 0.01, 60)])
    d2 = ((p - p[0]) ** 2).sum(1)
    order = np.argsort(d2)
    rows = pd.DataFrame({"query": 0, "rank": range(60), "d2": d2[order], "x": p[order, 0], "y": p[order, 1], "z": p[order, 2]})
    r = pca.neighbourhood_shapes(spark.createDataFrame(rows)).first()
    assert r["s3"] < 0.05 * r["s2"] and abs(r["v3"][2]) > 0.99


def test_fusion_is_the_rule_applied_in_turn(spark):
    m = [(0.3, 0.2, 0.5), (0.6, 0.1, 0.3), (0.0, 0.0, 1.0)]
    e, o, u = m[0]
    for e2, o2, u2 in m[1:]:
        k = 1 - (o * e2 + e * o2)
        e, o, u = (e * e2 + e * u2 + u * e2) / k, (o * o2 + o * u2 + u * o2) / k, u * u2 / k
    r = fusion.fuse(spark.createDataFrame([(1, *x) for x in m], "k int, e double, o double, u double"), ["k"]).first()
    assert (r["e"], r["o"], r["u"]) == pytest.approx((e, o, u))
    r = fusion.fuse(spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0)], "k int, e double, o double, u double"), ["k"]).first()
    assert (r["e"], r["o"], r["u"]) == (0, 0, 1)


def test_sensor_prior_and_beam(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2)], "k int, e double, o double, u double, hits int")
    r = fusion.sensor_prior(df, ["k"]).first()
    assert r["e"] == pytest.approx(1 - 0.95**2)
    e, o, u = fusion.beam_mass(F.lit(2.0), F.lit(1.0))
    r = spark.range(1).select(e.alias("e"), o.alias("o"), u.alias("u")).first()
    assert r["e"] == pytest.approx(1 - math.exp(-1)) and r["o"] == 0


def test_chain_marginals(spark):
    """Beliefs on a tree are the exact marginals."""
    prior = {1: (0.7, 0.3), 2: (0.5, 0.5), 3: (0.2, 0.8)}
    f = [[0.9, 0.1], [0.2, 0.8]]
    total, want = 0, np.zeros((3, 2))
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                p = prior[1][a] * prior[2][b] * prior[3][c] * f[a][b] * f[b][c]
                total += p
                for k, s in enumerate((a, b, c)):
                    want[k, s] += p
    v = spark.createDataFrame([(k, *p) for k, p in prior.items()], "id long, p0 double, p1 double")
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    got = messages.pairwise_bp(v, e, f, rounds=20).toPandas().sort_values("id")[["b0", "b1"]].to_numpy()
    assert np.allclose(got, want / total, atol=1e-3)


def test_octree_against_the_walk(spark):
    rng = np.random.default_rng(3)
    counts = {c: int(rng.integers(1, 40)) for c in rng.integers(0, 512, 200).tolist()}
    rows = [(c, c // 64, c // 8 % 8, c % 8, n) for c, n in counts.items()]
    df = spark.createDataFrame(rows, "cell long, ix long, iy long, iz long, n long")
    got = {r["cell"]: (r["level"], r["leaf_n"]) for r in tiling.octree_leaves(df, 3, 60).collect()}
    for c, x, y, z, _ in rows:
        for level in range(4):
            s = 3 - level
            n = sum(m for _, a, b, d, m in rows if (a >> s, b >> s, d >> s) == (x >> s, y >> s, z >> s))
            if n <= 60 or level == 3:
                assert got[c] == (level, n)
                break


def test_geometry(spark):
    v = lambda *a: [F.lit(float(x)) for x in a]
    centre, radius = g.circumcentre_3d(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0, 0, 1))
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(centre, "xyz")], radius.alias("r"), g.triangle_area(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0)).alias("area"), g.tetra_volume(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)).alias("vol"), g.angle(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0)).alias("angle"), g.ball_inside_box(centre, radius, v(-1, -1, -1), v(2, 2, 2)).alias("inside"), g.ball_meets_box(centre, radius, v(5, 5, 5), v(6, 6, 6)).alias("meets"), g.side_of(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)).alias("side")).first()
    assert (r["x"], r["y"], r["z"]) == (0.5, 0.5, 0.5) and r["r"] == pytest.approx(math.sqrt(0.75))
    assert r["area"] == 0.5 and r["vol"] == pytest.approx(1 / 6) and r["angle"] == pytest.approx(math.pi / 2)
    assert r["inside"] and not r["meets"] and r["side"] == 1


def test_sensor_recovered(spark):
    s, p = np.array([1.0, 2.0, 30.0]), np.random.default_rng(4).random((20, 3)) * 10
    n = (s - p) / np.linalg.norm(s - p, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"k": 0, **{a: p[:, i] for i, a in enumerate("xyz")}, **{f"n{a}": n[:, i] for i, a in enumerate("xyz")}}))
    r = orientation.sensor_by_least_squares(df, ["k"]).first()
    assert [r["sensor_x"], r["sensor_y"], r["sensor_z"]] == pytest.approx(s.tolist(), rel=1e-6)


def test_turning_lines_and_default_sensor(spark):
    xs = [0, 1, 2, 3, 2, 1, 0, 1, 2, 3]
    df = spark.createDataFrame([(0, k, float(x), 0.0, 0.0) for k, x in enumerate(xs)], "sweep long, k long, x double, y double, z double")
    lines = [r["line"] for r in orientation.turning_lines(df, "sweep", ["k"]).orderBy("k").collect()]
    assert lines[0] == 0 and lines[-1] >= 2 and lines == sorted(lines)
    assert orientation.default_sensor(df).first()["z_origin"] == 30.0


def test_thinning_keeps_distance(spark):
    _, df = cloud(spark)
    kept = simplify.thinned(df.withColumn("tile", F.lit(0).cast("long")), 0.2, "pid").toPandas()[["x", "y", "z"]].to_numpy()
    d = ((kept[:, None] - kept[None]) ** 2).sum(2) + 9 * np.eye(len(kept))
    assert 5 < len(kept) < 300 and d.min() > 0.04


def test_facet_weight_and_infinite_costs(spark):
    v = lambda *a: [F.lit(float(x)) for x in a]
    w = energy.facet_weight(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0.3, 0.3, 1), v(0.3, 0.3, -1), 2.0, g.good_shape(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0)))
    a, b = energy.infinite_cell_costs(1, F.lit(1.0))
    r = spark.range(1).select(w.alias("w"), a.alias("a"), b.alias("b")).first()
    cos = math.sqrt(0.18) / math.sqrt(1.18)
    assert r["w"] == pytest.approx(2 * 0.5 * cos + 0.05 * 2) and (r["a"], r["b"]) == (1e8, 0)


def test_files_and_features(spark, tmp_path):
    p, df = cloud(spark, 50)
    ply.write_ply(df.withColumn("tile_id", F.col("pid") % 3), str(tmp_path / "ply"))
    back = ply.read_ply(spark, str(tmp_path / "ply"))
    assert sorted(map(tuple, back.select("tile_id", "pid", "x").collect())) == sorted(map(tuple, df.select(F.col("pid") % 3, "pid", "x").collect()))
    points.write_xyz(df, str(tmp_path / "xyz"))
    assert points.read_xyz(spark, str(tmp_path / "xyz")).count() == 50
    with pytest.raises(ValueError):
        points.read_points(spark, "x", "nothing")
    line = df.limit(1).select(sinks.point_feature(F.col("x"), F.col("y"), pid=F.col("pid")).alias("value")).first()[0]
    assert '"type":"Point"' in line
    made = points.uniform_points(spark, 100, Box((0, 0, 0), (1, 2, 3)), 5).agg(F.max("z"), F.count("*")).first()
    assert made[0] <= 3 and made[1] == 100


def test_las_file(spark, tmp_path):
    import struct

    head = bytearray(227)
    head[:4] = b"LASF"
    head[24], head[25] = 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    head[104] = 0
    struct.pack_into("<HI", head, 105, 20, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    rows = b"".join(struct.pack("<iiiHBBbBH", 100 * k, 200, 300, 7, 0, 2, -3, 0, 9) for k in (1, 2))
    os.makedirs(tmp_path / "las")
    (tmp_path / "las" / "a.las").write_bytes(bytes(head) + rows)
    got = points.read_las(spark, str(tmp_path / "las")).orderBy("x").collect()
    assert [(r["x"], r["y"], r["z"], r["scan_angle"], r["point_source_id"]) for r in got] == [(101.0, 202.0, 3.0, -3.0, 9), (102.0, 202.0, 3.0, -3.0, 9)]


def test_graph_text_and_clique(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1 0.5 0.5\n2 0.1 0.9\n")
    (tmp_path / "e.txt").write_text("1 2 0.1 0.2 0.3 0.4\n")
    v, e = points.read_pairwise_graph(spark, str(tmp_path / "v.txt"), str(tmp_path / "e.txt"), 2)
    r = e.first()
    assert v.count() == 2 and (r["f00"], r["f10"], r["f01"], r["f11"]) == (0.1, 0.2, 0.3, 0.4)
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "b")], "src long, dst long, w string")
    got = {r["id"]: list(r["values"]) for r in messages.clique_values(edges, "w").collect()}
    assert got == {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b"]}


def test_tileset_nests():
    box = [0] * 12
    t = surface.tileset({0: {0: {"box": box}}, 1: {3: {"box": box, "uri": "a.glb"}}, 2: {25: {"box": box}}})
    assert t["root"]["children"][0]["content"]["uri"] == "a.glb" and len(t["root"]["children"][0]["children"]) == 1


def test_streams(spark, tmp_path):
    p, df = cloud(spark, 80)
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pid")))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.tiled_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), Box((0, 0, 0), (1, 1, 1)), 2)
    q = ingest.write_tiles(stream, str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    want = tiling.cell_counts(tiling.tile_points(df, Box((0, 0, 0), (1, 1, 1)), 2)).select("cell", "n")
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("cell").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    q = ingest.running_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 80
    q = ingest.windowed_counts(stream, "ts", "10 seconds", "0 seconds").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.sql("SELECT sum(n) FROM windows").first()[0] <= 80


def test_many_masses_keep_their_evidence(spark):
    """Groups whose products would vanish: as the rule applied in turn, normalised at each step."""
    mass = {"a": (0.5, 0.2, 0.3), "b": (0.2, 0.2, 0.6), "c": (1.0, 0.0, 0.0)}
    rows = [(k, *m) for k, m in mass.items() for _ in range(5000)] + [("d", 1.0, 0.0, 0.0), ("d", 0.0, 1.0, 0.0)]
    got = {r["k"]: (r["e"], r["o"], r["u"]) for r in fusion.fuse(spark.createDataFrame(rows, "k string, e double, o double, u double"), ["k"]).collect()}
    for k, m in mass.items():
        e, o, u = m
        for _ in range(4999):
            a, b, c = e * m[0] + e * m[2] + u * m[0], o * m[1] + o * m[2] + u * m[1], u * m[2]
            e, o, u = (x / (a + b + c) for x in (a, b, c))
        assert got[k] == pytest.approx((e, o, u), abs=1e-9)
    assert got["d"] == (0.0, 0.0, 1.0)


def test_queries_in_blocks(spark):
    rows = [(k, [float(k * 37 % 101), float(k * 53 % 97)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    one, many = (sorted(map(tuple, knn.knn_of_queries(df, df.where("id % 3 = 0"), 4, "id", "v", b).collect())) for b in (2000, 6))
    assert one == many and len(one) == 80
