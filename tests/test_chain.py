"""The chain from points to a surface, factor graphs, mesh files, levels of detail, and tables about cells."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geolith.operators import cells as volume
from geolith.operators import factors, labelling, lod, scoring, surface, tiling, triangulation
from geolith.plans import evidence
from geolith.plans.reconstruction import Settings, load, mesh, name, reconstruct, save
from geolith.schema import Box
from geolith.sources import meshes


@pytest.fixture(scope="module")
def shell(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(160, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    p, o = v + rng.normal(scale=0.005, size=v.shape), v * 5
    df = spark.createDataFrame(pd.DataFrame({"pid": range(len(p))} | {a: p[:, i] for i, a in enumerate("xyz")} | {f"{a}_origin": o[:, i] for i, a in enumerate("xyz")}))
    return p, df, reconstruct(df, Settings(Box((-1.5,) * 3, (1.5,) * 3), depth=1, max_ppt=60, lambda_=0.3, rat_ray_sample=0.5))


def test_surface_encloses_the_shell(shell):
    p, _, r = shell
    vertices, faces = mesh(r)
    at = {v["pid"]: np.array([v["x"], v["y"], v["z"]]) for v in vertices.collect()}
    edges, vol = {}, 0.0
    for f in faces.collect():
        a, b, c = f["face"]
        vol += np.dot(at[a], np.cross(at[b], at[c])) / 6
        for e in ((a, b), (b, c), (c, a)):
            edges[e] = edges.get(e, 0) + 1
    assert all(edges.get((b, a)) == n for (a, b), n in edges.items())  # closed, and turned one way
    assert 0.85 * 4 / 3 * math.pi < vol < 4 / 3 * math.pi * 1.02
    assert r.log["sent"][-1] == 0 and r.log["agreement"][-1][1] == 0


def test_save_and_load(spark, shell, tmp_path):
    _, _, r = shell
    save(r, str(tmp_path / "run"))
    back = load(spark, str(tmp_path / "run"))
    assert back.facets.count() == r.facets.count() and mesh(back)[1].exceptAll(mesh(r)[1]).count() == 0


def test_tree_steps(spark):
    for level in (1, 2, 3):
        first, side = tiling.nodes_up_to(level - 1), 1 << level
        rows = [(first + (z * side + y) * side + x, x, y, z) for x in range(side) for y in range(side) for z in range(side)]
        df = spark.createDataFrame(rows, "node long, x long, y long, z long")
        base, half = tiling.nodes_up_to(level - 2) if level > 1 else 0, side // 2
        for r in df.select("*", tiling.parent_node(F.col("node"), level).alias("up"), tiling.is_ancestor(F.lit(0), 0, F.col("node"), level).alias("root")).collect():
            assert r["up"] == base + ((r["z"] // 2) * half + r["y"] // 2) * half + r["x"] // 2 and r["root"]


def test_tiles_hold_the_whole_triangulation(shell):
    p, df, r = shell
    want = triangulation.single_tile(pd.DataFrame({"pid": range(len(p))} | {a: p[:, i] for i, a in enumerate("xyz")}), 1e-6)
    got = triangulation.main_cells(r.cells).select("pids").collect()
    assert sorted(tuple(c["pids"]) for c in got) == sorted(map(tuple, want.tolist()))
    assert triangulation.missing_in_tiles(r.cells).count() == 0
    assert volume.shared_counts(r.cells).where("n <> n_back").count() == 0
    n = volume.counts_by_tile(r.cells, r.points).agg(F.sum("n_vertices"), F.sum("n_facets"), F.sum("n_cells")).first()

    faces = {f for c in want.tolist() for f in itertools.combinations(c, 3)}
    assert (n[0], n[1], n[2]) == (len(p), len(faces), len(want))


def test_tiles_are_not_brought_to_one_task(spark, shell):
    """Tiles have few bytes and much work: each task has few of them, whatever Spark may coalesce."""
    _, _, r = shell
    places = r.points.select("tile", F.col("tile").alias("owner"), "pid", "x", "y", "z").checkpoint()
    cells = triangulation.local_delaunay(places, 1e-6).select("tile", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({c["tile"] for c in cells}) > 2 and len({c["task"] for c in cells}) > len({c["tile"] for c in cells}) // 2


def test_crown_and_active_cells(spark, shell):
    p, _, r = shell
    boxes = tiling.bounding_boxes(r.points, "tile").where("tile is not null").drop("n")
    local = triangulation.local_delaunay(r.points.select("tile", F.col("tile").alias("owner"), "pid", "x", "y", "z"), 1e-6)
    real = local.where("not infinite").withColumn("cell", F.concat_ws("-", F.transform("pids", lambda x: x.cast("string"))))
    balls = volume.spheres(scoring.cell_corners(real.select("tile", "cell", "pids"), r.points.select("pid", "x", "y", "z")))
    done = volume.finished_cells(balls, boxes)
    open_, closed = volume.crown(done.select("tile", "pids", "inside"), local.where("infinite"))
    assert open_.count() + closed.count() >= len(p)
    # A finished cell is a cell of the whole triangulation.
    whole = {tuple(c["pids"]) for c in triangulation.main_cells(r.cells).select("pids").collect()}
    assert all(tuple(c["pids"]) in whole for c in done.where("inside").collect())
    got = {(c["tile"], tuple(c["pids"]), c["other"]) for c in volume.active_pairs(balls, boxes, 0.5).collect()}
    b = {x["tile"]: x for x in boxes.collect()}
    want = set()
    for c in balls.collect():
        for t, x in b.items():
            gap = sum(max(x[f"{a}min"] - c[f"c{a}"], 0, c[f"c{a}"] - x[f"{a}max"]) ** 2 for a in "xyz")
            if t != c["tile"] and gap < c["radius"] ** 2:
                want.add((c["tile"], tuple(c["pids"]), t))
    assert got == want
    star = volume.simplified_star(r.cells.select("tile", F.explode(F.arrays_zip("pids", "owners")).alias("z")).select("tile", F.col("z.owners").alias("owner"), F.col("z.pids").alias("pid")).distinct(), r.cells)
    assert star.where("owner = tile").count() == len(p)
    _, edges = volume.merge_graph(r.cells, boxes)
    assert edges.exceptAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).count() == 0


def test_samples_lie_in_their_cell(spark):
    p = [{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 1.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 1.0, "z": 0.0}, {"x": 0.0, "y": 0.0, "z": 1.0}]
    df = spark.createDataFrame([("a", [(q["x"], q["y"], q["z"]) for q in p])], "cell string, p array<struct<x: double, y: double, z: double>>")
    got = scoring.samples(df, 200).toPandas()
    assert (got[["x", "y", "z"]].to_numpy() >= 0).all() and (got[["x", "y", "z"]].sum(axis=1) <= 1 + 1e-12).all()
    assert np.allclose(got[["x", "y", "z"]].mean(), 0.25, atol=0.05) and np.allclose(got.loc[got["sample"] == 0, ["x", "y", "z"]], 0.25)


def test_rays_cross_the_cells_before_their_point(spark):
    cube = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
    tets = [[cube[i] for i in t] for t in ((0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7))]
    df = spark.createDataFrame([(0, str(k), t) for k, t in enumerate(tets)], "tile long, cell string, p array<struct<x: double, y: double, z: double>>")
    rays = spark.createDataFrame([(0, 1, 0.9, 0.8, 0.7, 0.9, 0.8, 9.0, 0.1), (0, 2, 5.0, 5.0, 5.0, 5.0, 5.0, 9.0, 0.1)], "tile long, pid long, x double, y double, z double, sx double, sy double, sz double, sigma double")
    got = scoring.ray_masses(df, rays).toPandas()
    assert len(got) >= 1 and (got["o"] == 0).all() and (got["e"] > 0).all()


def test_factor_graph(spark, tmp_path):
    text = "3\n### 0\n1\n0\n2\n2\n0 0.7\n1 0.3\n### 1\n2\n0 1\n2 2\n4\n0 0.9\n1 0.2\n2 0.1\n3 0.8\n### 2\n3\n1 2 3\n2 2 2\n8\n" + "".join(f"{k} {0.1 + 0.1 * k}\n" for k in range(8))
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.fg").write_text(text)
    priors, f = factors.read_factor_graph(spark, str(tmp_path / "g"))
    got = {r["id"]: r["belief"] for r in factors.factor_bp(priors, f, tolerance=1e-9).collect()}
    want, total = np.zeros((4, 2)), 0.0
    for a, b, c, d in itertools.product((0, 1), repeat=4):
        w = (0.7, 0.3)[a] * (0.9, 0.2, 0.1, 0.8)[a + 2 * b] * (0.1 + 0.1 * (b + 2 * c + 4 * d))
        total += w
        for k, s in enumerate((a, b, c, d)):
            want[k, s] += w
    assert np.allclose([got[k] for k in range(4)], want / total, atol=1e-6)
    best = {r["id"]: r["belief"] for r in factors.factor_bp(priors, f, tolerance=1e-9, largest=True).collect()}
    top = max(itertools.product((0, 1), repeat=4), key=lambda s: (0.7, 0.3)[s[0]] * (0.9, 0.2, 0.1, 0.8)[s[0] + 2 * s[1]] * (0.1 + 0.1 * (s[1] + 2 * s[2] + 4 * s[3])))
    assert tuple(int(np.argmax(best[k])) for k in range(4)) == top
    with pytest.raises(ValueError):
        factors.parse_factor_graph("2\n### 0\n1\n0\n2\n1\n0 1\n")


def test_cut_graph_text(spark):
    cells = spark.createDataFrame([(0, 3.0, 1.0), (1, 0.0, 2.0)], "gid long, cost0 double, cost1 double")
    facets = spark.createDataFrame([(0, 1, 0.5)], "a long, b long, coef double")
    lines = factors.graph_text(cells, facets, 2)
    assert "2 0 1 0.500000 0" in [r[0] for r in lines.collect()]
    c, f = factors.read_cut_graph(lines)
    assert sorted((r["cell"], r["label"]) for r in labelling.cut_tiles(c, f).collect()) == [(0, 1), (1, 0)]
    assert factors.graph_text(cells, facets, 0).count() == 3 and factors.graph_text(cells, facets, 1).count() == 5
    with pytest.raises(ValueError):
        factors.graph_text(cells, facets, 7)


def test_tiles_that_share_a_cell_agree(spark):
    """A shared cell that one tile wants empty and the other, more strongly, occupied."""
    cells = spark.createDataFrame([(0, "s", [0, 1], 0.5, 0.5), (0, "a", [0], 1.0, 0.0), (1, "s", [0, 1], 0.5, 0.5), (1, "b", [1], 0.0, 3.0)], "tile long, cell string, owners array<long>, cost0 double, cost1 double")
    facets = spark.createDataFrame([(0, "a", "s", 0.6), (1, "b", "s", 1.5)], "tile long, a string, b string, coef double")
    labels, _, log = labelling.agree(cells, facets, 0.3, 20)
    got = {(r["tile"], r["cell"]): r["label"] for r in labels.collect()}
    assert log[-1][1] == 0 and got[0, "s"] == got[1, "s"] == 0 and got[0, "a"] == 1 and got[1, "b"] == 0


@pytest.fixture(scope="module")
def ball(spark):
    """Points in eight tiles, some at one place, and the cells of all tiles."""
    rng = np.random.default_rng(5)
    p = rng.random((400, 3))
    p[200:205] = p[:5]
    tile = (np.floor(p * 2) @ [4, 2, 1]).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"pid": rng.permutation(400), "tile": tile} | {a: p[:, i] for i, a in enumerate("xyz")}))
    extremes = tiling.extreme_points(df, ["pid"], "tile").select("pid")
    return df, *triangulation.distributed_delaunay(df, extremes, 1e-6, centres=True)


def test_tiles_add_points_to_the_cells_they_have(spark, ball):
    df, cells, sent = ball
    one = {tuple(c) for c in triangulation.single_tile(df.toPandas(), 1e-6).tolist()}
    rows = triangulation.main_cells(cells).collect()
    assert len(sent) > 2 and len(rows) == len(one) and {tuple(r["pids"]) for r in rows} == one
    p = df.toPandas().set_index("pid")[["x", "y", "z"]]
    assert all(np.allclose(p.loc[r["pids"]].mean(), [r["cx"], r["cy"], r["cz"]]) for r in rows[::50])
    assert triangulation.missing_in_tiles(cells).count() == 0


def test_tiles_agree_alike_by_facet_tables_and_by_meshes(spark, ball):
    own = ball[1].where(F.array_contains("owners", F.col("tile")))
    costs = evidence.scored(own)
    found, _, log = labelling.agree_on(labelling.mesh_problem(costs, 0.1), 0.2, 15)
    plain, _, same = labelling.agree(costs.withColumn("cell", name(F.col("pids"))).drop("pids"), evidence.cell_facets(own, 0.1), 0.2, 15)
    assert log == same and log[0][1] > 0
    assert sorted((r["tile"], "-".join(map(str, r["cell"])), r["label"]) for r in found.collect()) == sorted((r["tile"], r["cell"], r["label"]) for r in plain.collect())


def test_surface_of_a_cut_is_that_of_its_facet_table(spark, ball):
    cells = triangulation.local_delaunay(ball[0].withColumns({"tile": F.lit(0).cast("long"), "owner": F.lit(0).cast("long")}), 1e-6, centres=True)
    cut = labelling.cut_meshes(evidence.scored(cells), 0.1).checkpoint()
    plain = labelling.cut_tiles(evidence.scored(cells).withColumn("cell", name(F.col("pids"))).drop("pids", "owners"), evidence.cell_facets(cells, 0.1)).checkpoint()
    assert {("-".join(map(str, r["pids"])), r["label"]) for r in cut.collect()} == {(r["cell"], r["label"]) for r in plain.collect()}
    sides = triangulation.facet_table(cells).select("facet", name(F.col("cells")[0]).alias("a"), F.when(F.size("cells") > 1, name(F.get("cells", F.lit(1)))).alias("b"))
    want = sorted(tuple(r["facet"]) for r in surface.surface_facets(sides, plain).collect())
    assert want and sorted(tuple(p for i, p in enumerate(r["pids"]) if i != k) for r in cut.collect() for k in r["open"]) == want


def test_cloud_files_convert(spark, tmp_path):
    p = pd.DataFrame({"x": [0.123, 2.345], "y": [4.567, 6.789], "z": [8.901, 0.123]})
    for kind in ("ply", "pcd", "xyz", "a3d"):
        data = meshes.cloud_bytes(p, kind)
        assert np.allclose(meshes.parse_cloud(data, kind)[["x", "y", "z"]], p)
        assert np.allclose(meshes.parse_cloud(meshes.convert(data, kind, "xyz"), "xyz"), p)
    moved = meshes.parse_cloud(meshes.convert(b"1 2 3 0 0 1\n", "npts", "xyz", reach=2.0), "xyz")
    assert moved.to_numpy().tolist() == [[1, 2, 5]]
    stl = b"solid a\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid\n"
    assert len(meshes.parse_cloud(stl, "stl")) == 3
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.xyz").write_bytes(meshes.cloud_bytes(p, "xyz"))
    assert meshes.read_clouds(spark, str(tmp_path / "c"), "xyz").count() == 2
    with pytest.raises(ValueError):
        meshes.parse_cloud(b"", "zzz")


def test_levels_and_earth(spark):
    faces = [(k % 8, [(k * 0.01, 0.0, 0.0), (k * 0.01 + 1, 0.0, 0.0), (k * 0.01, 1.0, 0.0)]) for k in range(64)]
    df = spark.createDataFrame(faces, "code1 long, corners array<struct<x: double, y: double, z: double>>")
    levels = lod.merged_levels(df, 1, 0.5, target=10)
    assert levels[0].count() == 64 and 0 < levels[1].count() < 64 and [r["node"] for r in levels[1].select("node").distinct().collect()] == [0]
    lon, lat = lod.lambert93_to_geographic(F.lit(700000.0), F.lit(6600000.0))
    x, y, z = lod.geocentric(lon, lat, F.lit(0.0))
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat"), F.sqrt(x * x + y * y + z * z).alias("r")).first()
    assert r["lon"] == pytest.approx(3.0, abs=1e-9) and r["lat"] == pytest.approx(46.5, abs=1e-8) and 6.356e6 < r["r"] < 6.3782e6
    lon, lat = lod.lambert93_to_geographic(F.lit(652381.0), F.lit(6862047.0))  # Paris
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert r["lon"] == pytest.approx(2.35, abs=0.01) and r["lat"] == pytest.approx(48.857, abs=0.01)
    move = np.eye(4)
    move[:3, 3] = [1, 2, 3]
    tree = lod.finalised({"root": {"transform": move.T.ravel().tolist(), "children": [{"transform": move.T.ravel().tolist()}]}})
    assert np.allclose(tree["root"]["children"][0]["transform"], np.eye(4).ravel())


def test_soup_and_csv(spark, shell):
    _, _, r = shell
    main = triangulation.main_cells(r.cells)
    corners = scoring.cell_corners(main.select("tile", "cell", "pids"), r.points.select("pid", "x", "y", "z"))
    parts = meshes.soup(corners, most=50).collect()
    from geolith.sources.ply import read_elements

    assert sum(len(read_elements(bytes(p["content"]))["face"]) for p in parts) == main.count()
    t = meshes.csv_tables(main, r.points.select("pid", "tile", "x", "y", "z"))
    assert t["cells"].count() == main.count() and t["vertices"].first()["wkt"].startswith("POINT Z(")
