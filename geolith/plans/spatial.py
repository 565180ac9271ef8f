"""Queries on tiles, exchange, ownership, neighbours and shapes (Q01 to Q15, Q26, Q28, Q29, Q32 to Q35)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.functions.geometry import circumcentre_2d, projection
from geolith.operators import exchange, knn, messages, orientation, pca, surface, tiling
from geolith.plans.views import BOX, CELLS_SQL, DEPTH, KEYS, LEAVES_SQL, LIMIT, MIN_POINTS, POINTS_SQL, SIDE, load, points, tiled

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.octree_leaves(tiling.cell_counts(tiled(spark, sf_dir)), DEPTH, LIMIT)


@query(f"WITH {POINTS_SQL}, f AS (SELECT file, cell FROM t GROUP BY ALL HAVING count(*) >= 3) SELECT cell, ix, iy, iz, count(*) n FROM t SEMI JOIN f USING (file, cell) GROUP BY ALL")
def q01_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.cell_counts(tiled(spark, sf_dir, MIN_POINTS))


@query(f"WITH {LEAVES_SQL} SELECT level, node, n_points, n_cells FROM tl")
def q02_octree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.renumbered(leaves(spark, sf_dir)).select("level", "node", "n_points", "n_cells")


@query(f"WITH {LEAVES_SQL} SELECT tile_id, level, node, count(*) n, min(x) xmin, max(y) ymax FROM t JOIN lf USING (cell) JOIN tl USING (level, node) GROUP BY ALL")
def q03_tile_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = tiling.renumbered(leaves(spark, sf_dir))
    moved = tiling.remap(tiled(spark, sf_dir), leaves(spark, sf_dir), tiles)
    return moved.groupBy("tile_id").agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("y").alias("ymax")).join(tiles.select("tile_id", "level", "node"), "tile_id")


@query(f"WITH {POINTS_SQL} SELECT coalesce(cell, -1) cell, count(*) n, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax FROM t GROUP BY ROLLUP (cell)")
def q04_tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.bounding_boxes(tiled(spark, sf_dir)).withColumn("cell", F.coalesce("cell", F.lit(-1).cast("long")))


EXTREMES_SQL = POINTS_SQL + ", x6 AS (" + " UNION ".join(f"SELECT cell, k1, k2, k3, k4, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {a} {d}, k1, k2, k3, k4) r FROM t) WHERE r = 1" for a in "xyz" for d in ("ASC", "DESC")) + ")"


@query(f"WITH {EXTREMES_SQL} SELECT * FROM x6")
def q05_extreme_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.extreme_points(tiled(spark, sf_dir), KEYS)


@query(f"WITH {EXTREMES_SQL} SELECT cell, count(*) n_own, CAST((SELECT count(*) FROM x6) - count(*) AS BIGINT) n_foreign FROM x6 GROUP BY cell")
def q06_broadcast_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.broadcast_extremes(tiling.extreme_points(tiled(spark, sf_dir), KEYS))


@query(f"""WITH {POINTS_SQL}, n AS (SELECT cell, count(*) v, count(DISTINCT k1) f, count(DISTINCT k2) c FROM t GROUP BY cell)
SELECT cell, v, f, c, CAST(coalesce(sum(v) OVER w, 0) AS BIGINT) v_offset, CAST(coalesce(sum(f) OVER w, 0) AS BIGINT) f_offset, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) c_offset
FROM n WINDOW w AS (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q07_global_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tiled(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("v"), F.countDistinct("k1").alias("f"), F.countDistinct("k2").alias("c"))
    return exchange.exclusive_offsets(n, ["v", "f", "c"])


@query(f"""WITH {POINTS_SQL}, o AS (SELECT cell, coalesce(sum(count(*)) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) v_offset FROM t GROUP BY cell)
SELECT cell, k1, k2, k3, k4, CAST(row_number() OVER (PARTITION BY cell ORDER BY k1, k2, k3, k4) - 1 AS BIGINT) lid,
       CAST(v_offset + row_number() OVER (PARTITION BY cell ORDER BY k1, k2, k3, k4) - 1 AS BIGINT) gid FROM t JOIN o USING (cell)""")
def q07b_global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiled(spark, sf_dir)
    offsets = exchange.exclusive_offsets(t.groupBy("cell").agg(F.count("*").alias("v")), ["v"])
    return exchange.global_ids(t.select("cell", *KEYS), offsets, "v_offset", KEYS)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the first two quantities of a cell go to the cell below on x, unless their return flag says they went before."""
    t = tiled(spark, sf_dir)
    out = t.where((F.pmod("x", F.lit(8.0)) < 2) & (F.col("ix") > 0)).select((F.col("cell") - SIDE * SIDE).alias("dst"), *KEYS, "flag")
    return exchange.send_once(out, out.where("flag = 'A'"), KEYS)


MESSAGES_SQL = POINTS_SQL + """, o AS (SELECT cell - 64 AS dst, k1, k2, k3, k4, flag FROM t WHERE x % 8 < 2 AND ix > 0),
m AS (SELECT DISTINCT dst, k1, k2, k3, k4 FROM o EXCEPT SELECT dst, k1, k2, k3, k4 FROM o WHERE flag = 'A')"""


@query(f"WITH {MESSAGES_SQL} SELECT dst, count(*) n, sum(k1)::BIGINT k1_sum FROM m GROUP BY dst")
def q08_send_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("n"), F.sum("k1").alias("k1_sum"))


@query(f"WITH {MESSAGES_SQL}, c AS (SELECT cell, count(*) n FROM t GROUP BY cell) SELECT cell, n, cell IN (SELECT dst FROM m) AS touched FROM c")
def q09_touched_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.touched(tiled(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n")), _messages(spark, sf_dir))


ADJACENT_SQL = CELLS_SQL + ", e AS (SELECT a.cell a, b.cell b FROM c a JOIN c b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1)"


def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.adjacency(tiling.cell_counts(tiled(spark, sf_dir)), tiling.neighbour_cells(SIDE))


@query(f"WITH {ADJACENT_SQL} SELECT a, b FROM e")
def q10_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacent(spark, sf_dir)


@query(f"WITH {ADJACENT_SQL} SELECT (SELECT count(*) FROM e) n_edges, (SELECT count(*) FROM (SELECT a, b FROM e EXCEPT ALL SELECT b, a FROM e)) n_asymmetric")
def q10b_adjacency_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adjacent(spark, sf_dir)
    one = F.lit(1).alias("one")
    return e.agg(F.count("*").alias("n_edges"), one).join(exchange.asymmetric(e).agg(F.count("*").alias("n_asymmetric"), one), "one").drop("one")


@query(f"""WITH {POINTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY k3 ORDER BY k1, k2, k4, cell) - 1 r FROM t),
s AS (SELECT k3, r // 4 g, list(cell ORDER BY r) owners FROM r GROUP BY ALL HAVING count(*) = 4),
k AS (SELECT list_min(owners) main_tile, (owners[1] = 100)::INT + (owners[2] = 100)::INT + (owners[3] = 100)::INT + (owners[4] = 100)::INT n100, 1 + (owners[2] = owners[1])::INT + (owners[3] = owners[1])::INT + (owners[4] = owners[1])::INT n, owners[1] AS first_tile FROM s)
SELECT main_tile, CASE n WHEN 4 THEN 'local' ELSE 'mixed' END AS kind, CASE n100 WHEN 4 THEN 'local' WHEN 0 THEN 'foreign' ELSE 'mixed' END AS kind_100,
       main_tile = first_tile AS first_is_main, count(*) n_cells FROM k GROUP BY ALL""")
def q11_simplex_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiled(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("k3").orderBy("k1", "k2", "k4", "cell")) - 1)
    g = t.groupBy("k3", F.floor(F.col("r") / 4).alias("g")).agg(F.sort_array(F.collect_list(F.struct("r", "cell"))).alias("s")).where("size(s) = 4")
    o = g.select(F.col("s.cell").alias("owners"))
    o = o.select(exchange.main_tile(F.col("owners")).alias("main_tile"), exchange.kind(F.col("owners"), F.col("owners")[0]).alias("kind"), exchange.kind(F.col("owners"), F.lit(100)).alias("kind_100"), F.col("owners")[0].alias("f"))
    return o.groupBy("main_tile", "kind", "kind_100", (F.col("main_tile") == F.col("f")).alias("first_is_main")).agg(F.count("*").alias("n_cells"))


KNN_SQL = """q AS (SELECT vec_id AS query, embedding::DOUBLE[] qv FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query, vec_id, pow(list_distance(qv, embedding::DOUBLE[]), 2) d2 FROM q JOIN embeddings ON vec_id <> query),
nn AS (SELECT query, vec_id, d2, row_number() OVER (PARTITION BY query ORDER BY round(d2, 9), vec_id) AS rank FROM d QUALIFY rank <= 10)"""


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return knn.knn_of_queries(e, e.where("vec_id % 100 = 0"), 10, "vec_id", "embedding")


@query(f"WITH {KNN_SQL} SELECT query, rank, vec_id, round(d2, 4) d2 FROM nn")
def q12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir).select("query", "rank", "vec_id", F.round("d2", 4).alias("d2"))


@query(f"""WITH {POINTS_SQL}, s AS (SELECT cell, count(*) n, sum(x) sx, sum(z) sz, sum(x * x) sxx, sum(z * z) szz, sum(x * z) sxz FROM t GROUP BY cell),
m AS (SELECT cell, n, sxx - sx * sx / n a, szz - sz * sz / n b, sxz - sx * sz / n c FROM s),
e AS (SELECT cell, n, greatest(sqrt((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c)), 1e-7) s1, greatest(sqrt(greatest((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 0)), 1e-7) s2 FROM m),
f AS (SELECT *, (s1 - s2) / (s1 + s2) a1, 2 * s2 / (s1 + s2) a2 FROM e)
SELECT cell, n, round(s1, 6) s1, round(s2, 6) s2, round(a1, 6) a1, round(a2, 6) a2, round(CASE WHEN a1 > 0 AND a2 > 0 THEN -(a1 * ln(a1) + a2 * ln(a2)) END, 6) entropy FROM f""")
def q13_planar_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pca.planar_shape(tiled(spark, sf_dir), "x", "z")
    return s.select("cell", "n", *[F.round(c, 6).alias(c) for c in ("s1", "s2", "a1", "a2", "entropy")])


@query("""WITH o AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) tx, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) prev FROM events),
l AS (SELECT *, CAST(sum(CASE WHEN event_type <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) line FROM o),
g AS (SELECT user_id, line, count(*) n, first(tx ORDER BY ts, event_id) fx, last(tx ORDER BY ts, event_id) lx, first(value ORDER BY ts, event_id) fy, last(value ORDER BY ts, event_id) ly, max(value) top FROM l GROUP BY ALL),
h AS (SELECT *, sqrt((lx - fx) * (lx - fx) * 1.0::DOUBLE + (ly - fy) * (ly - fy)) size FROM g)
SELECT user_id, line, n, round(CASE WHEN size > 0 THEN (lx - fx) / size ELSE 0 END, 6) + 0.0::DOUBLE dir_x, round(CASE WHEN size > 0 THEN (ly - fy) / size ELSE 0 END, 6) + 0.0::DOUBLE dir_y, round(top + 2 * size, 4) sensor_z FROM h""")
def q14_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("tx", F.unix_timestamp("ts"))
    lined = orientation.scan_lines(e, "user_id", ["ts", "event_id"], "event_type")
    g = orientation.line_geometry(lined, "user_id", ["ts", "event_id"], "tx", "value", "value")
    return g.select("user_id", "line", "n", F.round("dir_x", 6).alias("dir_x"), F.round("dir_y", 6).alias("dir_y"), F.round("sensor_z", 4).alias("sensor_z"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
c AS (SELECT *, ((e[4] - e[7]) * e[1] + (e[5] - e[8]) * e[2] + (e[6] - e[9]) * e[3]) / (e[1] * e[1] + e[2] * e[2] + e[3] * e[3]) coef FROM v)
SELECT vec_id, round(coef, 6) coef, CASE WHEN coef < 0 THEN -e[1] ELSE e[1] END nx, CASE WHEN coef < 0 THEN -e[2] ELSE e[2] END ny, CASE WHEN coef < 0 THEN -e[3] ELSE e[3] END nz FROM c""")
def q15_flipped_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: [F.col("embedding")[i].cast("double") for i in range(3 * k, 3 * k + 3)]
    normal, origin, point = part(0), part(1), part(2)
    out = pca.flipped(normal, point, origin)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(projection(origin, point, normal), 6).alias("coef"), *[c.alias(f"n{a}") for c, a in zip(out, "xyz")])


@query(f"WITH {KNN_SQL} SELECT DISTINCT least(query, vec_id) src, greatest(query, vec_id) dst FROM nn")
def q26_canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.canonical_edges(nearest(spark, sf_dir).select(F.col("query").alias("src"), F.col("vec_id").alias("dst")))


@query(f"WITH {POINTS_SQL} SELECT DISTINCT cell, x, z, CAST(dense_rank() OVER (PARTITION BY cell ORDER BY x, z) - 1 AS BIGINT) vertex_index FROM t")
def q28_vertex_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.indexed_mesh(tiled(spark, sf_dir).select("cell", "x", "z"), "cell", ["x", "z"]).distinct()


@query(f"""WITH {CELLS_SQL}, b AS (SELECT n, ix * 2 + 1 cx, iy * 2 + 1 cy, iz * 2 + 1 cz FROM c),
k AS (SELECT n, CAST((cx // 8) * 4 + (cy // 8) * 2 + cz // 8 AS BIGINT) c1, CAST((cx // 4 % 2) * 4 + (cy // 4 % 2) * 2 + cz // 4 % 2 AS BIGINT) c2, CAST((cx // 2 % 2) * 4 + (cy // 2 % 2) * 2 + cz // 2 % 2 AS BIGINT) c3 FROM b)
SELECT CAST(level AS BIGINT) AS level, CAST(code AS BIGINT) code, count(*) n_tiles, CAST(sum(n) AS BIGINT) n_points FROM (
  SELECT 0 AS level, 0 code, n FROM k UNION ALL SELECT 1, c1, n FROM k UNION ALL SELECT 2, c1 * 8 + c2, n FROM k UNION ALL SELECT 3, (c1 * 8 + c2) * 8 + c3, n FROM k) GROUP BY ALL""")
def q29_lod_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tiling.cell_counts(tiled(spark, sf_dir)).select("n", *[(F.col(f"i{a}") * 2 + 1).cast("double").alias(f"c{a}") for a in "xyz"])
    return surface.lod_rollup(surface.lod_codes(c, (0.0, 0.0, 0.0), 16.0, DEPTH), DEPTH)


@query(f"""WITH RECURSIVE {ADJACENT_SQL}, r AS (SELECT min(cell) id, 0 step FROM c UNION SELECT b, step + 1 FROM r JOIN e ON a = id WHERE step < 3)
SELECT id, CAST(min(step) AS BIGINT) step FROM r GROUP BY id""")
def q32_k_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adjacent(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    start = tiled(spark, sf_dir).agg(F.min("cell").alias("id"))
    return messages.k_ring(e, start, 3)


@query(f"""WITH {POINTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k1, k2, k3, k4) - 1 r FROM t),
g AS (SELECT cell, r // 3 g, list(x ORDER BY r) x, list(z ORDER BY r) z FROM r GROUP BY ALL HAVING count(*) = 3),
d AS (SELECT cell, g, x[1] ax, z[1] az, x[2] - x[1] ux, z[2] - z[1] uz, x[3] - x[1] vx, z[3] - z[1] vz FROM g),
f AS (SELECT *, 2.0 * (ux * vz - uz * vx) d, ux * ux + uz * uz uu, vx * vx + vz * vz vv FROM d WHERE ux * vz <> uz * vx)
SELECT cell, CAST(g AS BIGINT) g, round(ax + (vz * uu - uz * vv) / d, 6) cx, round(az + (ux * vv - vx * uu) / d, 6) cz,
       round(sqrt(((vz * uu - uz * vv) / d) * ((vz * uu - uz * vv) / d) + ((ux * vv - vx * uu) / d) * ((ux * vv - vx * uu) / d)), 6) radius FROM f""")
def q33_circumcentres(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiled(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(*KEYS)) - 1)
    g = t.groupBy("cell", F.floor(F.col("r") / 3).alias("g")).agg(F.sort_array(F.collect_list(F.struct("r", "x", "z"))).alias("s")).where("size(s) = 3")
    at = lambda k: [F.col("s")[k]["x"], F.col("s")[k]["z"]]
    centre, radius = circumcentre_2d(at(0), at(1), at(2))
    return g.select("cell", "g", F.round(centre[0], 6).alias("cx"), F.round(centre[1], 6).alias("cz"), F.round(radius, 6).alias("radius")).where("cx is not null")


@query(f"""WITH {POINTS_SQL}, b AS (SELECT cell, CAST(min(x) AS BIGINT) a, CAST(max(x) AS BIGINT) b, CAST(min(z) AS BIGINT) c, CAST(max(z) AS BIGINT) d FROM t GROUP BY cell)
SELECT cell, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || a || ',' || c || '],[' || b || ',' || c || '],[' || b || ',' || d || '],[' || a || ',' || d || '],[' || a || ',' || c || ']]]}},"properties":{{"tile":' || cell || '}}}}' AS feature FROM b""")
def q34_tile_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolith.sources.sinks import box_feature

    b = tiling.bounding_boxes(tiled(spark, sf_dir)).where("cell is not null")
    return b.select("cell", box_feature(*[F.col(c).cast("long") for c in ("xmin", "xmax", "zmin", "zmax")], F.col("cell")).alias("feature"))


@query(f"""WITH {POINTS_SQL}, s AS (SELECT k1 AS seed, x sx, z sz FROM (SELECT * FROM t WHERE k4 = 1 ORDER BY k1, k2, k3 LIMIT 20)),
a AS (SELECT x, z, arg_min(seed, (x - sx) * (x - sx) + (z - sz) * (z - sz) + seed * 1e-9) seed FROM (SELECT DISTINCT k1, k2, k3, k4, x, z FROM t), s GROUP BY k1, k2, k3, k4, x, z)
SELECT seed, count(*) n, round(sum(x) / count(*), 6) x, round(sum(z) / count(*), 6) z FROM a GROUP BY seed""")
def q35_relaxation_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolith.operators.simplify import relaxation_step

    t = tiled(spark, sf_dir)
    seeds = t.where("k4 = 1").orderBy("k1", "k2", "k3").limit(20).select(F.col("k1").alias("seed"), F.col("x").alias("sx"), F.col("z").alias("sz"))
    return relaxation_step(t, seeds, ["x", "z"]).select("seed", "n", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


__all__ = ["BOX", "ORACLE_SQL", "QUERIES", "points"]
