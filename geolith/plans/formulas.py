"""Queries on formulas and small graph steps that larger ones rest on (Q36 to Q45)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geometry as g
from geolith.operators import energy, fusion, messages, orientation, surface, tiling
from geolith.plans.views import BOX, CELLS_SQL, KEYS, LIMIT, POINTS_SQL, load, points, tiled
from geolith.sources import sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {POINTS_SQL} SELECT k1, k2, k3, k4, round(x - 0.0, 6) x, round(y - 0.0, 6) y, z - 0.0::DOUBLE z, round(x + 200.0 * 0.6, 6) x_origin, round(y + 200.0 * 0.0, 6) y_origin, round(z + 200.0 * 0.8, 6) z_origin FROM p""")
def q36_recentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.lit(0.8)})
    out = orientation.recentred(p, BOX)
    names = ["x", "y", "z", "x_origin", "y_origin", "z_origin"]
    return out.select(*KEYS, *[F.round(n, 6).alias(n) for n in names])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) l_linenumber, round(e / (e + u), 8) e, round(u / (e + u), 8) u FROM (
SELECT *, 1 - e u FROM (SELECT *, CASE WHEN l_tax >= 0.02 THEN 1 - exp(-abs(l_tax - 0.02) / 0.1) ELSE 0 END e FROM lineitem))""")
def q37_beam_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "lineitem")
    e, _, u = fusion.beam_mass(F.col("l_tax") - 0.02, F.lit(0.05))
    return t.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(e, 8).alias("e"), F.round(u, 8).alias("u"))


@query("""WITH c AS (SELECT l_orderkey k, max(l_discount) * 4 e, max(l_tax) * 4 o, count(*) hits FROM lineitem GROUP BY 1), m AS (SELECT *, 1 - e - o u, pow(0.95::DOUBLE, hits) q FROM c)
SELECT k, round((e * (1 - q) + e * q + u * (1 - q)) / (1 - o * (1 - q)), 8) e, round(o * q / (1 - o * (1 - q)), 8) o, round(u * q / (1 - o * (1 - q)), 8) u FROM m""")
def q38_sensor_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_discount") * 4).alias("e"), (F.max("l_tax") * 4).alias("o"), F.count("*").alias("hits"))
    out = fusion.sensor_prior(c.withColumn("u", 1 - F.col("e") - F.col("o")), ["k"])
    return out.select("k", *[F.round(n, 8).alias(n) for n in ("e", "o", "u")])


def corners() -> list[list]:
    return [[F.col("embedding")[3 * k + i].cast("double") for i in range(3)] for k in range(4)]


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings),
d AS (SELECT vec_id, e[4] - e[1] a1, e[5] - e[2] a2, e[6] - e[3] a3, e[7] - e[1] b1, e[8] - e[2] b2, e[9] - e[3] b3, e[10] - e[1] c1, e[11] - e[2] c2, e[12] - e[3] c3 FROM v),
x AS (SELECT *, a2 * b3 - a3 * b2 n1, a3 * b1 - a1 * b3 n2, a1 * b2 - a2 * b1 n3, b2 * c3 - b3 * c2 m1, b3 * c1 - b1 * c3 m2, b1 * c2 - b2 * c1 m3 FROM d),
y AS (SELECT *, a1 * m1 + a2 * m2 + a3 * m3 det, a1 * a1 + a2 * a2 + a3 * a3 aa, b1 * b1 + b2 * b2 + b3 * b3 bb FROM x)
SELECT vec_id, round(0.5 * sqrt(n1 * n1 + n2 * n2 + n3 * n3), 7) area, round(abs(det) / 6.0, 7) volume, CASE WHEN det > 0 THEN 1.0::DOUBLE WHEN det < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END side,
round(acos((a1 * b1 + a2 * b2 + a3 * b3) / (sqrt(aa) * sqrt(bb))), 7) angle, round(ln(1 + abs(det) / 6.0) * 2.0 * 5.0, 7) first_step FROM y""")
def q39_simplex_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = corners()
    volume = g.tetra_volume(a, b, c, d)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(g.triangle_area(a, b, c), 7).alias("area"), F.round(volume, 7).alias("volume"), g.side_of(a, b, c, d).alias("side"), F.round(g.angle(a, b, c), 7).alias("angle"), F.round(energy.first_step(volume, 2.0, 5.0), 7).alias("first_step"))


@query("""WITH s AS (SELECT event_type AS it, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) diff, count(*) tot FROM events GROUP BY 1) SELECT it, diff, tot, round(diff / CASE WHEN tot = 0 THEN 1 ELSE tot END, 9) ratio FROM s""")
def q40_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("it")).agg(F.sum((F.col("value") > 50).cast("long")).alias("diff"), F.count("*").alias("tot"))
    return sinks.convergence(s).withColumn("ratio", F.round("ratio", 9))


@query("""WITH c AS (SELECT o_custkey id, max(o_totalprice) v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey id, coalesce(v, c_acctbal) AS v FROM customer LEFT JOIN c ON c_custkey = id""")
def q41_updated_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    changes = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    return messages.updated_vertices(v, changes, "v")


@query("""WITH e AS (SELECT DISTINCT l_suppkey src, l_partkey dst FROM lineitem), r AS (SELECT s_suppkey id FROM supplier WHERE s_acctbal > 0) SELECT src, dst FROM e WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)""")
def q42_edges_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return messages.edges_within(e, load(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


@query(f"""WITH {POINTS_SQL}, u AS (SELECT min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax FROM t), s AS (SELECT *, greatest(xmax - xmin, ymax - ymin, zmax - zmin) side FROM u)
SELECT xmin, xmax, ymin, round(ymin + side, 6) ymax, zmin, round(zmin + side, 6) zmax FROM s""")
def q43_cubic_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tiling.bounding_boxes(tiled(spark, sf_dir)).where("cell is not null")
    return surface.cubic_box(b).withColumns({c: F.round(c, 6) for c in ("ymax", "zmax")})


@query(f"WITH {CELLS_SQL} SELECT CAST(sum(n) AS BIGINT) total, max(n) most, max(n) > 500 AS over FROM c")
def q44_fullest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.fullest(tiling.cell_counts(tiled(spark, sf_dir)), LIMIT)


@query("""SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) l_linenumber, round(2.0 * (sqrt(1 + l_discount) - 1), 9) value, round(pow(1 + l_discount, -0.5), 9) slope FROM lineitem""")
def q45_m_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, slope = g.m_estimator(F.col("l_discount"), 0.5)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(value, 9).alias("value"), F.round(slope, 9).alias("slope"))
