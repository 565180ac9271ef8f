"""Queries on evidence, labelling, message passing, surfaces and parameters (Q16 to Q25, Q27, Q30, Q31, R1 to R7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolith.operators import cells as volume
from geolith.operators import energy, exchange, factors, fusion, labelling, messages, scoring, simplify, surface, tiling, triangulation
from geolith.plans import reconstruction
from geolith.plans.spatial import ADJACENT_SQL, adjacent
from geolith.plans.views import BOX, POINTS_SQL, load, points, tiled
from geolith.schema import Box
from geolith.session import beside
from geolith.sources import params, ply, sinks
from geolith.sources.points import clustered_points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as masses: discount speaks for empty, tax for occupied."""
    t = load(spark, sf_dir, "lineitem")
    e, o = F.col("l_discount") * 4, F.col("l_tax") * 4
    return t.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_returnflag", e.alias("e"), o.alias("o"), (1 - e - o).alias("u"))


MASSES_SQL = "m AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) l_linenumber, l_returnflag, l_discount * 4 e, l_tax * 4 o, 1 - l_discount * 4 - l_tax * 4 u FROM lineitem)"


def fuse_sql(keys: str, source: str, name: str) -> str:
    q = f"SELECT {keys}, count(*) n_masses, product(e + u) qe, product(o + u) qo, product(u) qu FROM {source} GROUP BY {keys}"
    return f"{name} AS (SELECT {keys}, n_masses, CASE WHEN qe + qo - qu > 0 THEN (qe - qu) / (qe + qo - qu) ELSE 0 END e, CASE WHEN qe + qo - qu > 0 THEN (qo - qu) / (qe + qo - qu) ELSE 0 END o, CASE WHEN qe + qo - qu > 0 THEN qu / (qe + qo - qu) ELSE 1 END u FROM ({q}))"


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


SURFACE_MASS_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) l_linenumber, round(e / (e + o + u), 9) e, round(o / (e + o + u), 9) o, round(u / (e + o + u), 9) u FROM (
  SELECT *, greatest(1 - e - o, 0) u FROM (
    SELECT *, least(greatest(e0 * fade, 0), 1) e, least(greatest(o0 * fade, 0), 1) o FROM (
      SELECT *, CASE WHEN c3 > 0 THEN 1 - 0.5 * exp(-abs(c3) / 2.0) WHEN c3 < 0 THEN 0.5 * exp(-abs(c3) / 2.0) ELSE 0.5 END e0,
             CASE WHEN c3 > 0 THEN 0.5 * exp(-abs(c3) / 2.0) WHEN c3 < 0 THEN 1 - 0.5 * exp(-abs(c3) / 2.0) ELSE 0.5 END o0,
             exp(-pow(c3 / 4.0, 2)) * conf * exp(-pow(c1 / 30.0, 2)) * exp(-pow(c2 / 5.0, 2)) fade FROM (
        SELECT *, (l_quantity - 25) / 2 c1, l_discount * 100 - 5 c2, l_tax * 100 - 4 c3, least(greatest(2.0 / 4.0, 1e-6), 1.0) * CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE 1 END conf FROM lineitem))))"""


@query(SURFACE_MASS_SQL)
def q16_surface_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "lineitem")
    c = [(F.col("l_quantity") - 25) / 2, F.col("l_discount") * 100 - 5, F.col("l_tax") * 100 - 4]
    conf = fusion.confidence(F.lit(4.0), 2.0, (F.col("l_returnflag") == "R").cast("int"), 1.0)
    e, o, u = fusion.surface_mass(c, [F.lit(30.0), F.lit(5.0), F.lit(2.0)], F.lit(4.0), conf)
    return t.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(e, 9).alias("e"), F.round(o, 9).alias("o"), F.round(u, 9).alias("u"))


@query(f"WITH {MASSES_SQL}, {fuse_sql('l_orderkey', 'm', 'f')} SELECT l_orderkey, n_masses, round(e, 9) e, round(o, 9) o, round(u, 9) u FROM f")
def q17_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.fuse(masses(spark, sf_dir), ["l_orderkey"]), 9, "e", "o", "u")


@query(f"WITH {MASSES_SQL}, {fuse_sql('l_suppkey, l_orderkey', 'm', 'f')} SELECT l_suppkey, round(avg(e), 8) e, round(avg(o), 8) o, round(avg(u), 8) u, count(*) n_samples FROM f GROUP BY l_suppkey")
def q18_cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fusion.fuse(masses(spark, sf_dir), ["l_suppkey", "l_orderkey"])
    return rounded(fusion.mean_mass(samples, ["l_suppkey"]), 8, "e", "o", "u")


@query(f"""WITH {MASSES_SQL}, {fuse_sql('l_orderkey, l_returnflag', 'm', 'f')},
s AS (SELECT l_orderkey, CASE WHEN e > o THEN least(abs(e - o), 0.95) ELSE 0 END e, CASE WHEN e > o THEN 0 ELSE least(abs(e - o), 0.95) END o, 1 - least(abs(e - o), 0.95) u FROM f),
{fuse_sql('l_orderkey', 's', 'g')} SELECT l_orderkey, n_masses, round(e, 8) e, round(o, 8) o, round(u, 8) u FROM g""")
def q19_conflict_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.fuse_sources(masses(spark, sf_dir), ["l_orderkey"], "l_returnflag"), 8, "e", "o", "u")


@query("""WITH c AS (SELECT l_partkey cell_key, l_suppkey tile, max(l_discount) e, max(l_tax) o FROM lineitem GROUP BY ALL), w AS (SELECT *, min(tile) OVER (PARTITION BY cell_key) main_tile FROM c)
SELECT cell_key, tile, main_tile, coalesce(max(CASE WHEN tile = main_tile THEN e END) OVER k, e) e, coalesce(max(CASE WHEN tile = main_tile THEN o END) OVER k, o) o FROM w WINDOW k AS (PARTITION BY cell_key)""")
def q20_main_tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell_key"), F.col("l_suppkey").alias("tile")).agg(F.max("l_discount").alias("e"), F.max("l_tax").alias("o"))
    c = c.withColumn("main_tile", F.min("tile").over(Window.partitionBy("cell_key")))
    return exchange.overwrite_from_main(c, "cell_key", "tile", "main_tile", ["e", "o"])


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells as volume cells: masses from the share of returned items, labelled empty if over half of them were."""
    t = tiled(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.sum((F.col("flag") == "R").cast("long")).alias("r"))
    e, o, u = F.col("r") / (F.col("n") + 2), (F.col("n") - F.col("r")) / (F.col("n") + 2), 2 / (F.col("n") + 2)
    return t.select("cell", "n", (F.col("r") * 4 > F.col("n")).cast("long").alias("label"), energy.unary(e, o, u, 0).alias("cost0"), energy.unary(e, o, u, 1).alias("cost1"))


GRID_SQL = ADJACENT_SQL + """, g0 AS (SELECT cell, count(*) n, sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END)::BIGINT r FROM t GROUP BY cell),
g AS (SELECT cell, n, CAST(r * 4 > n AS BIGINT) AS label, abs(0.0 - r / (n + 2)) + abs(1.0 - (n - r) / (n + 2)) + abs(2 / (n + 2)) cost0, abs(1.0 - r / (n + 2)) + abs(0.0 - (n - r) / (n + 2)) + abs(2 / (n + 2)) cost1 FROM g0)"""


@query(f"""WITH {GRID_SQL}, u AS (SELECT sum(CASE WHEN label = 0 THEN cost0 ELSE cost1 END) unary_ FROM g), w AS (SELECT sum(abs(a.label - b.label) * 0.25::DOUBLE) pairwise FROM e JOIN g a ON e.a = a.cell JOIN g b ON e.b = b.cell WHERE e.a < e.b)
SELECT round(unary_, 6) AS "unary", round(pairwise, 6) pairwise, round(unary_ + pairwise, 6) total FROM u, w""")
def q21_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = adjacent(spark, sf_dir).where("a < b").withColumn("coef", F.lit(0.25))
    return rounded(energy.energy(grid_cells(spark, sf_dir), facets), 6, "unary", "pairwise", "total")


def shared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that two suppliers deliver as cells that two tiles share; a tile labels by its largest quantity."""
    c = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell_key"), F.col("l_suppkey").alias("tile")).agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    a, b = (c.select("cell_key", F.col("tile").alias(f"tile_{s}"), (F.col("q") > 25).cast("long").alias(f"label_{s}"), F.col("n").alias(f"n_{s}")) for s in ("lo", "hi"))
    j = a.join(b, "cell_key").where("tile_lo < tile_hi")
    return j.withColumns({"lam": F.lit(0.5), "tau": energy.first_step(F.col("n_lo") + F.col("n_hi"), 2.0, 5.0), "last": F.pmod("cell_key", F.lit(2)).cast("long")})


SHARED_SQL = """c AS (SELECT l_partkey cell_key, l_suppkey tile, max(l_quantity) q, count(*) n FROM lineitem GROUP BY ALL),
s AS (SELECT a.cell_key, a.tile tile_lo, b.tile tile_hi, CAST(a.q > 25 AS BIGINT) label_lo, CAST(b.q > 25 AS BIGINT) label_hi, 0.5::DOUBLE lam, ln(1 + a.n + b.n) * 2.0 * 5.0 tau, a.cell_key % 2 AS last FROM c a JOIN c b USING (cell_key) WHERE a.tile < b.tile)"""


@query(f"WITH {SHARED_SQL} SELECT tile_lo, tile_hi, cell_key, round(lam + tau * (label_lo - label_hi), 8) lam, round(CASE WHEN label_lo - label_hi <> last THEN tau / 2 ELSE tau END, 8) tau, label_lo - label_hi AS last FROM s")
def q22_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(energy.updated_multipliers(shared_cells(spark, sf_dir)), 8, "lam", "tau")


@query(f"WITH {SHARED_SQL} SELECT tile_lo, CAST(sum(CASE WHEN label_lo <> label_hi THEN 1 ELSE 0 END) AS BIGINT) diff, count(*) total, round(sum(CASE WHEN label_lo <> label_hi THEN 1 ELSE 0 END) / count(*), 8) ratio FROM s GROUP BY tile_lo")
def q22b_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(energy.agreement(shared_cells(spark, sf_dir), ["tile_lo"]), 8, "ratio")


def bp_sql(vertices: str, edges: str, n: int, rounds: int) -> str:
    """Unrolled rounds over v0 (id, p0.., b0..) and e0 (src, dst, f<i><j>.., fwd0.., rev0..)."""
    ks, out = range(n), f"{vertices}, {edges}"
    tops = lambda a: "greatest(" + ", ".join(a) + ")"
    fs = ", ".join(f"f{i}{j}" for i in ks for j in ks)
    for r in range(1, rounds + 1):
        out += f", x{r} AS (SELECT src, dst, {fs}, " + ", ".join(f"s.b{i} / exp(rev{i} - {tops([f'rev{k}' for k in ks])}) q{i}, d.b{i} / exp(fwd{i} - {tops([f'fwd{k}' for k in ks])}) t{i}" for i in ks) + f" FROM e{r - 1} JOIN v{r - 1} s ON s.id = src JOIN v{r - 1} d ON d.id = dst)"
        out += f", y{r} AS (SELECT src, dst, {fs}, " + ", ".join("(" + " + ".join(f"f{i}{j} * q{i}" for i in ks) + f") w{j}, (" + " + ".join(f"f{j}{i} * t{i}" for i in ks) + f") z{j}" for j in ks) + f" FROM x{r})"
        sw, sz = (" + ".join(f"{c}{k}" for k in ks) for c in "wz")
        out += f", e{r} AS (SELECT src, dst, {fs}, " + ", ".join(f"ln(w{k} / ({sw})) fwd{k}, ln(z{k} / ({sz})) rev{k}" for k in ks) + f" FROM y{r})"
        out += f", i{r} AS (SELECT id, " + ", ".join(f"sum(m{k}) m{k}" for k in ks) + " FROM (SELECT dst id, " + ", ".join(f"fwd{k} m{k}" for k in ks) + f" FROM e{r} UNION ALL SELECT src, " + ", ".join(f"rev{k}" for k in ks) + f" FROM e{r}) GROUP BY id)"
        out += f", u{r} AS (SELECT id, " + ", ".join(f"p{k}" for k in ks) + ", " + ", ".join(f"ln(p{k}) + coalesce(m{k}, 0) l{k}" for k in ks) + f" FROM v{r - 1} LEFT JOIN i{r} USING (id))"
        top = tops([f"l{k}" for k in ks])
        total = " + ".join(f"exp(l{k} - {top})" for k in ks)
        out += f", v{r} AS (SELECT id, " + ", ".join(f"p{k}, exp(l{k} - {top}) / ({total}) b{k}" for k in ks) + f" FROM u{r})"
    return f"WITH {out} SELECT id, " + ", ".join(f"round(b{k}, 7) b{k}" for k in ks) + f" FROM v{rounds}"


TREE_SQL = (
    """v AS (SELECT 2000000000 + r_regionkey::BIGINT id, 0.5::DOUBLE p0, 0.5::DOUBLE p1 FROM region UNION ALL SELECT 1000000000 + n_nationkey::BIGINT, 0.4, 0.6 FROM nation
    UNION ALL SELECT c_custkey, CASE WHEN c_acctbal > 4500 THEN 0.9 ELSE 0.2 END, CASE WHEN c_acctbal > 4500 THEN 0.1 ELSE 0.8 END FROM customer),
v0 AS (SELECT *, p0 / (p0 + p1) b0, p1 / (p0 + p1) b1 FROM v)""",
    """e AS (SELECT 1000000000 + n_nationkey::BIGINT src, 2000000000 + n_regionkey::BIGINT dst FROM nation UNION ALL SELECT c_custkey, 1000000000 + c_nationkey::BIGINT FROM customer),
e0 AS (SELECT src, dst, 0.505::DOUBLE f00, 0.495::DOUBLE f01, 0.495::DOUBLE f10, 0.505::DOUBLE f11, 0.0::DOUBLE fwd0, 0.0::DOUBLE fwd1, 0.0::DOUBLE rev0, 0.0::DOUBLE rev1 FROM e)""",
)


@query(bp_sql(*TREE_SQL, 2, 3))
def q23_two_state_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    region, nation = F.lit(2_000_000_000) + F.col("r_regionkey").cast("long"), F.lit(1_000_000_000) + F.col("n_nationkey").cast("long")
    rich = F.col("c_acctbal") > 4500
    v = r.select(region.alias("id"), F.lit(0.5).alias("p0"), F.lit(0.5).alias("p1")).union(n.select(nation, F.lit(0.4), F.lit(0.6))).union(c.select("c_custkey", F.when(rich, 0.9).otherwise(0.2), F.when(rich, 0.1).otherwise(0.8)))
    e = n.select(nation.alias("src"), (F.lit(2_000_000_000) + F.col("n_regionkey").cast("long")).alias("dst")).union(c.select("c_custkey", F.lit(1_000_000_000) + F.col("c_nationkey").cast("long")))
    e = e.withColumns({f"f{i}{j}": F.lit(0.505 if i == j else 0.495) for i in (0, 1) for j in (0, 1)})
    return rounded(messages.two_state_bp(v, e, rounds=3, fixed=True), 7, "b0", "b1")


CHAIN_SQL = (
    """v AS (SELECT o_orderkey id, CASE o_orderstatus WHEN 'F' THEN 0.7 ELSE 0.2 END p0, CASE o_orderstatus WHEN 'O' THEN 0.7 ELSE 0.2 END p1, CASE o_orderstatus WHEN 'P' THEN 0.7 ELSE 0.2 END p2 FROM orders),
v0 AS (SELECT *, p0 / (p0 + p1 + p2) b0, p1 / (p0 + p1 + p2) b1, p2 / (p0 + p1 + p2) b2 FROM v)""",
    """e AS (SELECT o_orderkey src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) dst FROM orders),
e0 AS (SELECT src, dst, 0.6::DOUBLE f00, 0.2::DOUBLE f01, 0.2::DOUBLE f02, 0.2::DOUBLE f10, 0.6::DOUBLE f11, 0.2::DOUBLE f12, 0.2::DOUBLE f20, 0.2::DOUBLE f21, 0.6::DOUBLE f22,
0.0::DOUBLE fwd0, 0.0::DOUBLE fwd1, 0.0::DOUBLE fwd2, 0.0::DOUBLE rev0, 0.0::DOUBLE rev1, 0.0::DOUBLE rev2 FROM e WHERE dst IS NOT NULL)""",
)


@query(bp_sql(*CHAIN_SQL, 3, 2))
def q24_pairwise_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    v = o.select(F.col("o_orderkey").alias("id"), *[F.when(F.col("o_orderstatus") == s, 0.7).otherwise(0.2).alias(f"p{k}") for k, s in enumerate("FOP")])
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    e = o.select(F.col("o_orderkey").alias("src"), nxt.alias("dst")).where("dst is not null")
    return rounded(messages.pairwise_bp(v, e, [[0.6 if i == j else 0.2 for j in range(3)] for i in range(3)], rounds=2, fixed=True), 7, "b0", "b1", "b2")


@query("""WITH e AS (SELECT DISTINCT l_orderkey src, l_partkey + 1000000000 dst FROM lineitem), v AS (SELECT o_orderkey id, o_orderpriority p FROM orders UNION ALL SELECT p_partkey + 1000000000, p_brand FROM part),
a AS (SELECT id, p FROM v UNION ALL SELECT dst, p FROM e JOIN v ON id = src) SELECT id, array_to_string(list_sort(list(DISTINCT p)), ',') "values" FROM a GROUP BY id""")
def q25_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    e = li.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).distinct()
    v = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p")).union(p.select(F.col("p_partkey") + 1_000_000_000, "p_brand"))
    return messages.with_neighbours(v, e, "p").select("id", F.concat_ws(",", "values").alias("values"))


@query(f"""WITH {GRID_SQL} SELECT a.label la, b.label lb, CAST(sum(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END) AS BIGINT) n_facets FROM e JOIN g a ON e.a = a.cell JOIN g b ON e.b = b.cell WHERE e.a < e.b AND a.label <> b.label GROUP BY ALL""")
def q27_surface_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = surface.surface_facets(adjacent(spark, sf_dir).where("a < b"), grid_cells(spark, sf_dir), mode=1)
    return f.groupBy("la", "lb").agg(F.count("*").alias("n_facets"))


@query("""SELECT regexp_replace(event_type || (event_id % 7), '[0-9]', '', 'g') AS label, round(sum(value), 2) AS "seconds", count(*) n FROM events GROUP BY 1""")
def q30_stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("label"), F.col("value").alias("seconds"))
    return rounded(sinks.stage_times(e), 2, "seconds")


PARAMS_XML = """<env><datasets>
<a><lambda>1,2,0.5</lambda><depth>3,4</depth><do_process>true</do_process><do_expand>true</do_expand><sort_criterion>lambda:gt</sort_criterion></a>
<b><lambda>9</lambda><do_process>false</do_process></b>
<c><nbp_and_depth>1000:2,5000:3</nbp_and_depth><do_expand>true</do_expand><do_process>true</do_process></c>
</datasets></env>"""


@query("""SELECT 'a' AS name, CAST(row_number() OVER (ORDER BY l DESC, d) - 1 AS BIGINT) run, l AS lambda, d AS depth, NULL::VARCHAR nbp FROM (VALUES ('1'), ('2'), ('0.5')) x(l), (VALUES ('3'), ('4')) y(d)
UNION ALL SELECT 'c', 0, NULL, '2', '1000' UNION ALL SELECT 'c', 1, NULL, '3', '5000'""")
def q31_parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, runs in params.parameter_runs(PARAMS_XML).items():
        rows += [(name, k, *(r.get(key, [None])[0] for key in ("lambda", "depth", "nbp"))) for k, r in enumerate(runs)]
    return spark.createDataFrame(rows, "name string, run long, lambda string, depth string, nbp string")


# -- without SQL: triangulation, cuts, surfaces. tests/ compares them with plain versions.

AMOUNT = 1e-4


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of customers on a map: balance and a hash of the key spread over a cube, tiled in two halves by x. All customers."""
    c = load(spark, sf_dir, "customer")
    at = lambda k: F.pmod(F.col("c_custkey") * k, F.lit(9973)) / 9973.0
    p = c.select(F.col("c_custkey").alias("pid"), ((F.col("c_acctbal") + 1000) / 11000).alias("x"), at(7919).alias("y"), at(104729).alias("z"))
    return p.withColumn("tile", (F.floor(F.col("x") * 2) * 4 + F.floor(F.col("y") * 2) * 2 + F.floor(F.col("z") * 2)).cast("long"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, sf_dir).withColumns({"tile": F.lit(0).cast("long"), "owner": F.lit(0).cast("long")})


def tiles_triangulated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    p = sample(spark, sf_dir).checkpoint()
    ext = tiling.extreme_points(p, ["pid"], "tile").select("pid")
    cells, sent = triangulation.distributed_delaunay(p, ext, AMOUNT, centres=True)
    return p, cells, sent


@query(None)
def r1_delaunay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = triangulation.local_delaunay(whole(spark, sf_dir), AMOUNT)
    return cells.groupBy("infinite").agg(F.count("*").alias("n_cells"), F.countDistinct("pids").alias("n_distinct"))


@query(None)
def r2_distributed_delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the tiles against those of one tile: both differences are to be 0, as are cells that an owner lacks."""
    one = beside(lambda: triangulation.local_delaunay(whole(spark, sf_dir), AMOUNT).where("not infinite").select("pids").checkpoint())
    _, cells, sent = tiles_triangulated(spark, sf_dir)
    many = triangulation.main_cells(cells).select("pids")
    both = one().select("pids", F.lit(1).alias("o"), F.lit(0).alias("m")).unionByName(many.select("pids", F.lit(0).alias("o"), F.lit(1).alias("m")))
    each = both.groupBy("pids").agg(F.sum("m").alias("m"), (F.sum("o") - F.sum("m")).alias("lack"))
    total = each.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("m", F.greatest("lack", F.lit(0)), F.greatest(-F.col("lack"), F.lit(0)))]).first()
    counts = [("cells", total[0]), ("missing", total[1]), ("extra", total[2]), ("unshared", triangulation.missing_in_tiles(cells).count()), ("rounds", len(sent)), ("sent", sum(sent))]
    return spark.createDataFrame(counts, "what string, n long")


def scored(cells: DataFrame) -> DataFrame:
    """Finite cells with costs from a ball about the middle of the cube: inside occupied, outside empty, the evidence growing with the distance from its border."""
    c = cells.where("not infinite")
    far = F.sqrt(sum((F.pow(F.col(f"c{a}") - 0.5, 2) for a in "yz"), F.pow(F.col("cx") - 0.5, 2))) - 0.35
    e, o = F.when(far > 0, 1 - F.exp(-10 * far)).otherwise(0.0), F.when(far < 0, 1 - F.exp(10 * far)).otherwise(0.0)
    u = 1 - e - o
    return c.select("tile", "pids", "owners", energy.unary(e, o, u, 0).alias("cost0"), energy.unary(e, o, u, 1).alias("cost1"))


def cell_facets(cells: DataFrame, coef: float) -> DataFrame:
    """Facets between finite cells within each tile."""
    name = lambda c: F.concat_ws("-", F.transform(c, lambda x: x.cast("string")))
    n = F.size("pids")
    sides = F.transform(F.sequence(F.lit(1), n), lambda k: F.filter("pids", lambda x, i: i != k - 1))
    each = cells.where("not infinite").select("tile", F.explode(sides).alias("facet"), name(F.col("pids")).alias("c"))
    f = each.groupBy("tile", "facet").agg(F.sort_array(F.collect_list("c")).alias("cs")).where("size(cs) = 2")
    return f.select("tile", F.col("cs")[0].alias("a"), F.col("cs")[1].alias("b"), F.lit(coef).alias("coef"), "facet")


@query(None)
def r3_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cuts of the cells, by tile: flow equals cut."""
    cells = triangulation.local_delaunay(whole(spark, sf_dir), AMOUNT, centres=True).checkpoint()
    return labelling.cut_with_values(scored(cells).withColumn("cell", reconstruction.name(F.col("pids"))).drop("pids", "owners"), cell_facets(cells, 0.1).drop("facet"))


@query(None)
def r4_agreement_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of cutting tile by tile until shared cells agree."""
    _, cells, _ = tiles_triangulated(spark, sf_dir)
    own = cells.where(F.array_contains("owners", F.col("tile")))
    _, _, log = labelling.agree_on(labelling.mesh_problem(scored(own), 0.1), 0.2, 15)
    return spark.createDataFrame(log, "round long, diff long, total long")


@query(None)
def r5_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the surface about the occupied cells by how many facets meet there: even everywhere, as the surface is closed."""
    cells = triangulation.local_delaunay(whole(spark, sf_dir), AMOUNT, centres=True)
    labels = labelling.cut_meshes(scored(cells), 0.1)
    kept = labels.select("pids", F.explode("open").alias("k")).select(F.filter("pids", lambda x, i: i != F.col("k")).alias("facet"))
    edges = kept.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.filter("facet", lambda x, i: i != k))).alias("edge"))
    return edges.groupBy("edge").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_edges"))


@query(None)
def r6_generated_and_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clustered_points(spark, 4000, BOX, 1000, 7).withColumn("tile", F.col("kernel"))
    kept = simplify.thinned(made, 300.0, "pid")
    return made.groupBy("kernel").agg(F.count("*").alias("n")).join(kept.groupBy("kernel").agg(F.count("*").alias("n_kept")), "kernel")


@query(None)
def r7_ply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by tile through a PLY file's bytes and back: the same count and box for each tile."""
    import pandas as pd

    t = tiled(spark, sf_dir).select(F.col("cell").alias("tile_id"), "x", "y", "z")

    def back(batches):
        for b in batches:
            for tile, data in zip(b["tile_id"], b["content"]):
                v = ply.read_elements(bytes(data))["vertex"]
                yield pd.DataFrame({"tile_id": [tile], "n": [len(v)], "xmin": [v["x"].min()], "ymax": [v["y"].max()], "box_zmax": [ply.box_comment(bytes(data))[5]]})

    return ply.ply_files(t).mapInPandas(back, "tile_id long, n long, xmin double, ymax double, box_zmax double")


@query(None)
def r8_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over a shell of points, a customer each, about a common sensor-facing surface: rows of each table, and facets by edge use."""
    c = load(spark, sf_dir, "customer")
    turn, up = F.col("c_custkey") * 2.399963229728653, 2 * (F.col("c_custkey") % 997) / 996.0 - 1
    flat = F.sqrt(1 - up * up)
    p = c.select(F.col("c_custkey").alias("pid"), (flat * F.cos(turn)).alias("x"), (flat * F.sin(turn)).alias("y"), up.alias("z"))
    p = p.withColumns({f"{a}_origin": F.col(a) * 5 for a in "xyz"})
    r = reconstruction.reconstruct(p, reconstruction.Settings(Box((-1.5,) * 3, (1.5,) * 3), depth=1, max_ppt=400, lambda_=0.3, max_opt_it=8))
    vertices, faces = reconstruction.mesh(r)
    ends = faces.select(F.explode(F.array(*[F.array(F.col("face")[i], F.col("face")[j]) for i, j in ((0, 1), (1, 2), (2, 0))])).alias("e"))
    open_ = ends.exceptAll(ends.select(F.reverse("e").alias("e"))).count()
    rows = [("points", r.points.count()), ("cells", r.scores.count()), ("occupied", r.labels.where("label = 0").count()), ("facets", r.facets.count()), ("vertices", vertices.count()), ("open_edges", open_), ("rounds", len(r.log["agreement"])), ("differ", r.log["agreement"][-1][1])]
    return spark.createDataFrame(rows, "what string, n long")


@query(None)
def r9_factor_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs on a factor graph: suppliers are two-state variables with priors from their balance, nations tie them to a regional one by three-variable factors."""
    s = load(spark, sf_dir, "supplier")
    good = F.when(F.col("s_acctbal") > 4500, 0.8).otherwise(0.3)
    priors = s.select(F.col("s_suppkey").alias("id"), F.array(F.log(1 - good), F.log(good)).alias("values"))
    pairs = s.select(F.col("s_suppkey").alias("a"), "s_nationkey").withColumn("b", F.lead("a").over(Window.partitionBy("s_nationkey").orderBy("a"))).where("b is not null")
    table = [1.0, 0.6, 0.6, 0.2, 0.2, 0.6, 0.6, 1.0]  # (a, b, nation), the first running fastest: alike is likely
    f = pairs.select(F.col("a").alias("factor"), F.array("a", "b", F.lit(1_000_000) + F.col("s_nationkey").cast("long")).alias("variables"), F.array(*[F.lit(2)] * 3).alias("sizes"), F.array(*[F.log(F.lit(v)) for v in table]).alias("values"))
    out = factors.factor_bp(priors, f)
    return out.select("id", F.round(F.col("belief")[0], 6).alias("b0"), F.round(F.col("belief")[1], 6).alias("b1"))


@query(None)
def r10_dual_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voronoi edges of the distributed triangulation by kind, shared-cell counts that differ (none), counts that belong to tiles."""
    p, cells, _ = tiles_triangulated(spark, sf_dir)
    main = triangulation.main_cells(cells).withColumn("cell", F.concat_ws("-", F.transform("pids", lambda x: x.cast("string"))))
    balls = volume.spheres(scoring.cell_corners(main.select("tile", "cell", "pids"), p))
    _, edges = volume.dual_graph(cells, balls)
    n = volume.counts_by_tile(cells, p).agg(F.sum("n_vertices"), F.sum("n_facets"), F.sum("n_cells")).first()
    rows = [(f"edges_{r['area']}", r["n"]) for r in edges.groupBy("area").agg(F.count("*").alias("n")).orderBy("area").collect()]
    rows += [("differing", volume.shared_counts(cells).where("n <> n_back").count()), ("vertices", n[0]), ("facets", n[1]), ("cells", n[2])]
    return spark.createDataFrame(rows, "what string, n long")


__all__ = ["ORACLE_SQL", "POINTS_SQL", "QUERIES", "points"]
