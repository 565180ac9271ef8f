"""Every registered query with SQL gives the rows that DuckDB gives; the others run and hold what they promise."""

import duckdb
import pytest

from geolith.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds.get(t, t) for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_distributed_triangulation_is_the_whole_one(spark):
    got = dict(catalogue.QUERIES["r2_distributed_delaunay"](spark, SF).collect())
    assert got["cells"] > 0 and got["missing"] == got["extra"] == got["unshared"] == 0


def test_flow_equals_cut(spark):
    for r in catalogue.QUERIES["r3_min_cut"](spark, SF).collect():
        assert r["flow"] == r["cut"] and 0 < r["n_occupied"] < r["n_cells"]


def test_surface_is_closed(spark):
    assert all(r["n"] % 2 == 0 for r in catalogue.QUERIES["r5_surface"](spark, SF).collect())


def test_ply_round_trip(spark):
    import pandas as pd

    got = catalogue.QUERIES["r7_ply_round_trip"](spark, SF).toPandas()
    want = catalogue.QUERIES["q04_tile_boxes"](spark, SF).toPandas()
    both = got.merge(want, left_on="tile_id", right_on="cell")
    assert len(both) == len(got) == len(want) - 1
    assert (both["n_x"] == both["n_y"]).all() and (both["xmin_x"] == both["xmin_y"]).all() and (both["ymax_x"] == both["ymax_y"]).all()
    assert isinstance(both, pd.DataFrame)


def test_generator_and_thinning(spark):
    got = catalogue.QUERIES["r6_generated_and_thinned"](spark, SF).collect()
    assert got and all(0 < r["n_kept"] <= r["n"] for r in got)


def test_reconstruction_is_closed(spark):
    got = dict(map(tuple, catalogue.QUERIES["r8_reconstruction"](spark, SF).collect()))
    assert got["facets"] > 0 and got["open_edges"] == 0 and got["differ"] == 0


def test_beliefs_sum_to_one(spark):
    got = catalogue.QUERIES["r9_factor_graph"](spark, SF).collect()
    assert got and all(abs(r["b0"] + r["b1"] - 1) < 1e-5 for r in got)


def test_dual_graph_counts(spark):
    got = dict(map(tuple, catalogue.QUERIES["r10_dual_graph"](spark, SF).collect()))
    assert got["differing"] == 0 and got["edges_1"] + got["edges_2"] <= got["facets"]
