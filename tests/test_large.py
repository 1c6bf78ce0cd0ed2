"""Tables with what only larger ones have: a lattice that crosses a pole, many voyages and observations of a node."""

import duckdb
import pytest

from fathomline import plans

TABLES = ("part", "orders", "lineitem")


@pytest.fixture(scope="module")
def polar(tmp_path_factory):
    """A lattice of 11 rows around row 400, whose latitude is 90 degrees, with voyages that end there and observations with gaps."""
    d = str(tmp_path_factory.mktemp("polar"))
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT range AS p_partkey, CASE WHEN range >= 39500 AND range % 11 > 0 THEN 10 ELSE 1 END AS p_size FROM range(40600)")
    c.execute("CREATE TABLE orders AS SELECT range AS o_orderkey, 39500 + (range * 37) % 1100 AS o_custkey, DATE '2024-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 1e2 AS o_totalprice FROM range(300)")
    c.execute("""CREATE TABLE lineitem AS SELECT range % 60 AS l_orderkey, 39500 + (range * 7) % 1100 AS l_partkey, range % 9 AS l_suppkey, CAST(1 + range % 50 AS DOUBLE) AS l_quantity,
      (range % 11) / 1e2 AS l_discount, (range % 9) / 1e2 AS l_tax, CASE WHEN range % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(9000)""")
    for t in TABLES:
        c.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return d


def differing(spark, name, d):
    """Rows of a query that its SQL hasn't, rows of the SQL that the query hasn't, and how many the SQL has."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = c.execute(plans.oracles()[name])
    names = [x[0] for x in found.description]
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted((tuple(map(plain, row)) for row in found.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in names) for row in plans.queries()[name](spark, d).collect()), key=repr)
    more, less = set(got) - set(want), set(want) - set(got)
    return sorted(more, key=repr), sorted(less, key=repr), len(want) if len(got) == len(want) else (len(got), len(want))


@pytest.mark.parametrize("name", ["knn_snap", "hex_attach", "hex_edges", "augmented_edges", "endpoint_pairs", "impute_neighbors", "vector_field", "wind_grid_nearest"])
def test_neighbours_at_a_pole_equal_sql(spark, polar, name):
    more, less, n = differing(spark, name, polar)
    assert (more, less) == ([], [])
    assert isinstance(n, int) and n > 0


@pytest.mark.parametrize("name, by", [("bearing", "src#"), ("edge_samples", "src#"), ("path_cost", "voyage_id#"), ("gfs_stencil", "node_id#"), ("cmems_stencil", "node_id#")])
def test_edges_and_stencils_are_made_where_they_are_used(spark, polar, name, by):
    """No table of edges, or of nodes by cells and steps, moves or is sorted."""
    plan = plans.queries()[name](spark, polar)._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning({by}" not in plan


@pytest.mark.parametrize("name", ["bearing", "nav_edges", "edge_samples", "path_cost", "gfs_stencil", "cmems_stencil"])
def test_edges_and_stencils_at_a_pole_equal_sql(spark, polar, name):
    more, less, n = differing(spark, name, polar)
    assert (more, less) == ([], [])
    assert isinstance(n, int)


@pytest.mark.parametrize("name, key", [("turn_pairs", "via#"), ("path_cost", "src#"), ("corridor_grid", "node_id#"), ("induced_subgraph", "src#")])
def test_edges_are_not_broadcast(spark, polar, name, key):
    plan = plans.queries()[name](spark, polar)._jdf.queryExecution().executedPlan().toString()
    assert f"BroadcastHashJoin [{key}" not in plan


@pytest.mark.parametrize("name, keys", [("idw_weather", ("place#", "o#"))])
def test_weather_is_not_broadcast(spark, polar, name, keys):
    """Places and observations grow with the input, however small their files look."""
    plan = plans.queries()[name](spark, polar)._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in keys if f"BroadcastHashJoin [{k}" in plan]


@pytest.fixture(scope="module")
def sparse(tmp_path_factory):
    """A lattice of 60 rows of which the first five are observed, and a few nodes far from them."""
    d = str(tmp_path_factory.mktemp("sparse"))
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT range AS p_partkey, CASE WHEN range % 13 > 0 THEN 10 ELSE 1 END AS p_size FROM range(6000)")
    c.execute("CREATE TABLE orders AS SELECT range AS o_orderkey, (range * 37) % 6000 AS o_custkey, DATE '2024-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 1e2 AS o_totalprice FROM range(300)")
    c.execute("""CREATE TABLE lineitem AS SELECT range % 77 AS l_orderkey, CASE WHEN range % 100 = 99 THEN 4000 + range % 7 ELSE (range * 7) % 500 END AS l_partkey, range % 9 AS l_suppkey, CAST(1 + range % 50 AS DOUBLE) AS l_quantity,
      (range % 11) / 1e2 AS l_discount, (range % 9) / 1e2 AS l_tax, CASE WHEN range % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(9000)""")
    for t in TABLES:
        c.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", ["idw_weather", "edge_weather_samples"])
def test_weather_where_few_nodes_are_observed_equals_sql(spark, sparse, name):
    """Places with no observed node, or fewer than six, within two degrees."""
    more, less, n = differing(spark, name, sparse)
    assert (more, less) == ([], [])
    assert isinstance(n, int) and n > 0


def test_imputed_heights_are_from_four_nodes_however_far(spark, tmp_path):
    """Nodes that lack a wave height between rows 40 and 50, and known ones in the first rows only."""
    d, c = str(tmp_path), duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT range AS p_partkey, 10 AS p_size FROM range(5000)")
    c.execute("CREATE TABLE orders AS SELECT range AS o_orderkey, range AS o_custkey, DATE '2024-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 1e2 AS o_totalprice FROM range(3)")
    c.execute("""CREATE TABLE lineitem AS SELECT 25 AS l_orderkey, CASE WHEN range < 50 THEN range * 3 ELSE 4000 + range * 2 END AS l_partkey, 1 AS l_suppkey, CAST(1 + range % 50 AS DOUBLE) AS l_quantity,
      (range % 11) / 1e2 AS l_discount, 1e-2 AS l_tax, CASE WHEN range < 50 THEN 'N' ELSE 'R' END AS l_returnflag FROM range(400)""")
    for t in TABLES:
        c.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    assert differing(spark, "impute_neighbors", d) == ([], [], 350)
    assert {x.n for x in plans.queries()["impute_neighbors"](spark, d).collect()} == {4}
    assert differing(spark, "current_weather", d)[:2] == ([], [])


def test_nearest_places_are_found_where_latitudes_go_round_again(spark):
    """A latitude of 370 degrees is that of 10, and 100 is 80 on the other side."""
    from fathomline.operators import spatial

    places = [(1, 10.0, -60.0), (2, 89.9, 0.0), (3, 80.0, 120.0), (4, -60.0, 10.0)]
    others = [(1, 370.0, -60.2), (2, 90.4, 0.0), (3, 100.2, -60.0), (4, 300.0, 10.1), (5, 0.0, 0.0), (6, 85.0, 90.0)]
    found = spatial.nearest(spark.createDataFrame(places, "a long, lat double, lon double"), "a", spark.createDataFrame(others, "o long, lat_o double, lon_o double"), "o", 1, 30.0)
    assert {r.a: r.o for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_tables_of_rounds_leave_no_shuffles_behind(spark):
    """Files of shuffles go when a table is written, not when the driver collects garbage."""
    from pathlib import Path

    from fathomline.operators import graph

    files = lambda: set(Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*"))
    before = files()
    table, left = graph.checkpoint(spark.range(10_000).repartition(3)), graph.Round(spark.range(10_000).repartition(3))
    assert table.count() == left.now.count() == 10_000
    assert not {f for f in files() - before if f.name.endswith((".data", ".index")) and f.stat().st_size > 1000}
    left.drop()
    assert not Path(left.at).exists()


def test_a_path_moves_once_for_each_large_cell():
    """A corridor of 400 km meets a few cells as a whole instead of hundreds of smaller ones."""
    import numpy as np

    from fathomline.operators import ways

    codes, near = ways._cells_of(np.array([[1.0, 0.0, 0.0]]), 400.0, ways.SIZES[:1])
    assert len(codes) == len(near) <= 9
