"""Routes whose points are made where they are used: no point moves, and keys go round however few there are."""

import duckdb
import pytest

from fathomline import plans

TABLES = ("part", "orders", "lineitem")
WEATHERED = ["kpi_comparison", "route_savings", "acceptance_guard", "arrival_hours_path", "route_fuel_eta", "fuel_proxy", "route_avg_fill", "route_summary", "risk_segments", "risk_points"]


@pytest.fixture(scope="module", params=[20, 700])
def tables(tmp_path_factory, request):
    """So many keys: fewer than a route reaches, and more than a block has."""
    d, n = str(tmp_path_factory.mktemp("routes")), request.param
    c = duckdb.connect()
    c.execute(f"CREATE TABLE part AS SELECT range AS p_partkey, 10 AS p_size FROM range({n})")
    c.execute("CREATE TABLE orders AS SELECT range AS o_orderkey, (range * 37) % 1100 AS o_custkey, DATE '2024-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 1e2 AS o_totalprice FROM range(900)")
    c.execute(f"""CREATE TABLE lineitem AS SELECT range % 60 AS l_orderkey, (range * 7) % {n + 1} AS l_partkey, range % 9 AS l_suppkey, CAST(1 + range % 50 AS DOUBLE) AS l_quantity,
      (range % 11) / 1e2 AS l_discount, (range % 9) / 1e2 AS l_tax, CASE WHEN range % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(9000) WHERE range % 5 > 0""")
    for t in TABLES:
        c.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", WEATHERED)
def test_routes_equal_sql(spark, tables, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    found = c.execute(plans.oracles()[name])
    names = [x[0] for x in found.description]
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted((tuple(map(plain, row)) for row in found.fetchall()), key=repr)
    assert want == sorted((tuple(plain(row[k]) for k in names) for row in plans.queries()[name](spark, tables).collect()), key=repr)


@pytest.mark.parametrize("name", [*WEATHERED, "stride_sample", "route_distance"])
def test_no_point_of_a_route_moves(spark, tables, name):
    plan = plans.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and ("route_type#" in line or "step_h#" in line and "node_id#" in line)]
    assert moved == []
