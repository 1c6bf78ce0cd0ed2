"""Every query with SQL against another engine, at the smallest scale; streams against tables."""

import heapq
import math
import tempfile

import duckdb
import pytest

import __spark_entry__
from fathomline import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    found = con.execute(plans.oracles()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, row)) for row in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


# searches take minutes here: test_voyages.py compares them by value, and runs their queries on a smaller lattice
@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracles()) - set(plans.SEARCHES)))
def test_query_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_path_costs_equal_a_heap_search(spark):
    from fathomline.sources import fixtures

    out = {}
    for e in fixtures.nav_edges(spark, SF).collect():
        out.setdefault(e.src, []).append((e.dst, e.distance_nm))
    heap, want = [(0.0, min(r.node_id for r in fixtures.nav_nodes(spark, SF).collect()))], {}
    while heap:
        cost, at = heapq.heappop(heap)
        if at not in want:
            want[at] = cost
            for dst, step in out.get(at, ()):
                heapq.heappush(heap, (cost + step, dst))
    got = {r.node: r.nm for r in plans.queries()["baseline_path_cost"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def _lattice(spark):
    from fathomline.sources import fixtures

    out = {}
    for e in fixtures.nav_edges(spark, SF).collect():
        out.setdefault(e.src, {})[e.dst] = e.distance_km
    return out


def test_baselines_equal_a_plain_search_between_all_pairs_of_ends(spark):
    from fathomline.plans import voyages

    out, far = _lattice(spark), {}

    def distances(start):
        if start not in far:
            heap, got = [(0.0, start)], {}
            while heap:
                cost, at = heapq.heappop(heap)
                if at not in got:
                    got[at] = cost
                    for dst, step in out.get(at, {}).items():
                        heapq.heappush(heap, (cost + step, dst))
            far[start] = got
        return far[start]

    ends = {(t.start_key, t.end_key): ([x.node_id for x in t.starts], [x.node_id for x in t.ends]) for t in voyages.trips(spark, SF).collect()}
    found, _ = voyages._baselines(spark, SF)
    rows = found.collect()
    assert {(r.start_key, r.end_key) for r in rows} == ends.keys()
    for r in rows:
        a, b = ends[r.start_key, r.end_key]
        want = min((distances(x)[y] for x in a for y in b if y in distances(x)), default=None)
        assert (r.km is None) == (want is None)
        if want is not None:
            assert math.isclose(r.km, want, rel_tol=1e-9, abs_tol=1e-9) and r.start_node in a and r.end_node in b
            assert math.isclose(sum(out[x][y] for x, y in zip(r.path, r.path[1:])), want, rel_tol=1e-9, abs_tol=1e-9)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams_equal_tables(spark):
    from fathomline.sources import fixtures
    from fathomline.streaming import windows

    calls = fixtures.api_calls(spark, SF)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    calls.repartition(3).write.mode("overwrite").parquet(folder)
    stream = windows.slots(windows.read_stream(spark, folder, calls.schema), "400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("slots").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("slots").collect())) == sorted(map(tuple, windows.slots(calls).collect()))
