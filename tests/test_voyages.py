"""Searches, corridors and arrivals in Spark's operators, against plain searches over every trip of the smallest tables."""

import heapq
import math
import random
import tempfile
from dataclasses import replace

import pytest

from fathomline.functions import geo
from fathomline.operators import ways
from fathomline.params import DEFAULT
from fathomline.plans import voyages
from fathomline.sources import fixtures

SF = "/root/testdata/sf0.001"


def km(lat1, lon1, lat2, lon2):
    a, b = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1.0, a * a + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * b * b)))


def fold(a, b):
    return abs((a - b + 180) % 360 - 180)


class Plain:
    """The graph, prices and trips on the driver, and searches over them by heaps."""

    def __init__(self, spark, sf=SF):
        self.place = {n.node_id: (n.lat, n.lon) for n in fixtures.nav_nodes(spark, sf).collect()}
        names = [*DEFAULT.profiles, *DEFAULT.pareto]
        self.out = {}
        for e in voyages.step_priced_edges(spark, sf, names).collect():
            self.out.setdefault(e.src, {})[e.dst] = e
        self.far = {}

    def left(self, goal):
        if goal not in self.far:
            into = {}
            for a, ends in self.out.items():
                for b, e in ends.items():
                    into.setdefault(b, []).append((a, e.km))
            got, heap = {}, [(0.0, goal)]
            while heap:
                cost, at = heapq.heappop(heap)
                if at not in got:
                    got[at] = cost
                    for a, step in into.get(at, ()):
                        heapq.heappush(heap, (cost + step, a))
            self.far[goal] = got
        return self.far[goal]

    def first_steps(self, goal, total):
        left = self.left(goal)
        hour = lambda x: math.floor(max(0.0, total - left.get(x, total)) / DEFAULT.km_per_hour)
        return {x: min(math.floor(hour(x) / 3 + 0.5), 24) for x in self.place}

    def inside(self, path, radius):
        return {n for n, at in self.place.items() if n in path or any(km(*at, *self.place[x]) <= radius for x in path)}

    def cheapest(self, start, goal, profile, steps, inside, cap):
        heap, done = [(0.0, -1, start, ())], set()
        while heap:
            cost, before, at, path = heapq.heappop(heap)
            if at == goal:
                return cost, [*path, at]
            if (before, at) in done:
                continue
            done.add((before, at))
            for to, e in self.out[at].items():
                if to in inside and to != before and (before < 0 or fold(self.out[before][at].bearing, e.bearing) <= cap):
                    heapq.heappush(heap, (cost + e[f"cost_{profile}"][steps[at]], at, to, (*path, at)))
        return None, None

    def rounds(self, t, rounds, cap=DEFAULT.turn_cap_deg):
        """(cost, best) of each round."""
        if len(t.base_path) < 2:
            return [(0.0, 0.0)]
        steps, inside = self.first_steps(t.end_node, t.total), self.inside(t.base_path, t.radius_km)
        cost_of = lambda path: sum(self.out[a][b][f"cost_{t.profile}"][steps[a]] for a, b in zip(path, path[1:]))
        best, last, out = cost_of(t.base_path), None, []
        for _ in range(rounds):
            now, path = self.cheapest(t.start_node, t.end_node, t.profile, steps, inside, cap)
            if now is None:
                return [*out, (None, best)]
            best = min(best, now)
            out.append((now, best))
            if last and abs(last - now) / last < DEFAULT.converged:
                break
            spent, fresh = 0.0, {}
            for a, b in zip(path, path[1:]):
                spent += self.out[a][b].hours[steps[a]]
                fresh[b] = min(math.floor(spent / 3 + 0.5), 24)
            steps, last = steps | fresh, now
        return out


@pytest.fixture(scope="module")
def plain(spark):
    return Plain(spark)


@pytest.fixture(scope="module")
def ready(spark):
    return voyages._search(spark, SF)


@pytest.fixture(scope="module")
def small(spark):
    """A copy of the smallest tables with a lattice of 2 x 12 nodes and some 190 voyages, all tables as before otherwise."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, rows in (("part", "p_partkey % 100 < 12 and p_partkey < 200"), ("lineitem", "l_partkey % 100 < 12 and l_partkey < 200"), ("orders", "o_orderkey % 8 = 1")):
        fixtures.table(spark, SF, name).where(rows).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def small_plain(spark, small):
    return Plain(spark, small)


@pytest.fixture(scope="module")
def small_ready(spark, small):
    return voyages._search(spark, small)


def near(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6))


def by_rounds(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.trip, {})[r.round] = r
    return got


def test_every_cheapest_way_equals_a_plain_search(spark, plain, ready):
    search = replace(ready[1], p=replace(DEFAULT, rounds=1))
    trips = {t.trip: t for t in search.trips.collect()}
    rows = ways.refined(search).collect()
    assert {r.trip for r in rows} == trips.keys() and len(rows) > 1000
    for r in rows:
        t = trips[r.trip]
        (now, best), = plain.rounds(t, 1)
        assert near(r.cost, now) and near(r.best_cost, best) and r.path[0] == t.start_node and r.path[-1] == t.end_node
        assert all(b in plain.out[a] for a, b in zip(r.path, r.path[1:]))


def test_rounds_equal_a_plain_search(small_plain, small_ready):
    trips = {t.trip: t for t in small_ready[1].trips.collect()}
    got = by_rounds(ways.refined(small_ready[1]))
    assert got.keys() == trips.keys() and len(trips) > 50 and max(map(len, got.values())) > 1
    for k, t in trips.items():
        want = small_plain.rounds(t, DEFAULT.rounds)
        assert len(want) == len(got[k]) and all(near(got[k][i].cost, c) and near(got[k][i].best_cost, b) for i, (c, b) in enumerate(want))


@pytest.mark.parametrize("cap", [80.0, 40.0])
def test_ways_that_break_a_tight_cap_are_searched_by_pairs(small_plain, small_ready, cap):
    trips = {t.trip: t for t in small_ready[1].trips.collect()}
    got = by_rounds(ways.refined(replace(small_ready[1], p=replace(DEFAULT, rounds=1, turn_cap_deg=cap))))
    want = {k: small_plain.rounds(t, 1, cap)[0] for k, t in trips.items()}
    assert got.keys() == trips.keys() and sum(not near(small_plain.rounds(t, 1)[0][0], want[k][0]) for k, t in trips.items()) > 5
    assert all(near(got[k][0].cost, now) and near(got[k][0].best_cost, best) for k, (now, best) in want.items())


def test_queries_of_searches(spark, small, small_plain):
    """Routes, rounds and single aims of every voyage, by value."""
    rounds, costs = {}, {}
    for r in voyages.refine_rounds(spark, small).collect():
        rounds.setdefault(r.voyage_id, {})[r.round] = r
    costs = {r.voyage_id: r for r in voyages.turn_aware_cost(spark, small).collect()}
    routes = {r.voyage_id: r for r in voyages.voyage_route(spark, small).collect()}
    assert rounds.keys() == costs.keys() == routes.keys() and len(routes) > 80
    for k, r in routes.items():
        last = rounds[k][max(rounds[k])]
        assert r.cost == last.best_cost and costs[k].cost == rounds[k][0].cost and r.cost <= costs[k].baseline_cost + 1e-4
        assert near(r.km, math.floor(sum(small_plain.out[a][b].km for a, b in zip(r.path, r.path[1:])) * 1e4 + 0.50001) / 1e4)
    search = voyages._search(spark, small, pareto=True)
    trips = {(t.start_key, t.end_key, t.profile): t for t in search[0].join(search[1].trips.select("trip", "total", "base_path"), "trip").collect()}
    keys = {r.voyage_id: (r.start_key, r.end_key) for r in fixtures.voyages(spark, small).collect()}
    aims = voyages.pareto_routes(spark, small).collect()
    assert len(aims) > 150 and {r.label for r in aims} == set(DEFAULT.pareto)
    for r in aims:
        t = trips.get((*keys[r.voyage_id], r.label))
        want = small_plain.rounds(t, DEFAULT.rounds)[-1][1] if t else 0.0
        assert abs(r.cost - want) < 1e-3


def test_no_python_in_searches(spark, small_ready):
    plan = lambda df: df._jdf.queryExecution().toString()
    for df in (voyages.voyage_baseline(spark, SF), voyages.node_arrival_hours(spark, SF), small_ready[1].trips, small_ready[1].trees, small_ready[1].outs):
        assert "Python" not in plan(df) and "Pandas" not in plan(df) and "Arrow" not in plan(df)


def test_arrivals_of_every_trip(spark, plain):
    found, _ = voyages._baselines(spark, SF)
    base = {(r.start_key, r.end_key): r for r in found.collect()}
    got = {}
    for r in voyages.arrivals(spark, SF).collect():
        got.setdefault((r.start_key, r.end_key), {})[r.node] = r.arrival_h
    assert got.keys() == {k for k, r in base.items() if r.km is not None}
    for k, nodes in got.items():
        r, left = base[k], plain.left(base[k].end_node)
        total = left[r.start_node]
        assert nodes == {n: math.floor(max(0.0, total - x) / DEFAULT.km_per_hour) for n, x in left.items() if x <= total + 1e-6}


def random_graph(spark, n=150, seed=5):
    rng = random.Random(seed)
    place = {i: (rng.uniform(-3, 3), 179 + rng.uniform(-3, 3)) for i in range(n)}
    edges = [(a, b, km(*place[a], *place[b]) * rng.uniform(1, 3), *place[a], *place[b]) for a in place for b in sorted(place, key=lambda x: km(*place[a], *place[x]))[1:4]]
    return place, edges, spark.createDataFrame(edges, "src long, dst long, km double, lat1 double, lon1 double, lat2 double, lon2 double")


def test_baselines_widen_where_ways_are_long_or_missing(spark):
    """One-way edges longer than the straight line: first bounds are too small, and some trips have no way at all."""
    place, edges, df = random_graph(spark)
    rng = random.Random(1)
    trips, rows = {}, []
    for k in range(60):
        a, b = rng.sample(sorted(place), 3), rng.sample(sorted(place), 3)
        trips[k, k + 1] = (a, b)
        rows.append((k, k + 1, *place[a[0]], *place[b[0]], [{"node_id": x, "km": float(i)} for i, x in enumerate(a)], [{"node_id": x, "km": float(i)} for i, x in enumerate(b)]))
    t = spark.createDataFrame(rows, "start_key long, end_key long, lat_a double, lon_a double, lat_b double, lon_b double, starts array<struct<node_id:long,km:double>>, ends array<struct<node_id:long,km:double>>")
    step = {(a, b): x for a, b, x, *_ in edges}

    def distances(start):
        heap, got = [(0.0, start)], {}
        while heap:
            c, at = heapq.heappop(heap)
            if at not in got:
                got[at] = c
                for (a, b), x in step.items():
                    if a == at:
                        heapq.heappush(heap, (c + x, b))
        return got

    far = {x: distances(x) for x in {x for a, _ in trips.values() for x in a}}
    found = {(r.start_key, r.end_key): r for r in ways.baselines(t, df)[0].collect()}
    assert found.keys() == trips.keys()
    for k, (a, b) in trips.items():
        want = min((far[x][y] for x in a for y in b if y in far[x]), default=None)
        assert near(found[k].km, want)
        if want is not None:
            assert found[k].path[0] == found[k].start_node and near(sum(step[x] for x in zip(found[k].path, found[k].path[1:])), want)
    assert any(r.km is None for r in found.values()) and any(r.km is not None for r in found.values())


def test_read_back_follows_long_pointers(spark):
    rng = random.Random(3)
    then = {(g, i): rng.randrange(max(0, i - 3), i) if i else None for g in range(3) for i in range(200)}
    pointers = spark.createDataFrame([(g, i, t) for (g, i), t in then.items()], "g long, at long, then long")
    heads = [(g, h, f"h{g}{h}") for g in range(2) for h in (0, 1, 7, 199)]
    got = {}
    for r in ways.read_back(spark.createDataFrame(heads, "g long, at long, name string"), pointers, ["g"]).collect():
        assert (r.name, r.seq) not in got
        got[r.name, r.seq] = r.at
    want = {}
    for g, h, name in heads:
        seq = 0
        while h is not None:
            want[name, seq] = h
            h, seq = then[g, h], seq + 1
    assert got == want


@pytest.mark.parametrize("radius", [r for _, r in ways.RADII])
def test_corridors_equal_brute_force(spark, radius):
    rng = random.Random(int(radius))
    place = {i: (rng.uniform(-80, 80), (rng.uniform(0, 360) + 180) % 360 - 180) for i in range(1500)}
    paths = {(i, i + 1): rng.sample(sorted(place), 4) for i in range(6)}
    nodes = spark.createDataFrame([(i, *x) for i, x in place.items()], "node_id long, lat double, lon double")
    found = spark.createDataFrame([(*k, radius, p) for k, p in paths.items()], "start_key long, end_key long, radius_km double, path array<long>")
    got = {}
    for r in ways.corridors(found, nodes).collect():
        got.setdefault((r.start_key, r.end_key), []).append(r.node_id)
    for k, p in paths.items():
        assert sorted(got[k]) == sorted(n for n, at in place.items() if any(km(*at, *place[x]) <= radius for x in p))


def test_nearest_of_a_cloud_of_any_density(spark):
    from fathomline.operators import weather

    rng = random.Random(2)
    cloud = {i: (rng.gauss(10, 0.01), 180 + rng.gauss(0, 0.02)) for i in range(300)} | {i: (rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(300, 420)} | {i: (0.0, 0.0) for i in range(420, 440)}
    cloud = {i: (a, (b + 180) % 360 - 180) for i, (a, b) in cloud.items()}
    places = {i: (rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)} | {i: (rng.gauss(10, 0.05), (180 + rng.gauss(0, 0.05) + 180) % 360 - 180) for i in range(150, 250)} | {250: (0.0, 0.0), 251: (89.9, 10.0)}
    frame = lambda rows, c: spark.createDataFrame([(i, *x) for i, x in rows.items()], c)

    def d2(a, b):
        turn = (b[1] - a[1] + 180) % 360 - 180
        return math.floor(((b[0] - a[0]) ** 2 + (turn * max(math.cos(math.radians(a[0])), 0.2)) ** 2) * 1e9 + 0.50001) / 1e9

    for k, some in ((6, cloud), (6, dict(list(cloud.items())[:4])), (25, cloud)):
        got = {}
        for r in weather.nearest(frame(places, "place long, lat double, lon double"), frame(some, "o long, lat_o double, lon_o double"), k).collect():
            got.setdefault(r.place, {})[r["rank"]] = r.o
        for i, at in places.items():
            want = sorted(some, key=lambda x: (d2(at, some[x]), x))[:k]
            assert [got[i][n + 1] for n in range(len(want))] == want and len(got[i]) == len(want)


def test_weather_at_hours_by_definition(spark):
    from fathomline.operators import weather

    rng = random.Random(4)
    value = lambda c: None if rng.random() < 0.4 else rng.uniform(0, 359)
    seen = {(o, h): {c: value(c) for c in weather.FIELDS} for o in range(5) for h in (0, 3) if rng.random() < 0.8}
    near_ = {(p, o): rng.uniform(0.1, 9) for p in range(4) for o in range(5) if p < 3}
    rows = weather.at_hours(spark.createDataFrame([(p, h) for p in range(3) for h in (0, 3, 3, 6)], "place long, step_h long"), spark.createDataFrame([(*k, w) for k, w in near_.items()], "place long, o long, w double"),
                            spark.createDataFrame([(*k, *v.values()) for k, v in seen.items()], "o long, step_h long, " + ", ".join(f"{c} double" for c in weather.FIELDS))).collect()
    assert len(rows) == 9
    for r in rows:
        for c in weather.FIELDS:
            has = [(w, seen[o, r.step_h][c]) for (p, o), w in near_.items() if p == r.place and seen.get((o, r.step_h), {}).get(c) is not None]
            if not has:
                want = DEFAULT.defaults[c]
            elif c.endswith("_dir"):
                want = math.degrees(math.atan2(sum(w * math.sin(math.radians(x)) for w, x in has), sum(w * math.cos(math.radians(x)) for w, x in has))) % 360
            else:
                want = sum(w * x for w, x in has) / sum(w for w, _ in has)
            assert math.isclose(r[c], want, abs_tol=1e-5)
    hours = spark.range(-5, 90).selectExpr("id", "cast(id as double) as h").select("id", weather.step_of(geo.col("h")).alias("s")).collect()
    assert all(r.s == min(range(0, 73, 3), key=lambda s: (abs(s - min(max(r.id, 0), 71)), s)) for r in hours)


@pytest.mark.parametrize("radius", [r for _, r in ways.RADII])
def test_corridor_sums_equal_brute_force(spark, radius):
    """Cells count as they are where they lie inside whole; latitudes that go round again are the same places, and nothing is broadcast."""
    rng = random.Random(int(radius))
    place = {i: (rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(1500)} | {1500: (90.0, 0.0), 1501: (0.0, 180.0), 1502: (-90.0, -180.0)}
    place |= {2000 + i: (place[i][0] + 360, place[i][1]) for i in range(0, 1500, 3)}
    paths = {(i, i + 1): rng.sample(sorted(place), 1 + 4 * i) for i in range(6)} | {(7, 8): [1500, 1501, 1502]}
    nodes = spark.createDataFrame([(i, *x) for i, x in place.items()], "node_id long, lat double, lon double")
    found = spark.createDataFrame([(*k, radius, p) for k, p in paths.items()], "start_key long, end_key long, radius_km double, path array<long>")
    made = ways.corridor_sums(found, nodes)
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.start_key, r.end_key): (r.nodes, r.node_sum) for r in made.collect()}
    for k, p in paths.items():
        inside = [n for n, at in place.items() if any(km(*at, *place[x]) <= radius for x in p)]
        assert got[k] == (len(inside), sum(inside))


def test_corridors_are_counted_by_cells():
    """A corridor of 2,000 km is told by fewer cells than it has cells of the smallest size; only its edge is compared place by place."""
    import numpy as np

    codes, near = ways._cells_of(np.array([[1.0, 0.0, 0.0]]), 2000.0)
    assert len(codes) == len(set(codes.tolist())) and len(codes) < 400 and 0 < near.any(1).sum() < 200


def test_ways_longer_than_the_globe_is_round(spark):
    """A trip between two places a kilometre apart whose only way takes sixty steps of a thousand kilometres, and one without any way."""
    steps = [(i, i + 1, 1000.0) for i in range(60)] + [(70, 71, 1.0)]
    snap = lambda n: [(n, 0.0)]
    t = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0, 0.01, snap(0), snap(60)), (3, 4, 0.0, 0.0, 0.0, 0.01, snap(0), snap(71))],
                              "start_key long, end_key long, lat_a double, lon_a double, lat_b double, lon_b double, starts array<struct<node_id:long,km:double>>, ends array<struct<node_id:long,km:double>>")
    found = {r.start_key: r for r in ways.baselines(t, spark.createDataFrame(steps, "src long, dst long, km double"))[0].collect()}
    assert found[1].km == 60_000.0 and found[1].path == list(range(61)) and found[3].km is None
