"""Formulas by golden values and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import geo, risk, vessel
from fathomline.operators import graph


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("make", "want"), [
    (lambda: geo.haversine_nm(45.0, -60.0, 50.0, -10.0), 2011.67399), (lambda: geo.haversine_km(45.0, -60.0, 50.0, -10.0), 3725.62), (lambda: geo.haversine_nm(0.0, 179.5, 0.0, -179.5), 60.0404607),
    (lambda: geo.bearing(45.0, -60.0, 50.0, -10.0), 63.1273073), (lambda: geo.bearing(0.0, 0.0, 0.0, 1.0), 90.0), (lambda: geo.bearing(0.0, 0.0, 0.0, -1.0), 270.0), (lambda: geo.bearing(1.0, 0.0, 0.0, 0.0), 180.0),
    (lambda: risk.safety_risk(50.0, 4.0, 2.0, 5000.0), 0.172409939), (lambda: risk.safety_risk(28.0, 2.2, 0.0, 10000.0), 0.0), (lambda: risk.safety_risk(200.0, 20.0, 50.0, 0.0), 1.16),
    (lambda: risk.display_severity(50.0, 4.0, 2.0, 5000.0), 82.0), (lambda: risk.display_severity(17.5, 2.0, 5.0, 10000.0), 40.0),
    (lambda: geo.opposition(0.0, 0.0), 0.0), (lambda: geo.opposition(180.0, 0.0), 1.0), (lambda: geo.opposition(350.0, 10.0), 0.0301536896), (lambda: geo.opposition(90.0, 0.0), 0.5),
    (lambda: risk.weather_cost(45.0, 180.0, 3.35, 180.0, 2.5, 90.0, 0.0), 0.25), (lambda: geo.direction_from(3.0, -4.0), 323.130102), (lambda: geo.direction_toward(3.0, -4.0), 143.130102),
    (lambda: geo.fold(geo.bearing(0.0, 0.0, 0.0, 1.0), geo.bearing(0.0, 1.0, 1.0, 1.0)), 90.0)])
def test_golden(spark, make, want):
    assert math.isclose(value(spark, make()), want, rel_tol=1e-5, abs_tol=1e-9)


@pytest.mark.parametrize(("args", "want"), [
    ((0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (7.14285714, 10.4166667, 14, 1, 1)), ((4.5, 180.0, 45.0, 0.0, 3.704, 0.0, 0.0), (11.1111111, 20.8333333, 9, 0.5, 2)),
    ((9.0, 180.0, 90.0, 0.0, 0.0, 0.0, 0.0), (23.8095238, 26.0416667, 4.2, 0.3, 2.5))])
def test_vessel(spark, args, want):
    found = vessel.performance(100.0, *args)
    got = [value(spark, found[k]) for k in ("hours", "fuel_t", "ground_kn", "speed_factor", "surge")]
    assert all(math.isclose(g, w, rel_tol=1e-6) for g, w in zip(got, want, strict=True))


def test_edge_prices(spark):
    h, f = 11.1111111111, 20.8333333333
    price = lambda a, b, c, safety, blocked: value(spark, vessel.edge_cost(100.0, h, f, 0.5, F.lit(blocked), a, b, c, F.lit(safety)))
    assert math.isclose(price(1, 0.45, 1, False, False), 35937.2222, rel_tol=1e-6)
    assert math.isclose(price(0.7, 1.5, 1, True, False), 139124.074, rel_tol=1e-6)
    assert math.isclose(price(1, 0.45, 1, False, True), 1026285.71, rel_tol=1e-6)


def test_circular_mean(spark):
    rows = spark.createDataFrame([(350.0,), (10.0,), (30.0,)], "a double")
    assert math.isclose(rows.agg(geo.circular_mean("a").alias("m")).first()["m"], 10.0, abs_tol=1e-9)


def test_distance_properties(spark):
    p = spark.range(300).select(*[(F.rand(i) * 160 - 80).alias(f"a{i}") for i in range(3)], *[(F.rand(9 + i) * 360 - 180).alias(f"o{i}") for i in range(3)])
    d = lambda i, j: geo.haversine_nm(f"a{i}", f"o{i}", f"a{j}", f"o{j}")
    bad = (F.abs(d(0, 1) - d(1, 0)) > 1e-6) | (d(0, 2) > d(0, 1) + d(1, 2) + 1e-6) | ~geo.bearing("a0", "o0", "a1", "o1").between(0, 360)
    assert p.where(bad).count() == 0


def test_relax_equals_search_without_turns(spark):
    import random

    rng = random.Random(3)
    rows = list({(a, b): (a, b, round(rng.uniform(1, 9), 3)) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(70)) if a != b}.values())
    e = spark.createDataFrame(rows, "node long, to_node long, step double")
    got = {r.node: r.cost for r in graph.relax(spark.createDataFrame([(0, 0.0)], "node long, cost double"), e).collect()}
    want, again = {0: 0.0}, True
    while again:
        again = False
        for a, b, c in rows:
            if a in want and want[a] + c < want.get(b, 1e18) - 1e-9:
                want[b], again = want[a] + c, True
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_nearest_and_within_go_round_the_globe(spark):
    """Against brute force, on both sides of the date line and at the poles."""
    import math
    import random

    from fathomline.operators import spatial

    rng = random.Random(5)
    at = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), rng.uniform(-5, 5)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)]))
    points, others = [(i, *at()) for i in range(60)], [(i, *at()) for i in range(150)]
    p, o = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(others, "other long, lat_o double, lon_o double")

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for radius in (50.0, 400.0, 3000.0):
        want = {(a[0], b[0]) for a in points for b in others if km(a, b) <= radius}
        got = [(r.id, r.other) for r in spatial.within(p, o, radius).collect()]
        assert sorted(got) == sorted(want)
    low = p.where("abs(lat) < 60"), o.where("abs(lat_o) < 60")
    want = {(a[0], b[0]) for a in points for b in others if abs(a[1]) < 60 and abs(b[1]) < 60 and km(a, b) <= 400}
    assert sorted((r.id, r.other) for r in spatial.within(*low, 400.0).collect()) == sorted(want)
    found = spatial.nearest(p, "id", o, "other", 3, 100.0).collect()
    for a in points:
        order = sorted((round(km(a, b), 6), b[0]) for b in others)[:3]
        assert [r.other for r in sorted((r for r in found if r.id == a[0]), key=lambda r: r["rank"])] == [i for _, i in order]
