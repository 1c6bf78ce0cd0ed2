"""Least costs by borders of blocks against a plain search, and that rounds don't grow with the longest way."""

import heapq
import random

import pytest

from fathomline.operators import borders, graph


def plain(starts, edges):
    out, heap, got = {}, [(c, n) for n, c in starts], {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    heapq.heapify(heap)
    while heap:
        cost, at = heapq.heappop(heap)
        if at not in got:
            got[at] = cost
            for b, w in out.get(at, ()):
                heapq.heappush(heap, (cost + w, b))
    return got


def graphs():
    rnd = random.Random(5)
    strip = [(r * 10 + c, (r + i) * 10 + c + j, rnd.random()) for r in range(60) for c in range(10) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= r + i < 60 and 0 <= c + j < 10 and rnd.random() < 0.8]
    anywhere = [(rnd.randrange(400), rnd.randrange(400), rnd.choice([0.0, 1.0, rnd.random()])) for _ in range(700)]
    winding = [(a, b, 1.0) for a, b in zip([x for k in range(10) for x in (k, 390 - k)], [x for k in range(10) for x in (390 - k, k + 1)])]
    return {"strip": ([(3, 0.0)], strip), "anywhere": ([(7, 0.5), (300, 0.0), (1000, 2.0)], anywhere), "winding": ([(0, 0.0)], winding), "one block": ([(1, 0.0)], [(1, 2, 1.0), (2, 3, 0.5)]), "no edges": ([(5, 1.0)], [])}


@pytest.mark.parametrize("name", list(graphs()))
def test_costs_equal_a_plain_search(spark, name):
    starts, edges = graphs()[name]
    found = borders.least_costs(spark.createDataFrame(starts, "node long, cost double"), spark.createDataFrame(edges, "src long, dst long, step double"), size=25)
    got, want = {r.node: r.cost for r in found.collect()}, plain(starts, edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    """A line of 5,000 nodes: relaxation wrote a table for every eight hops of it."""
    n, seen = 5000, []
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst", "1d as step")
    kept = graph.checkpoint
    for m in (borders, graph):
        monkeypatch.setattr(m, "checkpoint", lambda df: seen.append(1) or kept(df))
    assert graph.reachable(spark.range(1).selectExpr("id as node"), edges).count() == n
    assert len(seen) < 20
