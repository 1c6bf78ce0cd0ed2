"""Least costs over graphs of any diameter: blocks of nodes that meet by their borders only.

Nodes are dealt into blocks of consecutive ids, FAN blocks make one of the next level, and so on up to one block of all. On the way
up a block becomes the least costs between its border nodes (those with an edge that leaves it), and what its own starts cost there;
on the way down the costs of a block's border give those of its parts' borders, and at last of all nodes. So there are twice as
many rounds as levels, which are the logarithm of the ids' range, where relaxation has as many as the longest way has hops. A task holds
one block's edges, or the borders of FAN blocks; these are small where near nodes have near ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.graph import checkpoint

#: Ids of a block of the lowest level, blocks that make one of the next, and pieces in which a lowest block is closed.
SIZE, FAN, PIECES = 1000, 4, 8
#: A part of a block: border nodes (ids) with the last level at which they are border ones, costs between them (d) and from starts (x); or edges between parts (from ids to ends, d).
PART = "block long, ids array<long>, ends array<long>, top array<int>, d array<double>, x array<double>"


def _relaxed(x: np.ndarray, src: np.ndarray, dst: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Costs x of nodes after edges, until none improves."""
    if not len(src) or not np.isfinite(x).any():
        return x
    order = np.argsort(dst, kind="stable")
    src, step = src[order], step[order]
    heads, at = np.unique(dst[order], return_index=True)
    while True:
        new, old = np.minimum.reduceat(x[src] + step, at), x[heads]
        if not (new < old).any():
            return x
        x[heads] = np.minimum(new, old)


def _inner(pdf: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Nodes of a lowest block, what they cost from its starts, and its edges by places of nodes; a start is an edge without a source."""
    block, start = pdf["block"].iloc[0], pdf["src"].isna().to_numpy()
    dst, step = pdf["dst"].to_numpy(np.int64), pdf["step"].to_numpy(float)
    src = pdf["src"].fillna(0).to_numpy(np.int64)
    mine = lambda v: v // size == block
    ids = np.unique(np.concatenate([dst[mine(dst)], src[~start & mine(src)]]))
    x, inside = np.full(len(ids), np.inf), ~start & mine(src) & mine(dst)
    np.minimum.at(x, np.searchsorted(ids, dst[start]), step[start])
    return ids, x, (np.searchsorted(ids, src[inside]), np.searchsorted(ids, dst[inside]), step[inside])


def _between(low: int, high: int, part: np.ndarray, src: np.ndarray, dst: np.ndarray, step: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes to keep among those from low to high, and least steps between them by way of the others.

    Nodes are in the order of their parts; halves of the parts are met first, so that matrices are of borders only.
    """
    if part[low] == part[high - 1]:
        nodes, w = np.arange(low, high), np.full((high - low, high - low), np.inf)
        np.minimum.at(w, (src - low, dst - low), step)
    else:
        found = np.unique(part[low:high])
        cut = low + int(np.searchsorted(part[low:high], found[len(found) // 2]))
        a, b = src < cut, dst < cut
        cross, stay = a != b, keep.copy()
        stay[src[cross]] = stay[dst[cross]] = True
        (n1, w1), (n2, w2) = (_between(lo, hi, part, src[m], dst[m], step[m], stay) for lo, hi, m in ((low, cut, a & b), (cut, high, ~a & ~b)))
        nodes, w = np.concatenate([n1, n2]), np.full((len(n1) + len(n2),) * 2, np.inf)
        w[: len(n1), : len(n1)], w[len(n1) :, len(n1) :] = w1, w2
        np.minimum.at(w, (np.searchsorted(nodes, src[cross]), np.searchsorted(nodes, dst[cross])), step[cross])
    held = keep[nodes]
    for k in np.flatnonzero(~held):
        np.minimum(w, w[:, k, None] + w[k], out=w)
    return nodes[held], w[np.ix_(held, held)]


def _met(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Border nodes of a group's parts in order: part, id, top, costs from starts, and the edges between them by places; a part without costs between its nodes says what is known of them."""
    rows = list(pdf.itertuples(index=False))
    parts = sorted((r for r in rows if r.ends is None and r.d is not None), key=lambda r: r.block)
    ids, owner, top = (np.concatenate([np.empty(0, np.int64), *v]) for v in ([r.ids for r in parts], [np.full(len(r.ids), r.block) for r in parts], [r.top for r in parts]))
    x, at, edges = np.concatenate([np.empty(0), *[r.x for r in parts]]), 0, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for r in parts:
        d = np.reshape(r.d, (len(r.ids), len(r.ids)))
        i, j = np.nonzero(np.isfinite(d))
        edges.append((i + at, j + at, d[i, j]))
        at += len(r.ids)
    for r in rows:
        if r.ends is not None:
            edges.append((np.searchsorted(ids, r.ids), np.searchsorted(ids, r.ends), r.d))
        elif r.d is None:
            np.minimum.at(x, np.searchsorted(ids, r.ids), r.x)
    return owner, ids, top, x, tuple(map(np.concatenate, zip(*edges, strict=True)))


def least_costs(start: DataFrame, edges: DataFrame, size: int = SIZE) -> DataFrame:
    """node and cost, the least from any start, of every node that can be reached.

    start: node and cost. edges: src, dst and step, which isn't negative. Ids are whole numbers; the driver gets their bounds and no more.
    """
    at = lambda c, level: F.floor(F.col(c) / (size * FAN**level)).cast("long")
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("step").cast("double").alias("step"))
    s = start.select(F.lit(None).cast("long").alias("src"), F.col("node").cast("long").alias("dst"), F.col("cost").cast("double").alias("step"))
    e = checkpoint(e.unionByName(s))
    low, high = e.agg(F.least(F.min("src"), F.min("dst")), F.greatest(F.max("src"), F.max("dst"))).first()
    if low is None:
        return start.select("node", "cost")
    levels = 0
    while low // (size * FAN**levels) != high // (size * FAN**levels):
        # blocks of negative ids never meet those of others
        if low < 0 <= high:
            raise ValueError("ids have to be all negative, or none")
        levels += 1

    def meets() -> Column:
        """The level at which both ends of an edge are in one block."""
        found = F.when(F.col("src").isNull(), 0)
        for k in range(levels):
            found = found.when(at("src", k) == at("dst", k), k)
        return found.otherwise(levels)

    e = e.withColumn("meet", meets())
    lowest = e.select(F.explode(F.array_distinct(F.array(F.coalesce(at("src", 0), at("dst", 0)), at("dst", 0)))).alias("block"), "src", "dst", "step", "meet")

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        """A lowest block as a part."""
        ids, x, inside = _inner(pdf, size)
        out = pdf[pdf["meet"] > 0]
        ends = np.concatenate([out["src"].to_numpy(np.int64), out["dst"].to_numpy(np.int64)])
        own = ends // size == pdf["block"].iloc[0]
        border, of = np.unique(ends[own], return_inverse=True)
        top, spot = np.zeros(len(border), np.int32), np.searchsorted(ids, border)
        np.maximum.at(top, of, np.tile(out["meet"].to_numpy(np.int32) - 1, 2)[own])
        keep = np.zeros(len(ids), bool)
        keep[spot] = True
        d = _between(0, len(ids), ids // -(-size // PIECES), *inside, keep)[1]
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [border], "ends": [None], "top": [top], "d": [d.ravel()], "x": [_relaxed(x, *inside)[spot]]})

    def joined(level: int):
        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            """The parts of a group as one, whose border is what has edges beyond this level; other nodes are passed through."""
            owner, ids, top, x, edges = _met(pdf)
            kept = top >= level
            w = _between(0, len(ids), owner, *edges, kept)[1] if len(ids) else np.empty(0)
            return pd.DataFrame({"block": [pdf["up"].iloc[0]], "ids": [ids[kept]], "ends": [None], "top": [top[kept]], "d": [w.ravel()], "x": [_relaxed(x, *edges)[kept]]})

        return join

    def opened(pdf: pd.DataFrame) -> pd.DataFrame:
        """What border nodes of a group's parts cost, from what its own border costs and its starts."""
        owner, ids, _, x, edges = _met(pdf)
        x = _relaxed(x, *edges)
        blocks = np.unique(owner)
        each = lambda v: pd.Series([v[owner == b] for b in blocks], dtype=object)
        return pd.DataFrame({"block": blocks, "ids": each(ids), "ends": None, "top": None, "d": None, "x": each(x)})

    def filled(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """What all nodes of a lowest block cost."""
        ids, x, inside = _inner(pdf, size)
        for r in known.itertuples(index=False):
            np.minimum.at(x, np.searchsorted(ids, r.ids), r.x)
        x = _relaxed(x, *inside)
        return pd.DataFrame({"node": ids[np.isfinite(x)], "cost": x[np.isfinite(x)]})

    def group(level: int, parts: DataFrame) -> DataFrame:
        """Parts with the number of their block at a level, and the edges that join them there."""
        links = e.where(F.col("meet") == level).groupBy(at("src", level).alias("up")).agg(*[F.collect_list(c).alias(c) for c in ("src", "dst", "step")])
        links = links.select(F.lit(None).cast("long").alias("block"), F.col("src").alias("ids"), F.col("dst").alias("ends"), F.lit(None).cast("array<int>").alias("top"), F.col("step").alias("d"), F.lit(None).cast("array<double>").alias("x"), "up")
        return parts.withColumn("up", F.floor(F.col("block") / FAN).cast("long")).unionByName(links)

    parts = [checkpoint(lowest.groupBy("block").applyInPandas(closed, PART))]
    for k in range(1, levels):
        parts.append(checkpoint(group(k, parts[-1]).groupBy("up").applyInPandas(joined(k), PART)))
    known = None
    for k in range(levels, 0, -1):
        g = group(k, parts[k - 1])
        g = g if known is None else g.unionByName(known.withColumn("up", F.col("block")))
        known = checkpoint(g.groupBy("up").applyInPandas(opened, PART))
    known = parts[0].limit(0) if known is None else known
    return checkpoint(lowest.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(filled, "node long, cost double"))
