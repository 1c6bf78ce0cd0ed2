"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import checkpoint


def _around(edges: DataFrame) -> DataFrame:
    """Each edge seen from u, with the smallest node next to u or u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _around(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _around(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): the smallest node that it reaches. Loops and repeats are allowed.

    Every round is an aggregation and a join over edges and is written to the shared folder; the driver gets
    two numbers of each. A hub with many edges is a key of a partial aggregation and of a join that
    adaptive execution can split.
    """
    now = checkpoint(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign["n"] == 0 or sign == before:
            break
        before = sign
        now = checkpoint(_small_star(_large_star(now)))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
