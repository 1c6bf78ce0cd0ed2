"""Graph operators: relaxation rounds over edge tables, and turns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import geo

#: Steps that a round of relaxation goes on before its states are written.
HOPS = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and all run on this machine."""
    if not spark.sparkContext.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(own or tempfile.mkdtemp(prefix="fathomline-"))
    return spark.sparkContext.getCheckpointDir()


#: Whether Spark deletes the files of an execution's shuffles at its end; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Inside it, what is executed leaves no files of its shuffles behind: only for results that are on disk by its end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df without its lineage, written to the shared folder."""
    shared_dir(df.sparkSession)
    with tidied(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # select: an execution is cleaned up as was set when its table was made


_made: dict[tuple, tuple[DataFrame, ...]] = {}


def once(spark: SparkSession, d: str, name: str, make: Callable[[], Iterable[DataFrame]]) -> tuple[DataFrame, ...]:
    """Tables that several queries start from, made once an application for a folder of tables; they lie in the shared folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        _made[key] = tuple(map(checkpoint, make()))
    return _made[key]


class Round:
    """The table of a loop's last round, as Parquet in the shared folder; the one before is removed once nothing reads it."""

    def __init__(self, df: DataFrame) -> None:
        self.at = None
        self.put(df)

    def put(self, df: DataFrame) -> None:
        """Write the next round's rows, which may be made from this one's, and forget this one's."""
        spark, before = df.sparkSession, self.at
        self.at = f"{shared_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
        with tidied(spark):
            df.write.parquet(self.at)
        self.now = spark.read.schema(df.schema).parquet(self.at)
        self._remove(spark, before)

    def drop(self) -> None:
        """Remove the rows, which nothing reads any more."""
        self._remove(self.now.sparkSession, self.at)

    @staticmethod
    def _remove(spark: SparkSession, at: str | None) -> None:
        if at:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def relax(start: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("node",), most: int = 10_000) -> DataFrame:
    """Least cost of every reachable state.

    start: keys and cost. edges: a step, with the keys, the same ones with `to_`, and step. Each round goes HOPS steps on
    from the states that became cheaper, takes the least for each state and keeps what improves; the driver gets
    one count a round. Ends when nothing improves, so costs are exact for steps that aren't negative. Edges are written
    once, with a free step from each state to itself that carries it through a round's hops, and one exchange
    of them serves all hops of a round.
    """
    ks, to = list(keys), [f"to_{k}" for k in keys]
    both_ends = edges.select(*ks).unionByName(edges.select(*[F.col(t).alias(k) for k, t in zip(ks, to, strict=True)])).distinct()
    stay = both_ends.select(*ks, *[F.col(k).alias(t) for k, t in zip(ks, to, strict=True)], F.lit(0.0).alias("step"))
    steps = checkpoint(edges.select(*ks, *to, F.col("step").cast("double").alias("step")).unionByName(stay))
    best = checkpoint(start.select(*ks, "cost"))
    front = best
    for _ in range(most):
        tried = front
        for _ in range(HOPS):
            tried = tried.join(steps, ks).select(*[F.col(t).alias(k) for k, t in zip(ks, to, strict=True)], (F.col("cost") + F.col("step")).alias("cost"))
            tried = tried.groupBy(*ks).agg(F.min("cost").alias("cost"))
        joined = tried.withColumnRenamed("cost", "new").join(best, ks, "full")
        joined = joined.withColumn("better", F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost") - 1e-9)))
        state = checkpoint(joined.select(*ks, F.when(F.col("better"), F.col("new")).otherwise(F.col("cost")).alias("cost"), "better"))
        front = state.where("better").drop("better")
        best = state.drop("better")
        if front.isEmpty():
            return best
    raise ValueError(f"costs still improve after {most} rounds of {HOPS} hops: is there a cycle of negative steps?")


def directed(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})).distinct()


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that can be reached from start (node), which count as reached: those with a cost where steps are free."""
    from fathomline.operators.borders import least_costs

    return least_costs(start.select("node", F.lit(0.0).alias("cost")).distinct(), edges.select("src", "dst", F.lit(0.0).alias("step"))).select("node")


def turns(edges: DataFrame, cap: float) -> DataFrame:
    """Pairs of edges (src, via), (via, dst) that turn by no more than cap degrees and don't go straight back; an edge's bearing is taken once.

    edges: src, dst, lat1, lon1, lat2, lon2.
    """
    e = edges.withColumn("bearing", geo.bearing("lat1", "lon1", "lat2", "lon2"))
    a = e.select("src", F.col("dst").alias("via"), F.col("bearing").alias("before"))
    b = e.select(F.col("src").alias("via"), "dst", "bearing")
    turned = a.join(b, "via").where("src <> dst").withColumn("turn_deg", geo.rounded(geo.fold("before", "bearing"), 4))
    return turned.where(F.col("turn_deg") <= cap).select("src", "via", "dst", "turn_deg")
