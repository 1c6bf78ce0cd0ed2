"""What the text operators share: reading tables, cutting lineage, range blocks, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only if it is unset and all run on this machine."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = own or tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", own)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(own)
    return own


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
    """Cut the lineage of a small or middling table through the shared folder."""
    shared_dir(df.sparkSession)
    with tidied(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # select: an execution is cleaned up as was set when its table was made


#: Bytes of a row group that no partition reaches.
WHOLE = 1 << 30


def written(df: DataFrame, whole: bool = False) -> DataFrame:
    """As checkpoint(), as Parquet: for tables of many rows, which pack well by column.

    Spark may cut a file between row groups and read it in several tasks, or several files in one. With whole, a partition is written as
    one row group, so that what was in one task is in one task again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    with tidied(spark):
        (df.write.option("parquet.block.size", WHOLE) if whole else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    """Words of a text, unchanged; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values that cut an integer column into ranges of similar row counts."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, at, 20 * parts).alias("q")).first()["q"]
    return sorted({int(x) for x in found or []})


def range_block(column: Column, bounds: Iterable[int]) -> Column:
    """The number of bounds at or below a value, found in two short steps; null counts as lowest."""
    bounds = list(bounds)
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    n = F.size(F.filter(heads, lambda x: x <= column))
    inside = F.size(F.filter(F.element_at(nested, n), lambda x: x <= column))
    return F.when(column.isNull() | (n == 0), F.lit(0)).otherwise((n - 1) * step + inside).cast("int")


def quoted(name: str) -> str:
    """A column's name as one that may hold dots and backticks."""
    return "`" + name.replace("`", "``") + "`"


def fresh(name: str, df: DataFrame) -> str:
    """name, or name with as many lines below it as it takes to be none of df's columns in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
