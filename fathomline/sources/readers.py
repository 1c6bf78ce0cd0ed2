"""Readers and sinks: graph files, downloaded forecast files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def node_coordinate(node_id: Column, i: int) -> Column:
    """The i-th number of a node id such as "(-60.25, 45.5)"; null unless it has exactly two."""
    n = F.regexp_extract_all(node_id, F.lit(r"-?\d+\.?\d*"), F.lit(0))
    return F.when(F.size(n) == 2, F.get(n, F.lit(i)).try_cast("double"))


def graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id (a hash of the id's text), lon, lat; nodes whose id isn't a coordinate are left out."""
    n = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path)
    return n.select(F.xxhash64("_id").alias("node_id"), node_coordinate(F.col("_id"), 0).alias("lon"), node_coordinate(F.col("_id"), 1).alias("lat")).where("lon is not null and lat is not null")


def graphml_edges(spark: SparkSession, path: str, fields: tuple[str, ...] = ("weight", "distance")) -> DataFrame:
    """src, dst and the named numbers of every edge, in both directions."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    names = keys.where("_for = 'edge'").select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"))
    e = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data array<struct<_key string, _VALUE string>>").load(path)
    e = e.select(F.xxhash64("_source").alias("src"), F.xxhash64("_target").alias("dst"), F.explode_outer("data").alias("d"))
    e = e.select("src", "dst", F.col("d._key").alias("key"), F.col("d._VALUE").try_cast("double").alias("x")).join(names, "key", "left")
    one = e.groupBy("src", "dst").agg(*[F.max(F.when(F.col("name") == f, F.col("x"))).alias(f) for f in fields])
    return one.unionByName(one.withColumns({"src": F.col("dst"), "dst": F.col("src")})).distinct()


def grib_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and valid (the first four bytes are GRIB) of every file below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", "length", (F.substring(F.col("content"), 1, 4) == F.lit("GRIB").cast("binary")).alias("valid"))


def report(df: DataFrame, path: str, form: str = "csv") -> None:
    """Write a report's table; the columns are those of the query."""
    df.write.format(form).option("header", "true").mode("overwrite").save(path)


def read_report(spark: SparkSession, path: str, schema, form: str = "csv") -> DataFrame:
    """A report's table as it was written, with the columns' types."""
    return spark.read.format(form).option("header", "true").schema(schema).load(path)


def screenshot_bytes(data_url: Column) -> Column:
    """The bytes behind a data URL, or of bare base64."""
    return F.unbase64(F.element_at(F.split(data_url, ","), -1))
