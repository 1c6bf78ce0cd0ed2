"""Readers on small files."""

from pyspark.sql import functions as F

from fathomline.sources import readers

GRAPH = """<?xml version="1.0"?><graphml><key id="d0" for="edge" attr.name="weight"/><key id="d1" for="edge" attr.name="distance"/><graph edgedefault="undirected">
<node id="(-60.25, 45.5)"></node><node id="(-60.0, 45.5)"></node><node id="harbour"></node>
<edge source="(-60.25, 45.5)" target="(-60.0, 45.5)"><data key="d0">1.5</data><data key="d1">19.25</data></edge>
</graph></graphml>"""


def test_graphml(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text(GRAPH)
    nodes = readers.graphml_nodes(spark, str(path)).collect()
    assert sorted((n.lon, n.lat) for n in nodes) == [(-60.25, 45.5), (-60.0, 45.5)]
    edges = readers.graphml_edges(spark, str(path)).collect()
    assert len(edges) == 2 and {(e.weight, e.distance) for e in edges} == {(1.5, 19.25)} and {e.src for e in edges} == {n.node_id for n in nodes}


def test_grib_magic_and_report(spark, tmp_path):
    (tmp_path / "a.grb").write_bytes(b"GRIB\x00\x01")
    (tmp_path / "b.grb").write_bytes(b"<html>")
    got = {r.path.rsplit("/", 1)[1]: r.valid for r in readers.grib_files(spark, str(tmp_path)).collect()}
    assert got == {"a.grb": True, "b.grb": False}
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    readers.report(df, str(tmp_path / "out"))
    assert readers.read_report(spark, str(tmp_path / "out"), df.schema).collect() == df.collect()


def test_screenshot(spark):
    row = spark.createDataFrame([("data:image/png;base64,aGk=",)], "u string").select(readers.screenshot_bytes(F.col("u")).alias("b")).first()
    assert bytes(row.b) == b"hi"
