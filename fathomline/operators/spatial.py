"""Joins on the sphere by cells: radius and nearest neighbours as equi-joins on neighbouring cells."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.operators.graph import checkpoint

KM_PER_DEGREE = 111.19


def key_ranges(df: DataFrame, key: str, parts: int = 256) -> Column:
    """The number of a key's range between quantiles; at most parts numbers reach the driver."""
    found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(found))]) if found else F.array().cast("array<bigint>")
    return F.size(F.filter(bounds, lambda b: b <= F.col(key)))


def _cells(df: DataFrame, lat: str, lon: str, size: float, columns: int) -> DataFrame:
    """Rows and columns of cells; columns go round the globe, so that both sides of the date line are neighbours."""
    column = F.pmod(F.floor((F.col(lon) + 180.0) / (360.0 / columns)).cast("long"), F.lit(columns))
    return df.withColumns({"_i": F.floor(F.col(lat) / size).cast("long"), "_j": column.cast("long")})


def _in_box(box: float) -> Column:
    """Whether latitudes and longitudes differ by less than box degrees, as on a map that ends at the date line and goes on beyond the poles."""
    return (F.abs(F.col("lat_o") - F.col("lat")) < box) & (F.abs(F.col("lon_o") - F.col("lon")) < box)


def _place(lat: str, lon: str) -> tuple[Column, Column]:
    """Latitude and longitude of the same place on the globe, where a latitude may go on beyond a pole and round again."""
    turned = F.pmod(F.col(lat) + 90.0, F.lit(360.0))
    back = turned > 180.0
    return F.when(back, 270.0 - turned).otherwise(turned - 90.0), F.pmod(F.col(lon) + F.when(back, 360.0).otherwise(180.0), F.lit(360.0))


def _on_globe(points: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """points joined with the others in the nine cells around each, wherever their latitudes lead.

    A row of cells has as many columns as keep what is within size degrees in three of them at its highest latitude; near a pole one column holds all longitudes.
    """
    # the row that a point looks into decides the columns
    top = F.greatest(F.abs((F.col("_i") - 1) * size - 90.0), F.abs((F.col("_i") + 2) * size - 90.0))
    columns = F.when(top >= 89.0, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0 / size) * F.cos(F.radians(top))))).cast("long")

    def rows(df: DataFrame, lat: str, lon: str, look: list[int]) -> DataFrame:
        at, turn = _place(lat, lon)
        df = df.withColumns({"_i": F.floor((at + 90.0) / size).cast("long"), "_t": turn}).withColumn("_i", F.explode(F.transform(F.array(*map(F.lit, look)), lambda x: F.col("_i") + x)))
        return df.withColumn("_c", columns).withColumn("_j", F.pmod(F.floor(F.col("_t") / 360.0 * F.col("_c")), F.col("_c")).cast("long"))

    p = rows(points, "lat", "lon", [-1, 0, 1]).withColumn("_s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    p = p.where((F.col("_c") > 2) | (F.col("_s") == 0) | ((F.col("_c") == 2) & (F.col("_s") == 1))).withColumn("_j", F.pmod(F.col("_j") + F.col("_s"), F.col("_c")))
    return p.drop("_s", "_c", "_t").join(rows(others, "lat_o", "lon_o", [0]).drop("_c", "_t").hint("merge"), ["_i", "_j"]).drop("_i", "_j")


def within(points: DataFrame, others: DataFrame, km: float, box: float | None = None) -> DataFrame:
    """points (lat, lon, ...) joined with others (lat_o, lon_o, ...) up to km away, with column km.

    Cells are as large as the radius, so that a point looks into nine of them; where a pole
    is within reach, one column holds all longitudes. Joined rows grow with the points within reach of each other, as the result does.
    Latitudes beyond a pole are the places that they lead to. With box, only points whose latitudes and longitudes differ by less than so many degrees count, and cells needn't be wider than it.
    """
    size = km / KM_PER_DEGREE
    if not box:
        return _on_globe(points, others, size).withColumn("km", geo.haversine_km("lat", "lon", "lat_o", "lon_o")).where(F.col("km") <= km)
    top = max([abs(x) for x in points.agg(F.max(F.abs("lat"))).first() if x is not None] + [abs(x) for x in others.agg(F.max(F.abs("lat_o"))).first() if x is not None] + [0.0])
    columns = 1 if top + size >= 89.0 else max(1, int(360.0 * cos(radians(top + size)) // size))
    columns = max(columns, int(360.0 // box))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)[3 - min(columns, 3) :]])
    p = _cells(points, "lat", "lon", size, columns).withColumn("_n", F.explode(near))
    p = p.withColumns({"_i": F.col("_i") + F.col("_n.i"), "_j": F.pmod(F.col("_j") + F.col("_n.j"), F.lit(columns)).cast("long")}).drop("_n")
    j = p.join(_cells(others, "lat_o", "lon_o", size, columns), ["_i", "_j"]).drop("_i", "_j").where(_in_box(box))
    return j.withColumn("km", geo.haversine_km("lat", "lon", "lat_o", "lon_o")).where(F.col("km") <= km)


def nearest(points: DataFrame, key: str, others: DataFrame, other_key: str, k: int, start_km: float, limit_km: float = 20_038.0, box: float | None = None) -> DataFrame:
    """The k nearest others of each point with km and rank (1 first); equal distances, to a millimetre, by other_key.

    Points that have fewer than k within the radius try twice the radius, until all have k or the limit is
    reached; a point's k nearest within a radius are its k nearest. What a round has found and what is left are written,
    so that no round runs again. With box, only others whose latitude and longitude differ by less than so many degrees
    count; a point may then have fewer than k.
    """
    if box:
        limit_km = min(limit_km, 2**0.5 * box * KM_PER_DEGREE + 1.0)  # no two points of a box are farther apart
    out, left, km = None, points, start_km
    while True:
        found = within(left, others, min(km, limit_km), box).withColumn("km", geo.rounded("km"))
        rank = F.row_number().over(Window.partitionBy(key).orderBy("km", other_key))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
        full = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
        done = checkpoint((full if km >= limit_km else full.where(F.col("_n") == k)).drop("_n"))
        out = done if out is None else out.unionByName(done)
        if km >= limit_km:
            return out
        left = checkpoint(left.join(done.select(key).distinct(), key, "left_anti"))
        if left.isEmpty():
            return out
        km *= 2


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_id)."""
    a = edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi")
    return a.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def hex_lattice(nodes: DataFrame, spacing: float, most: int) -> DataFrame:
    """hex_id, lat, lon over the bounding box of nodes: odd rows shifted by half, every ceil(n / most)-th point kept."""
    box = nodes.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    step = spacing * 3**0.5 / 2
    rows = box.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / step))).alias("i"))
    # even and odd rows have the same number of points each, so that a point's place needs no window over all of them
    points = lambda shift: F.floor((F.col("d") - F.col("c") - shift) / spacing) + 1
    even, odd, n_rows = points(0.0), points(spacing / 2), F.floor((F.col("b") - F.col("a")) / step) + 1
    odd_row, before = F.col("i") % 2 == 1, F.floor(F.col("i") / 2)
    rows = rows.withColumns({
        "x0": F.col("c") + F.when(odd_row, spacing / 2).otherwise(0.0), "first": before * (even + odd) + F.when(odd_row, even).otherwise(0),
        "stride": F.ceil((F.ceil(n_rows / 2) * even + F.floor(n_rows / 2) * odd) / most)})
    cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("d") - F.col("x0")) / spacing))).alias("j"))
    p = cells.select("stride", (F.col("first") + F.col("j")).alias("seq"), (F.col("a") + F.col("i") * step).alias("lat"), (F.col("x0") + F.col("j") * spacing).alias("lon"))
    return p.where((F.col("seq") % F.col("stride") == 0) & (F.col("seq") / F.col("stride") < most)).select(F.col("seq").cast("long").alias("hex_id"), "lat", "lon")
