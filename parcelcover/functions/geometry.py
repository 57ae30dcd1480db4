"""Geometry in built-in functions. A geometry is array<polygon>, polygon array<ring>, ring array<struct<x, y>>.

Ring 0 of a polygon is its exterior, the others are holes; rings are closed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius of the earth in metres.
EARTH = 6371008.8
GEOMETRY = "array<array<array<struct<x: double, y: double>>>>"


def _over_edges(ring: Column, term) -> Column:
    """Sum of term(point, next point) over a ring."""
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("p"), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + term(e["p"], e["q"]))


def _rings(geom: Column, area) -> Column:
    def polygon(p: Column) -> Column:
        holes = F.aggregate(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda acc, r: acc + area(r))
        return area(p[0]) - holes

    return F.aggregate(F.transform(geom, polygon), F.lit(0.0), lambda acc, a: acc + a)


def planar_area(geom: Column) -> Column:
    """Shoelace: exterior less holes."""
    return _rings(geom, lambda r: F.abs(_over_edges(r, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2)


def spherical_area(geom: Column) -> Column:
    """Area on a sphere from longitudes and latitudes in degrees."""
    edge = lambda p, q: F.radians(q["x"] - p["x"]) * (2 + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"])))
    return _rings(geom, lambda r: F.abs(_over_edges(r, edge) * (EARTH * EARTH / 2)))


def bbox(geom: Column) -> Column:
    points = F.flatten(F.flatten(geom))
    return F.struct(F.array_min(points["x"]).alias("minx"), F.array_min(points["y"]).alias("miny"), F.array_max(points["x"]).alias("maxx"), F.array_max(points["y"]).alias("maxy"))


def is_rectangle(geom: Column) -> Column:
    """One closed ring of four corners that fills its bounding box."""
    b = bbox(geom)
    one = (F.size(geom) == 1) & (F.size(geom[0]) == 1) & (F.size(geom[0][0]) == 5)
    return F.coalesce(one & (planar_area(geom) == (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"])), F.lit(False))


def lv95_to_wgs84(east: Column, north: Column) -> tuple[Column, Column]:
    """(longitude, latitude) by the published approximation of about a metre."""
    # The published coefficients.
    y, x = (east - 2600000) / 1e6, (north - 1200000) / 1e6
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lon * 100 / 36, lat * 100 / 36


def wgs84_to_lv95(lon: Column, lat: Column, steps: int = 8) -> tuple[Column, Column]:
    """(east, north) that lv95_to_wgs84() takes to lon, lat. The published approximation begins; as it drifts by metres
    outside the country, steps towards the inverse follow. No point beyond some 8700 km north of Bern is reached, as
    there the published latitude falls again."""

    # The published coefficients.
    def begin(at: Column) -> Column:
        p, q = (at["b"] * 10000 - 169028.66) / 10000, (at["a"] * 10000 - 26782.5) / 10000
        y = (72.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q) / 1e6
        x = (147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p) / 1e6
        return F.struct(y.alias("y"), x.alias("x"), at["a"].alias("a"), at["b"].alias("b"))

    def closer(at: Column, _: Column) -> Column:
        """The longitude's equation solved for y, a step of Newton's method on the latitude's for x."""
        y, x = at["y"], at["x"]
        missed = at["b"] - 16.9023892 - x * (3.238272 - x * (0.002528 + 0.0140 * x)) + y * y * (0.270978 + 0.0447 * x)
        slope = 3.238272 - x * (0.005056 + 0.0420 * x) - 0.0447 * y * y
        return F.struct(F.try_divide(at["a"] - 2.6779094, 4.728982 + x * (0.791484 + 0.1306 * x) - 0.0436 * y * y).alias("y"), (x + F.try_divide(missed, slope)).alias("x"), at["a"].alias("a"), at["b"].alias("b"))

    # An array of one, as its function takes lon and lat by name: they are computed once.
    given = F.array(F.struct((lon * 36 / 100).alias("a"), (lat * 36 / 100).alias("b")))
    found = F.transform(given, lambda at: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin(at), closer))[0]
    return 2600000 + found["y"] * 1e6, 1200000 + found["x"] * 1e6


def reproject(geom: Column, to) -> Column:
    """geom with every point passed through to(x, y)."""

    def point(p: Column) -> Column:
        x, y = to(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geom, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def contains(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point: does a ray to the right cross an odd number of edges."""
    crossing = lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"]), 1.0).otherwise(0.0)
    count = F.aggregate(F.flatten(geom), F.lit(0.0), lambda acc, r: acc + _over_edges(r, crossing))
    return F.pmod(count, F.lit(2.0)) == 1


def to_geojson(geom: Column) -> Column:
    """MultiPolygon as GeoJSON text; null for null."""
    pairs = F.transform(geom, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    return F.when(geom.isNotNull(), F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates"))))


def from_geojson(text: Column) -> Column:
    """Polygon or MultiPolygon text as a geometry; null for anything else."""
    return from_coordinates(F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates"))


def from_coordinates(kind: Column, body: Column) -> Column:
    """The geometry of a GeoJSON type and its coordinates' text; null for other types."""
    one = F.when(kind == "Polygon", F.array(F.from_json(body, "array<array<array<double>>>")))
    many = F.when(kind == "MultiPolygon", F.from_json(body, "array<array<array<array<double>>>>"))
    return F.transform(F.coalesce(many, one), lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
