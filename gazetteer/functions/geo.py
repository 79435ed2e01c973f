"""Geometry as column expressions: distances, projections, containment, rings, tiles.

Lines and rings are arrays of struct<x, y>.  Everything is planar in degrees except `haversine`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on the mean sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How far along the segment (0 to 1) the point nearest to p lies; 0 on a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / n)))


def segments(line: Column) -> Column:
    """An array of points as an array of struct<x1, y1, x2, y2>; lines of one point have none."""
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), pair)


def closest_on_line(line: Column, px: Column, py: Column) -> Column:
    """struct<d2, x, y>: the nearest point of the line and its squared distance; null for a line without segments."""

    def one(s):
        t = along(px, py, s["x1"], s["y1"], s["x2"], s["y2"])
        x, y = s["x1"] + t * (s["x2"] - s["x1"]), s["y1"] + t * (s["y2"] - s["y1"])
        return F.struct(((px - x) * (px - x) + (py - y) * (py - y)).alias("d2"), x.alias("x"), y.alias("y"))

    return F.array_min(F.transform(segments(line), one))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting with half-open edges: is the point inside the closed ring?"""
    crosses = lambda s: ((s["y1"] > py) != (s["y2"] > py)) & (px < (s["x2"] - s["x1"]) * (py - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])
    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    """Is the point on an edge of the ring?"""
    on = lambda s: ((s["x2"] - s["x1"]) * (py - s["y1"]) == (s["y2"] - s["y1"]) * (px - s["x1"])) & px.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & py.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
    return F.exists(segments(ring), on)


def strictly_inside(px: Column, py: Column, ring: Column) -> Column:
    """Inside and not on the boundary; a ring without area holds nothing."""
    return in_ring(px, py, ring) & ~on_ring(px, py, ring)


def in_polygons(px: Column, py: Column, polygons: Column) -> Column:
    """In any part: polygons are arrays of rings, the first the outer one, the others holes."""
    holes = lambda rings: F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: in_ring(px, py, r))
    return F.exists(polygons, lambda rings: in_ring(px, py, rings[0]) & ~holes(rings))


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring (shoelace): positive when counter-clockwise."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda acc, s: acc + s["x1"] * s["y2"] - s["x2"] * s["y1"])


def clockwise(ring: Column) -> Column:
    """The ring with its points in clockwise order."""
    return F.when(twice_area(ring) > 0, F.reverse(ring)).otherwise(ring)


def line_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + F.sqrt((s["x2"] - s["x1"]) * (s["x2"] - s["x1"]) + (s["y2"] - s["y1"]) * (s["y2"] - s["y1"])))


def bbox(line: Column) -> dict[str, Column]:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def closed(line: Column, eps: float = 1e-9) -> Column:
    """Do the ends meet, with at least four points?"""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    return F.coalesce((F.size(line) >= 4) & (F.abs(a["x"] - b["x"]) <= eps) & (F.abs(a["y"] - b["y"]) <= eps), F.lit(False))


def way_geometry(line: Column, area: bool) -> Column:
    """struct<kind, line>: a closed way is a clockwise polygon where areas are wanted, any other a line."""
    shape = closed(line) if area else F.lit(False)
    return F.struct(F.when(shape, F.lit("MultiPolygon")).otherwise(F.lit("LineString")).alias("kind"), F.when(shape, clockwise(line)).otherwise(line).alias("line"))


def tile(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def tiles_of_box(minx: Column, miny: Column, maxx: Column, maxy: Column, size: float) -> Column:
    """All tiles that a box meets, as an array of struct<tx, ty>."""
    xs, ys = F.sequence(tile(minx, size), tile(maxx, size)), F.sequence(tile(miny, size), tile(maxy, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def round5(v: Column) -> Column:
    """Five decimals, halves away from zero, by scaling (not by decimal rounding)."""
    scaled = v * F.lit(1e5)
    return F.signum(scaled) * F.floor(F.abs(scaled) + F.lit(0.5)) / F.lit(1e5)


def coordinate_quality(metres: Column) -> Column:
    """1 at no distance down to 0 at 100 m; a missing distance is best."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - metres / F.lit(1e2))), F.lit(1.0))


def interpolate(a: Column, b: Column, na: Column, nb: Column, n: Column) -> Column:
    """The value between a (at na) and b (at nb) for n."""
    return a + (b - a) * ((n - na) / (nb - na))
