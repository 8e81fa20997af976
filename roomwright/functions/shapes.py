"""Column functions on segments, arcs, points and rings. A ring is an array of (x, y) structs without a repeated end."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise ring."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def length(sx: Column, sy: Column, ex: Column, ey: Column) -> Column:
    return F.hypot(ex - sx, ey - sy)


def angle(sx: Column, sy: Column, ex: Column, ey: Column) -> Column:
    """Degrees from -180 to 180."""
    return F.degrees(F.atan2(ey - sy, ex - sx))


def sweep(start: Column, end: Column) -> Column:
    """Degrees counter-clockwise from start to end, 360 for none."""
    turn = F.pmod(end - start, F.lit(360.0))
    return F.when(turn == 0, 360.0).otherwise(turn)


def is_door_arc(radius_m: Column, sweep_deg: Column) -> Column:
    return radius_m.between(0.65, 1.10) & sweep_deg.between(60.0, 105.0)


def chords(sweep_deg: Column, per_quarter: int = 12) -> Column:
    """Number of chords of an arc."""
    return F.greatest(F.lit(3), F.floor(F.lit(per_quarter) * (sweep_deg / 90.0)).cast("int"))


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, sweep_deg: Column, n: Column) -> Column:
    """The n + 1 points of n chords."""

    def at(k: Column) -> Column:
        a = F.radians(start + sweep_deg * k / n)
        return point(cx + radius * F.cos(a), cy + radius * F.sin(a))

    return F.transform(F.sequence(F.lit(0), n), at)


def next_points(ring: Column) -> Column:
    """The ring begun at its second point."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    """array<struct<a, b>> of the ring's edges."""
    return F.arrays_zip(ring.alias("a"), next_points(ring).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def centroid(ring: Column) -> Column:
    """Centre of mass of the ring's area."""

    def moment(axis: str) -> Column:
        return _sum(F.transform(edges(ring), lambda e: (e["a"][axis] + e["b"][axis]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / (6 * signed_area(ring))

    return point(moment("x"), moment("y"))


def bounds(ring: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def compactness(area_value: Column, perimeter_value: Column) -> Column:
    """4 pi area / perimeter squared, at most 1; 1 for a ring without length."""
    return F.when(perimeter_value < 1e-9, 1.0).otherwise(F.least(F.lit(1.0), F.lit(4 * math.pi) * area_value / (perimeter_value * perimeter_value)))


def side_ratio(width: Column, height: Column) -> Column:
    """Longer by shorter side, the shorter one at least 1e-9."""
    return F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1e-9))


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point from the ring's line."""

    def one(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        norm = dx * dx + dy * dy
        t = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / norm))).otherwise(0.0)
        return F.hypot(e["a"]["x"] + t * dx - x, e["a"]["y"] + t * dy - y)

    return F.array_min(F.transform(edges(ring), one))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies strictly inside: an odd number of edges to its right, and not on the line itself."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    odd = F.size(F.filter(edges(ring), crosses)) % 2 == 1
    return odd & (distance_to_ring(ring, x, y) > 0)
