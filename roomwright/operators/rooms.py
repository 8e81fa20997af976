"""Room candidates: faces of the wall graph, their shape, and the filters that leave rooms.

A room table has drawing_id, room_no, ring (counter-clockwise), area_raw (without holes); sized() adds area_sqft, perimeter
and centroid.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes
from . import cells, kernel
from .drawings import fold, fold_arrays, map_columns, pick_rows
from .spatial import box_pairs
from .tables import written

#: Segments of a drawing that one fold cuts at each other; the pairs to compare grow with the square.
SMALL = 2_000
FACE = f"ring {shapes.RING}, area_raw double"


def _from_smallest(points: list) -> list:
    """A ring from its smallest point on."""
    k = min(range(len(points)), key=points.__getitem__)
    return points[k:] + points[:k]


def _as_ring(points: list) -> list[dict]:
    return [{"x": x, "y": y} for x, y in _from_smallest(points)]


def faces(edges: DataFrame) -> DataFrame:
    """drawing_id, ring, area_raw of the bounded faces of noded edges (ax, ay, bx, by)."""

    def trace(owner: np.ndarray, columns: dict) -> tuple:
        return _traced(owner, np.stack([columns[c] for c in ("ax", "ay", "bx", "by")], axis=1))

    return fold_arrays(edges.select("drawing_id", "ax", "ay", "bx", "by"), trace, FACE)


def _traced(owner: np.ndarray, edges: np.ndarray) -> tuple:
    """Owners, rings and areas of the faces of many drawings' edges, which are sorted by owner."""
    return kernel.faces_many(owner, edges)


def noded_faces(segments: DataFrame, small: int = SMALL) -> DataFrame:
    """drawing_id, ring, area_raw of the faces of segments (sx, sy, ex, ey) that are cut wherever they meet.

    Drawings of up to `small` segments are cut and traced in one fold; of larger ones the segments are cut in the cells of a grid,
    which spreads a giant drawing over many tasks, and only dealing and tracing are folds.
    """

    def trace(owner: np.ndarray, columns: dict) -> tuple:
        who, edges = kernel.node_many(owner, np.stack([columns[c] for c in ("sx", "sy", "ex", "ey")], axis=1))
        return _traced(who, edges)

    lines = written(segments.select("drawing_id", "sx", "sy", "ex", "ey").distinct(), "lines")
    sizes = lines.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > small).select("drawing_id")
    inner = fold_arrays(lines.join(large, "drawing_id", "left_anti"), trace, FACE)
    return inner.unionByName(cells.faces(lines.join(large, "drawing_id", "left_semi"), cells.plain_lines).select(inner.columns))


def cycles(edges: DataFrame) -> DataFrame:
    """drawing_id, ring, area_raw of a cycle basis of uncut edges: which basis is not fixed, only its size."""

    def trace(drawing: dict):
        for ring in kernel.cycle_basis([(e["ax"], e["ay"], e["bx"], e["by"]) for e in drawing["edges"]]):
            if len(ring) > 2 and (area := kernel.ring_area(ring)) and kernel.is_simple(ring):
                yield _as_ring(ring if area > 0 else ring[::-1]), abs(area)

    return fold(("edges", edges.select("drawing_id", "ax", "ay", "bx", "by")), {}, trace, FACE)


def with_cycle_fallback(found: DataFrame, edges: DataFrame, fewer_than: int = 2) -> DataFrame:
    """Faces, and for drawings with fewer than so many the cycles of their uncut edges that are no faces yet."""
    counts = found.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("_n"))
    poor = edges.select("drawing_id").distinct().join(counts, "drawing_id", "left").where(F.coalesce("_n", F.lit(0)) < fewer_than).select("drawing_id")
    more = cycles(edges.join(poor, "drawing_id", "left_semi"))
    return found.unionByName(more.join(found.select("drawing_id", "ring"), ["drawing_id", "ring"], "left_anti"))


def faces_or_cycles(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The older engine's choice: the cycles of its edges for drawings without any face; from_cycles tells them."""
    none = edges.join(found.select("drawing_id"), "drawing_id", "left_anti")
    return found.withColumn("from_cycles", F.lit(False)).unionByName(cycles(none).withColumn("from_cycles", F.lit(True)))


def cycles_without_containers(rooms: DataFrame) -> DataFrame:
    """Numbered rooms without those from cycles that contain the centre of another one; faces cannot and stay. Drops from_cycles."""
    cyclic = without_containers(rooms.where("from_cycles"))
    return rooms.where("not from_cycles").unionByName(cyclic.select(*rooms.columns)).drop("from_cycles")


def sized(rooms: DataFrame, sqft: Column | float = 10.7639) -> DataFrame:
    """Adds area_sqft, perimeter, cx, cy."""
    centre = shapes.centroid(F.col("ring"))
    factor = F.lit(sqft) if isinstance(sqft, (int, float)) else sqft
    out = rooms.withColumns({"area_sqft": F.col("area_raw") * factor, "perimeter": shapes.perimeter(F.col("ring")), "_c": centre})
    return out.withColumns({"cx": F.col("_c.x"), "cy": F.col("_c.y")}).drop("_c")


def with_shape(rooms: DataFrame) -> DataFrame:
    """Adds aspect (of the smallest rotated rectangle), compactness and convexity (area by hull area)."""

    def measure(batch) -> list:
        rings, area = kernel.Rings(batch.column("ring")), batch.column("area_raw").to_numpy(zero_copy_only=False)
        long, short = np.maximum(rings.width, rings.height), np.minimum(rings.width, rings.height)
        full = rings.width * rings.height
        for k in np.flatnonzero(~rings.box).tolist():
            ring = rings.ring(k)
            long[k], short[k] = kernel.rotated_sides(ring)
            hull = kernel.hull(ring)
            full[k] = kernel.ring_area(hull) if len(hull) > 2 else 0.0
        return [long / np.maximum(short, 1e-9), np.where(full < 1e-9, 1.0, np.minimum(1.0, area / np.maximum(full, 1e-9)))]

    out = map_columns(rooms, measure, "aspect double, convexity double", rooms.columns)
    return out.withColumn("compactness", shapes.compactness(F.col("area_raw"), shapes.perimeter(F.col("ring"))))


def large_enough(rooms: DataFrame, least_sqft: float = 8.0, sqft: Column | float = 10.7639) -> DataFrame:
    factor = F.lit(sqft) if isinstance(sqft, (int, float)) else sqft
    return rooms.where(F.col("area_raw") >= least_sqft / F.greatest(factor, F.lit(1e-9)))


def without_outer(rooms: DataFrame, times: float = 1.5) -> DataFrame:
    """Without a drawing's largest room, if that is more than so many times as large as the second."""
    by_size = W.partitionBy("drawing_id").orderBy(F.desc("area_raw"), F.desc("ring"))
    ranked = rooms.withColumns({"_k": F.row_number().over(by_size), "_next": F.lead("area_raw").over(by_size)})
    return ranked.where(~((F.col("_k") == 1) & F.coalesce(F.col("area_raw") > F.col("_next") * times, F.lit(False)))).drop("_k", "_next")


def numbered(rooms: DataFrame) -> DataFrame:
    """room_no from 1 by ascending area, then ring; and the name `Room k`."""
    number = F.row_number().over(W.partitionBy("drawing_id").orderBy("area_raw", "ring")).cast("long")
    return rooms.withColumn("room_no", number).withColumn("name", F.concat(F.lit("Room "), F.col("room_no").cast("string")))


def _box_pairs(rooms: DataFrame, condition: Column) -> DataFrame:
    """Ordered pairs a, b of different rooms of a drawing whose bounding boxes meet and for which the condition holds."""
    boxed = rooms.select("drawing_id", F.struct("room_no", "ring", "area_raw", shapes.bounds(F.col("ring")).alias("box")).alias("a"))
    return box_pairs(boxed, boxed.withColumnRenamed("a", "b")).where((F.col("a.room_no") != F.col("b.room_no")) & condition)


def _inside_of(a: Column, b: Column) -> Column:
    """Whether ring a lies in ring b: its points and the middles of its edges are inside or on the line."""

    def in_or_on(p: Column) -> Column:
        return shapes.inside(b, p["x"], p["y"]) | (shapes.distance_to_ring(b, p["x"], p["y"]) < 1e-9)

    middles = F.transform(shapes.edges(a), lambda e: shapes.point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2))
    return F.forall(F.concat(a, middles), in_or_on)


def without_nested(rooms: DataFrame, times: float = 1.05) -> DataFrame:
    """Without rooms that lie within a room more than so many times as large."""
    larger = F.col("b.area_raw") > F.col("a.area_raw") * times
    nested = _box_pairs(rooms, larger).where(_inside_of(F.col("a.ring"), F.col("b.ring"))).select("drawing_id", F.col("a.room_no").alias("room_no")).distinct()
    return rooms.join(nested, ["drawing_id", "room_no"], "left_anti")


def without_containers(rooms: DataFrame, times: float = 1.1) -> DataFrame:
    """Without rooms that contain the centre of a room they exceed by so many times."""

    def others(owner: np.ndarray, rows) -> np.ndarray:
        return ~kernel.holding(owner, kernel.Rings(rows.field("ring")), rows.field("area_raw").to_numpy(zero_copy_only=False), times)

    return pick_rows(rooms, others)


def without_thin(rooms: DataFrame, least: float = 0.10, sqft: float = 35.0) -> DataFrame:
    """Without small rooms (area_sqft) of low compactness."""
    return rooms.where(~((F.col("compactness") < least) & (F.col("area_sqft") < sqft)))
