"""Doors: which rooms they touch, counts, adjacency, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from .spatial import points_near_rooms


def door_rooms(doors: DataFrame, rooms: DataFrame, snap: float = 1.5, inside_counts: bool = True) -> DataFrame:
    """drawing_id, door_no, room_no: rooms whose line lies within snap + radius of the door's centre, or (current engine) that
    hold the centre. The older engine takes snap 1.0 and inside_counts=False."""
    points = doors.select("drawing_id", "door_no", F.col("cx").alias("x"), F.col("cy").alias("y"), F.coalesce("radius", F.lit(0.0)).alias("radius"))

    def touches(ring: Column, x: Column, y: Column, reach: Column) -> Column:
        close = shapes.distance_to_ring(ring, x, y) <= reach
        return close | shapes.inside(ring, x, y) if inside_counts else close

    return points_near_rooms(points, rooms, F.col("radius") + snap, touches).select("drawing_id", "door_no", "room_no")


def door_counts(links: DataFrame, rooms: DataFrame) -> DataFrame:
    """drawing_id, room_no, door_count of every room, 0 without doors."""
    counts = links.groupBy("drawing_id", "room_no").agg(F.count(F.lit(1)).alias("door_count"))
    return rooms.select("drawing_id", "room_no").join(counts, ["drawing_id", "room_no"], "left").fillna(0, ["door_count"])


def door_adjacency(links: DataFrame) -> DataFrame:
    """drawing_id, i, j (i < j): rooms that share a door."""
    rooms = links.groupBy("drawing_id", "door_no").agg(F.array_sort(F.collect_set("room_no")).alias("r"))
    pairs = F.flatten(F.transform("r", lambda a: F.transform(F.filter("r", lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j")))))
    return rooms.select("drawing_id", F.explode(pairs).alias("p")).select("drawing_id", "p.i", "p.j").distinct()


def door_payload(doors: DataFrame, links: DataFrame) -> DataFrame:
    """Doors with their rooms in order. The width is width_m, or radius_m where that is missing; nothing or 0 is 0.9."""
    touched = links.groupBy("drawing_id", "door_no").agg(F.array_sort(F.collect_list("room_no")).alias("rooms"))
    width = F.coalesce(F.nullif(F.coalesce("width_m", "radius_m"), F.lit(0.0)), F.lit(0.9))
    rows = doors.join(touched, ["drawing_id", "door_no"], "left")
    return rows.select("drawing_id", "door_no", "cx", "cy", width.alias("width_m"), F.coalesce("source", F.lit("unknown")).alias("source"), "layer", F.coalesce("rooms", F.array().cast("array<long>")).alias("connected_rooms"))
