"""Which rooms adjoin: by doors and by shared walls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from . import kernel
from .drawings import map_columns
from .spatial import box_pairs


def shared_walls(rooms: DataFrame, least: float = 0.3) -> DataFrame:
    """drawing_id, i, j (i < j), length: how much of the second room's line lies inside or on the first."""
    boxed = rooms.select("drawing_id", F.struct("room_no", "ring", shapes.bounds(F.col("ring")).alias("box")).alias("a"))
    pairs = box_pairs(boxed, boxed.withColumnRenamed("a", "b")).where(F.col("a.room_no") < F.col("b.room_no"))
    pairs = pairs.select("drawing_id", F.col("a.room_no").alias("i"), F.col("b.room_no").alias("j"), F.col("a.ring").alias("p"), F.col("b.ring").alias("q"))

    def measure(batch) -> list:
        return [kernel.covered_lengths(kernel.Rings(batch.column("p")), kernel.Rings(batch.column("q")))]

    return map_columns(pairs, measure, "length double", ["drawing_id", "i", "j"]).where(F.col("length") >= least)


def adjacency(by_door: DataFrame, by_wall: DataFrame) -> DataFrame:
    """drawing_id, i, j, source, length: door edges, and wall edges of pairs without one."""
    walls = by_wall.join(by_door, ["drawing_id", "i", "j"], "left_anti").select("drawing_id", "i", "j", F.lit("shared_wall").alias("source"), "length")
    doors = by_door.select("drawing_id", "i", "j", F.lit("door").alias("source"), F.lit(None).cast("double").alias("length"))
    return doors.unionByName(walls)


def both_ways(edges: DataFrame) -> DataFrame:
    """drawing_id, room_no, other, and whether by a door."""
    door = F.lit(True) if "source" not in edges.columns else F.col("source") == "door"
    one = edges.select("drawing_id", F.col("i").alias("room_no"), F.col("j").alias("other"), door.alias("door"))
    return one.unionByName(edges.select("drawing_id", F.col("j").alias("room_no"), F.col("i").alias("other"), door.alias("door"))).distinct()


def neighbour_names(edges: DataFrame, rooms: DataFrame) -> DataFrame:
    """drawing_id, room_no, neighbours (numbers) and adjacent (names), by doors first, then by number."""
    names = rooms.select("drawing_id", F.col("room_no").alias("other"), "name")
    rows = both_ways(edges).join(names, ["drawing_id", "other"])
    order = F.array_sort(F.collect_list(F.struct(~F.col("door"), "other", "name")))
    grouped = rows.groupBy("drawing_id", "room_no").agg(order.alias("n"))
    return grouped.select("drawing_id", "room_no", F.transform("n", lambda v: v["other"]).alias("neighbours"), F.transform("n", lambda v: v["name"]).alias("adjacent"))
