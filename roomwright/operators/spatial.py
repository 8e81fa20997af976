"""Joins of points with rooms. All are equi-joins on the drawing and a grid cell of it, followed by the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes

#: Boxes that a cell of a drawing's grid holds on average, and the most cells along one side.
PER_CELL, MOST_CELLS = 4, 512


def cells_along(count: Column) -> Column:
    """How many cells along each side the extent of so many boxes is cut into."""
    return F.least(F.lit(MOST_CELLS), F.greatest(F.lit(1), F.floor(F.sqrt(count / PER_CELL))))


def points_near_rooms(points: DataFrame, rooms: DataFrame, reach: Column | float, test) -> DataFrame:
    """points x rooms of the same drawing whose bounding box comes within `reach` of the point (columns x, y) and for which
    test(ring, x, y, reach) holds; columns of points, and room_no.

    The rooms' extent is cut into cells, more of them the more rooms there are; a point goes to its own cell (clamped to the
    extent), a room to those that its box, widened by the drawing's largest reach, touches. So a pair meets in one cell only.
    """
    boxed = rooms.select("drawing_id", "room_no", "ring", shapes.bounds(F.col("ring")).alias("_b"))
    extent = boxed.groupBy("drawing_id").agg(F.min("_b.x0").alias("_x0"), F.min("_b.y0").alias("_y0"), F.greatest(F.max("_b.x1") - F.min("_b.x0"), F.max("_b.y1") - F.min("_b.y0"), F.lit(1e-9)).alias("_size"), cells_along(F.count(F.lit(1))).alias("_grid"))
    if isinstance(reach, (int, float)):  # points need not be made a second time for their largest reach
        reach = F.lit(float(reach))
        frame = extent.withColumn("_most", reach)
    else:
        frame = extent.join(points.groupBy("drawing_id").agg(F.max(reach).alias("_most")), "drawing_id")

    def cell(v: Column, origin: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_grid") - 1, F.floor((v - F.col(origin)) / F.col("_size") * F.col("_grid"))))

    def cells(low: Column, high: Column, origin: str) -> Column:
        return F.sequence(cell(low - F.col("_most"), origin), cell(high + F.col("_most"), origin))

    dealt = boxed.join(frame, "drawing_id").withColumn("_i", F.explode(cells(F.col("_b.x0"), F.col("_b.x1"), "_x0"))).withColumn("_j", F.explode(cells(F.col("_b.y0"), F.col("_b.y1"), "_y0")))
    dealt = dealt.select("drawing_id", "_i", "_j", "room_no", "ring", "_b")
    placed = points.withColumn("_r", reach).join(frame, "drawing_id").withColumns({"_i": cell(F.col("x"), "_x0"), "_j": cell(F.col("y"), "_y0")})
    x, y, r = F.col("x"), F.col("y"), F.col("_r")
    near = (x >= F.col("_b.x0") - r) & (x <= F.col("_b.x1") + r) & (y >= F.col("_b.y0") - r) & (y <= F.col("_b.y1") + r)
    return placed.join(dealt, ["drawing_id", "_i", "_j"]).where(near & test(F.col("ring"), x, y, r)).select(*[F.col(c) for c in points.columns], "room_no")


def box_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows of two tables (drawing_id, a) and (drawing_id, b), structs with a field box, of the same drawing whose boxes
    meet, once each: drawing_id, a, b.

    The left boxes' extent is cut into cells, more of them the more boxes a drawing has (one for up to 15); boxes go to all
    cells that they touch (clamped to the extent), and a pair counts in the cell of the larger low corner only. So work grows
    with the pairs that are near each other, and a giant drawing spreads over its cells.
    """
    size = F.greatest(F.max("a.box.x1") - F.min("a.box.x0"), F.max("a.box.y1") - F.min("a.box.y0"), F.lit(1e-9))
    grid = cells_along(F.count(F.lit(1)))
    frame = left.groupBy("drawing_id").agg(F.min("a.box.x0").alias("_x0"), F.min("a.box.y0").alias("_y0"), size.alias("_size"), grid.alias("_grid"))

    def cell(v: Column, origin: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_grid") - 1, F.floor((v - F.col(origin)) / F.col("_size") * F.col("_grid"))))

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        low = {f"_{name}{k}": cell(F.col(f"{name}.box.{k}0"), f"_{k}0") for k in "xy"}
        high = [F.sequence(F.col(f"_{name}{k}"), cell(F.col(f"{name}.box.{k}1"), f"_{k}0")) for k in "xy"]
        placed = rows.join(frame, "drawing_id").withColumns(low).withColumn("_i", F.explode(high[0])).withColumn("_j", F.explode(high[1]))
        return placed.select("drawing_id", "_i", "_j", name, *low)

    meet = F.lit(True)
    for k in "xy":
        meet &= (F.col(f"a.box.{k}0") <= F.col(f"b.box.{k}1")) & (F.col(f"b.box.{k}0") <= F.col(f"a.box.{k}1"))
    once = (F.col("_i") == F.greatest("_ax", "_bx")) & (F.col("_j") == F.greatest("_ay", "_by"))
    return dealt(left, "a").join(dealt(right, "b"), ["drawing_id", "_i", "_j"]).where(once & meet).select("drawing_id", "a", "b")


def points_in_rooms(points: DataFrame, rooms: DataFrame) -> DataFrame:
    """Points strictly inside rooms."""
    return points_near_rooms(points, rooms, 0.0, lambda ring, x, y, _: shapes.inside(ring, x, y))


def first_room(points: DataFrame, rooms: DataFrame, key: str) -> DataFrame:
    """Each point (drawing_id, key) with the lowest room that holds it; points in no room are left out."""
    return points_in_rooms(points, rooms).groupBy("drawing_id", key).agg(F.min("room_no").alias("room_no"))
