"""Fusing rooms of the vector and the raster path by overlap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shapes
from . import kernel
from .drawings import fold, map_columns
from .spatial import box_pairs
from .tables import written

STRONG, PARTIAL, BLOCKED = 0.70, 0.25, 0.10


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """drawing_id, left_no, right_no, iou of rooms (drawing_id, no, ring) whose bounding boxes overlap; all others have none."""
    a = left.select("drawing_id", F.struct(F.col("no"), "ring", shapes.bounds(F.col("ring")).alias("box")).alias("a"))
    b = right.select("drawing_id", F.struct(F.col("no"), "ring", shapes.bounds(F.col("ring")).alias("box")).alias("b"))
    meet = (F.col("a.box.x0") < F.col("b.box.x1")) & (F.col("b.box.x0") < F.col("a.box.x1")) & (F.col("a.box.y0") < F.col("b.box.y1")) & (F.col("b.box.y0") < F.col("a.box.y1"))
    pairs = box_pairs(a, b).where(meet).select("drawing_id", F.col("a.no").alias("left_no"), F.col("b.no").alias("right_no"), F.col("a.ring").alias("p"), F.col("b.ring").alias("q"))

    def measure(batch) -> list:
        p, q = kernel.Rings(batch.column("p")), kernel.Rings(batch.column("q"))
        common = kernel.common_areas(p, q)
        return [common / np.maximum(np.abs(p.area) + np.abs(q.area) - common, 1e-12)]

    return map_columns(pairs, measure, "iou double", ["drawing_id", "left_no", "right_no"]).where("iou > 0")


def greedy_matches(pairs: DataFrame, least: float = PARTIAL) -> DataFrame:
    """drawing_id, rank, left_no, right_no, iou: pairs by descending (iou, left, right), each room once. One fold per drawing."""

    def match(drawing: dict):
        left, right, rank = set(), set(), 0
        for p in reversed(drawing["pairs"]):
            if p["left_no"] not in left and p["right_no"] not in right:
                left.add(p["left_no"])
                right.add(p["right_no"])
                rank += 1
                yield rank, p["left_no"], p["right_no"], p["iou"]

    rows = pairs.where(F.col("iou") >= least).select("drawing_id", "iou", "left_no", "right_no")
    return fold(("pairs", rows), {}, match, "rank long, left_no long, right_no long, iou double")


def fuse(vector: DataFrame, raster: DataFrame) -> DataFrame:
    """drawing_id, position, vector_no, raster_no, source, raster_confirmed, raster_partial, iou_score.

    Matched vector rooms come first, in the order of matching, then the other vector rooms, then raster rooms that overlap no
    accepted room by more than BLOCKED (they are not compared with each other). Columns: drawing_id, no, ring.
    """
    pairs = written(overlaps(vector, raster), "overlaps")
    matched = written(greedy_matches(pairs), "matches")
    first = matched.select(
        "drawing_id", F.struct(F.lit(0), F.col("rank")).alias("_o"), F.col("left_no").alias("vector_no"), F.lit(None).cast("long").alias("raster_no"), F.lit("vector").alias("source"),
        (F.col("iou") >= STRONG).alias("raster_confirmed"), (F.col("iou") < STRONG).alias("raster_partial"), F.col("iou").alias("iou_score"),
    )
    rest = vector.select("drawing_id", F.col("no").alias("left_no")).join(matched, ["drawing_id", "left_no"], "left_anti")
    none = F.lit(None)
    second = rest.select("drawing_id", F.struct(F.lit(1), F.col("left_no")), "left_no", none.cast("long"), F.lit("vector"), F.lit(False), F.lit(False), none.cast("double"))
    free = raster.select("drawing_id", F.col("no").alias("right_no")).join(matched, ["drawing_id", "right_no"], "left_anti")
    free = free.join(pairs.where(F.col("iou") > BLOCKED), ["drawing_id", "right_no"], "left_anti")
    third = free.select("drawing_id", F.struct(F.lit(2), F.col("right_no")), none.cast("long"), "right_no", F.lit("raster"), F.lit(False), F.lit(False), none.cast("double"))
    rows = first.union(second).union(third)
    return rows.withColumn("position", F.row_number().over(W.partitionBy("drawing_id").orderBy("_o")).cast("long")).drop("_o")


def match_statistics(fused: DataFrame) -> DataFrame:
    """drawing_id, strong, partial, extras."""
    return fused.groupBy("drawing_id").agg(F.count_if("raster_confirmed").alias("strong"), F.count_if("raster_partial").alias("partial"), F.count_if(F.col("source") == "raster").alias("extras"))
