"""Texts: deduplication, and exclusive assignment to rooms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel
from .drawings import fold


def distinct_texts(texts: DataFrame) -> DataFrame:
    """Trimmed, non-empty texts; of those equal in upper case at the same place (two digits) the first stays."""
    rows = texts.withColumn("text", F.trim("text")).where("text <> ''")
    same = W.partitionBy("drawing_id", F.upper("text"), F.round("x", 2), F.round("y", 2)).orderBy("text_no")
    return rows.withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")


def assign_texts(rooms: DataFrame, texts: DataFrame, most: float = 5.0) -> DataFrame:
    """drawing_id, room_no, text_no, text. Rooms choose in turn among the texts that are left: the first one inside, else the
    one nearest to the centre (cx, cy), if within `most`. A drawing is one fold: each choice depends on those before it."""

    def choose(drawing: dict):
        left = list(drawing["texts"])
        for room in drawing["rooms"]:
            ring = [(p["x"], p["y"]) for p in room["ring"]]
            best = next((t for t in left if kernel.contains(ring, t["x"], t["y"])), None)
            if best is None and left:
                near = min(left, key=lambda t: math.hypot(t["x"] - room["cx"], t["y"] - room["cy"]))
                if math.hypot(near["x"] - room["cx"], near["y"] - room["cy"]) <= most:
                    best = near
            if best is not None:
                left.remove(best)
            yield room["room_no"], best and best["text_no"], best and best["text"]

    return fold(("rooms", rooms.select("drawing_id", "room_no", "ring", "cx", "cy")), {"texts": texts.select("drawing_id", "text_no", "text", "x", "y")}, choose, "room_no long, text_no long, text string")


def named(rooms: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rooms with original_label, and it as name where the name is a mere number or missing."""
    rows = rooms.join(assigned.select("drawing_id", "room_no", F.col("text").alias("original_label")), ["drawing_id", "room_no"], "left")
    open_name = F.coalesce(F.col("name") == "", F.lit(True)) | F.col("name").startswith("Room ")
    return rows.withColumn("name", F.when(open_name, F.coalesce("original_label", "name", F.lit(""))).otherwise(F.col("name")))
