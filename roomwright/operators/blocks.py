"""Blocks in rooms: furniture and the room types they suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_hint, block_type_v1
from .spatial import points_in_rooms


def blocks_in_rooms(blocks: DataFrame, rooms: DataFrame) -> DataFrame:
    """drawing_id, block_no, name, room_no: the lowest room that strictly holds each block; others are left out."""
    found = points_in_rooms(blocks.select("drawing_id", "block_no", "name", "x", "y"), rooms)
    return found.groupBy("drawing_id", "block_no", "name").agg(F.min("room_no").alias("room_no"))


def furniture(placed: DataFrame, kind=None) -> DataFrame:
    """drawing_id, room_no, furniture: types other than GENERIC in block order. kind: name -> type, default the hint's word."""
    named = block_hint(F.col("name"))["type"] if kind is None else kind(F.col("name"))
    rows = placed.select("drawing_id", "room_no", F.struct("block_no", named.alias("type")).alias("b")).where(F.col("b.type") != "GENERIC")
    return rows.groupBy("drawing_id", "room_no").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["type"]).alias("furniture"))


def furniture_v1(placed: DataFrame) -> DataFrame:
    return furniture(placed, block_type_v1)


def block_votes(placed: DataFrame) -> DataFrame:
    """drawing_id, room_no, block_room_hint, block_confidence: the type with the largest sum of confidences (the one suggested
    first on ties), and that sum, at most 1."""
    hints = placed.select("drawing_id", "room_no", "block_no", block_hint(F.col("name")).alias("h")).where(F.col("h.room") != "")
    sums = hints.groupBy("drawing_id", "room_no", F.col("h.room").alias("room")).agg(F.sum("h.confidence").alias("votes"), F.min("block_no").alias("first"))
    best = F.max_by("room", F.struct(F.col("votes"), -F.col("first")))
    return sums.groupBy("drawing_id", "room_no").agg(best.alias("block_room_hint"), F.least(F.lit(1.0), F.max("votes")).alias("block_confidence"))
