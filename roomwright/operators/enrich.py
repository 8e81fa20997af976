"""Answers from outside as side tables: recognised words and vision models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import first_of, ocr_label
from .drawings import fold


def primary_words(words: DataFrame) -> DataFrame:
    """drawing_id, room_no, label: the longest room type among a room's recognised words, the earliest on ties.
    words: drawing_id, room_no, ord, text, conf; words under 0.35 and empty ones do not count."""
    rows = words.where((F.col("conf") >= 0.35) & (F.trim("text") != "")).withColumn("label", ocr_label(F.col("text"))).where("label is not null")
    return rows.groupBy("drawing_id", "room_no").agg(F.max_by("label", F.struct(F.length("label"), -F.col("ord"))).alias("label"))


def floor_words(words: DataFrame, rooms: DataFrame) -> DataFrame:
    """drawing_id, room_no, label: the k-th recognised room type of a floor goes to its k-th smallest room without a label.
    words: drawing_id, ord, text. rooms: drawing_id, room_no, area_sqft, original_label."""
    rows = words.withColumn("label", ocr_label(F.col("text"))).where("label is not null")
    rows = rows.select("drawing_id", "label", F.row_number().over(W.partitionBy("drawing_id").orderBy("ord")).alias("k"))
    free = rooms.where(F.coalesce("original_label", F.lit("")) == "")
    free = free.select("drawing_id", "room_no", F.row_number().over(W.partitionBy("drawing_id").orderBy("area_sqft", "room_no")).alias("k"))
    return rows.join(free, ["drawing_id", "k"]).select("drawing_id", "room_no", "label")


def ocr_labels(rooms: DataFrame, room_words: DataFrame, words: DataFrame) -> DataFrame:
    """Rooms with original_label and label_source (null, ocr, ocr_floor) after both kinds of words."""
    own = primary_words(room_words).select("drawing_id", "room_no", F.col("label").alias("_own"))
    empty = F.coalesce("original_label", F.lit("")) == ""
    rows = rooms.join(own, ["drawing_id", "room_no"], "left")
    rows = rows.withColumn("label_source", F.when(empty & F.col("_own").isNotNull(), "ocr")).withColumn("original_label", F.when(empty, F.col("_own")).otherwise(F.col("original_label"))).drop("_own")
    floor = floor_words(words, rows).select("drawing_id", "room_no", F.col("label").alias("_floor"))
    rows = rows.join(floor, ["drawing_id", "room_no"], "left")
    source = F.when(F.col("_floor").isNotNull(), "ocr_floor").otherwise(F.col("label_source"))
    return rows.withColumn("label_source", source).withColumn("original_label", F.coalesce("_floor", "original_label")).drop("_floor")


def map_answers(answers: DataFrame, unsure: DataFrame) -> DataFrame:
    """drawing_id, room_no, room_type, confidence of answers (drawing_id, room_index, room_type, confidence) with known types.
    An index counts the rooms that were asked for; of several answers to one room the last in index order stays."""
    rows = answers.where(F.col("room_type").isin(*K.ROOM_TYPES)).withColumn("position", F.col("room_index").cast("long"))
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.5))
    found = rows.withColumn("confidence", sure).join(unsure.select("drawing_id", "position", "room_no"), ["drawing_id", "position"])
    best = F.max(F.struct("room_type", "confidence"))
    return found.groupBy("drawing_id", "room_no").agg(best.alias("a")).select("drawing_id", "room_no", "a.*")


def both_answers(bulk: DataFrame, single: DataFrame) -> DataFrame:
    """The answers about whole floors, and those about single rooms where the floor has none."""
    return bulk.unionByName(single.join(bulk, ["drawing_id", "room_no"], "left_anti"))


def labels_by_index(rooms: DataFrame, labels: DataFrame) -> DataFrame:
    """Rooms with vision_label, vision_confidence, and name and confidence replaced, by 1-based room index; labels without a
    confidence have 0.80."""
    found = labels.select("drawing_id", F.col("room_index").cast("long").alias("room_no"), F.col("room_type").alias("vision_label"), F.coalesce(F.col("confidence"), F.lit(0.80)).alias("vision_confidence"))
    return rooms.join(found, ["drawing_id", "room_no"], "left").withColumn("name", F.coalesce("vision_label", "name"))


def grid_points(labels: DataFrame, rooms: DataFrame) -> DataFrame:
    """Labels with x, y: their place on a 3 x 3 grid over the box of the drawing's room centres."""
    box = rooms.groupBy("drawing_id").agg(F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.max("cx").alias("x1"), F.max("cy").alias("y1"))
    place = F.lower(F.trim(F.coalesce("approximate_location", F.lit("center"))))

    def share(axis: int) -> Column:
        return first_of(((place == k, F.lit(v[axis])) for k, v in K.GRID_PLACES.items()), F.lit(0.5))

    def size(low: str, high: str) -> Column:
        return F.when(F.col(high) == F.col(low), 1.0).otherwise(F.col(high) - F.col(low))

    rows = labels.join(box, "drawing_id")
    return rows.withColumns({"x": F.col("x0") + share(0) * size("x0", "x1"), "y": F.col("y0") + share(1) * size("y0", "y1")}).drop("x0", "y0", "x1", "y1")


def labels_by_grid(labels: DataFrame, rooms: DataFrame) -> DataFrame:
    """drawing_id, room_no, label_no, room_type: the nearest pairs of labels and rooms first, each once; on equal distances the
    lower label, then the lower room. labels: drawing_id, label_no, room_type, approximate_location."""

    def match(drawing: dict):
        pairs = sorted((math.hypot(a["x"] - r["cx"], a["y"] - r["cy"]), a["label_no"], r["room_no"], a["room_type"]) for a in drawing["labels"] for r in drawing["rooms"])
        labels_used, rooms_used = set(), set()
        for _, label, room, kind in pairs:
            if label not in labels_used and room not in rooms_used:
                labels_used.add(label)
                rooms_used.add(room)
                yield room, label, kind

    placed = grid_points(labels, rooms).select("drawing_id", "label_no", "room_type", "x", "y")
    return fold(("labels", placed), {"rooms": rooms.select("drawing_id", "room_no", "cx", "cy")}, match, "room_no long, label_no long, room_type string")
