"""Reports on rooms and labels: precision against a labelled corpus, unsure rooms, furnished rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import plain_label

CORPUS = "min_precision double, samples array<struct<file:string,expected_labels:array<string>>>"


def precision(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """drawing_id, precision: the share of a drawing's distinct predicted labels (drawing_id, label) that were expected."""
    own = predicted.select("drawing_id", plain_label(F.col("label")).alias("label")).distinct()
    want = expected.select("drawing_id", plain_label(F.col("label")).alias("label"), F.lit(1).alias("hit")).distinct()
    return own.join(want, ["drawing_id", "label"], "left").groupBy("drawing_id").agg((F.count("hit") / F.count(F.lit(1))).alias("precision"))


def corpus_samples(texts: DataFrame) -> DataFrame:
    """file, label, min_precision of labelled corpora, JSON texts in the column content; samples without labels are left out, a
    missing least precision is 0.5."""
    read = texts.select(F.from_json("content", CORPUS).alias("c")).select(F.coalesce("c.min_precision", F.lit(0.5)).alias("min_precision"), F.explode("c.samples").alias("s"))
    return read.select("s.file", F.explode("s.expected_labels").alias("label"), "min_precision")


def corpus_precision(predicted: DataFrame, samples: DataFrame) -> DataFrame:
    """files, average_precision, passed: the mean precision of predicted labels (drawing_id: a sample's file) over the samples'
    files that have rooms with names or none (then it is 0), and whether it reaches the least one. Files that predicted lacks as
    drawings are not judged."""
    want = samples.select(F.col("file").alias("drawing_id"), "label")
    files = samples.groupBy(F.col("file").alias("drawing_id")).agg(F.max("min_precision").alias("least"))
    judged = files.join(predicted.select("drawing_id"), "drawing_id", "left_semi")
    named = predicted.where(F.coalesce("label", F.lit("")) != "").join(judged, "drawing_id", "left_semi")
    found = judged.join(precision(named, want), "drawing_id", "left").fillna(0.0, ["precision"])
    total = found.agg(F.count(F.lit(1)).alias("files"), F.avg("precision").alias("average_precision"), F.max("least").alias("least"))
    return total.select("files", "average_precision", (F.col("average_precision") >= F.col("least")).alias("passed"))


def unknown_labels(predicted: DataFrame) -> DataFrame:
    """label: predicted labels that are no room type."""
    return predicted.select(plain_label(F.col("label")).alias("label")).where(~F.col("label").isin(*[t.lower() for t in K.ROOM_TYPES])).distinct()


def unsure_rooms(rooms: DataFrame, least: float = K.ASK_VISION_BELOW) -> DataFrame:
    """Rooms whose confidence is missing or under the least one."""
    return rooms.where(F.coalesce("confidence", F.lit(0.0)) < least)


def furnished_rooms(rooms: DataFrame) -> DataFrame:
    """drawing_id, rooms, furnished: how many rooms there are, and how many hold furniture."""
    return rooms.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("rooms"), F.count_if(F.size(F.coalesce("furniture", F.array().cast("array<string>"))) > 0).alias("furnished"))
