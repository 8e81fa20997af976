"""Room classification of the current engine over whole drawings.

A room's neighbours speak by their names of that moment: rooms before it have their final names, rooms after it still their
labels or numbers. So a drawing is one fold in room order; everything a room brings along (geometry, furniture, label) is
computed as columns before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring
from ..functions.text import room_label
from .drawings import fold

RESULT = "room_no long, label string, confidence double, method string"


def _near(candidate: str, names: list[str]) -> tuple[str, float]:
    hits = sum(n in K.NEXT_TO.get(candidate, ()) for n in names)
    if hits:
        return candidate, min(0.85, 0.4 + 0.15 * hits)
    return (candidate, 0.5) if any(candidate in K.NEXT_TO.get(n, ()) for n in names) else ("", 0.0)


def _vote(signals: list[tuple[str, float]]) -> tuple[str, float]:
    sums: dict[str, float] = {}
    weights = 0.0
    for k, ((label, sure), weight) in enumerate(zip(signals, K.WEIGHTS)):
        if label and sure > 0:
            sums[label] = sums.get(label, 0.0) + sure * weight
        if k == 0 or sure > 0:
            weights += weight
    best = max(sums, key=sums.__getitem__)
    return best, min(1.0, sums[best] / weights)


def prepared(rooms: DataFrame) -> DataFrame:
    """Rooms with what the fold needs: geo and block (label, confidence), and the normalised text label.

    rooms: drawing_id, room_no, name, area_sqft, aspect, compactness, original_label, furniture, block_room_hint,
    block_confidence, raster_confirmed; missing columns count as empty.
    """
    kinds = {"original_label": "string", "furniture": "array<string>", "block_room_hint": "string", "block_confidence": "double", "raster_confirmed": "boolean", "name": "string"}
    rooms = rooms.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rooms.columns})
    text = F.trim(F.coalesce("original_label", F.lit("")))
    return rooms.select(
        "drawing_id", "room_no", F.coalesce("name", F.lit("")).alias("name"),
        scoring.geometry_score(F.col("area_sqft"), F.col("aspect"), F.col("compactness")).alias("geo"),
        scoring.furniture_score(F.col("furniture"), F.col("block_room_hint"), F.col("block_confidence")).alias("block"),
        F.when(text != "", room_label(text)).alias("text_label"), F.coalesce("raster_confirmed", F.lit(False)).alias("confirmed"),
    )


def classify_rooms(rooms: DataFrame, links: DataFrame, vision: DataFrame | None = None, only_seen: bool = False) -> DataFrame:
    """drawing_id, room_no, label, confidence, method.

    links: drawing_id, room_no, other (both ways). vision: drawing_id, room_no, room_type, confidence. only_seen classifies
    just the rooms that vision speaks of, again, on top of the given names.
    """
    near = links.groupBy("drawing_id", "room_no").agg(F.array_sort(F.collect_set("other")).alias("others"))
    rows = prepared(rooms).join(near, ["drawing_id", "room_no"], "left")
    if vision is None:
        rows = rows.withColumn("seen", F.lit(None).cast("struct<label:string,confidence:double>"))
    else:
        seen = vision.select("drawing_id", "room_no", F.struct(F.col("room_type").alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")).alias("seen"))
        rows = rows.join(seen, ["drawing_id", "room_no"], "left")

    def classify(drawing: dict):
        names = {r["room_no"]: r["name"] for r in drawing["rooms"]}
        for r in drawing["rooms"]:
            no = r["room_no"]
            if only_seen and not r["seen"]:
                continue
            if r["text_label"]:
                names[no] = r["text_label"]
                yield no, r["text_label"], 0.90, "cad_label"
                continue
            geo, block = ((r[c]["label"], r[c]["confidence"]) for c in ("geo", "block"))
            seen = (r["seen"]["label"] or "", r["seen"]["confidence"]) if r["seen"] else ("", 0.0)
            around = [names[o] for o in r["others"] or [] if names.get(o)]
            label, sure = _vote([geo, block, _near(block[0] or geo[0], around), seen])
            method = "vision+rules" if seen[0] and seen[1] > 0 else "rules+blocks" if block[0] and block[1] > 0 else "rules"
            if r["confirmed"]:
                sure = min(1.0, sure + 0.05)
                method = "rules+raster" if method == "rules" else method
            names[no] = label
            yield no, label, sure, method

    order = ["room_no", "name", "geo", "block", "text_label", "confirmed", "others", "seen"]
    return fold(("rooms", rows.select("drawing_id", *order)), {}, classify, RESULT)


def ask_vision(rooms: DataFrame) -> DataFrame:
    """Rooms without a text label and with a confidence under 0.75, numbered in order as `position` from 1."""
    unsure = rooms.where(scoring.needs_vision(F.col("original_label"), F.col("confidence")))
    return unsure.withColumn("position", F.row_number().over(W.partitionBy("drawing_id").orderBy("room_no")).cast("long"))


def contextual_v1(rooms: DataFrame, links: DataFrame) -> DataFrame:
    """The older engine's contextual classification. Names are taken before any room is classified, so this is one join.

    rooms: drawing_id, room_no, name, area_sqft, aspect, door_count, furniture, original_label, vision_label,
    vision_confidence. Adds label, confidence, method, needs_ai.
    """
    names = links.join(rooms.select("drawing_id", F.col("room_no").alias("other"), F.col("name").alias("_n")), ["drawing_id", "other"])
    near = names.groupBy("drawing_id", "room_no").agg(F.collect_set("_n").alias("_near"))
    none = F.array().cast("array<string>")
    rows = rooms.join(near, ["drawing_id", "room_no"], "left")
    found = scoring.contextual_v1(
        F.col("area_sqft"), F.col("aspect"), F.col("door_count"), F.coalesce("furniture", none), F.coalesce("_near", none),
        F.col("original_label"), F.col("vision_label"), F.coalesce("vision_confidence", F.lit(0.0)),
    )
    return rows.withColumn("_r", found).select(*[c for c in rooms.columns if c not in ("label", "confidence", "method", "needs_ai")], "_r.*")


def geometry_names_v1(rooms: DataFrame) -> DataFrame:
    """Names from geometry for drawings in which no room has a label."""
    labelled = F.max(F.coalesce(F.col("original_label"), F.lit("")) != "").over(W.partitionBy("drawing_id"))
    rule = scoring.geometry_label_v1(F.col("area_sqft"), F.col("aspect"), F.col("door_count"))
    return rooms.withColumn("_any", labelled).withColumn("name", F.when(F.col("_any"), F.col("name")).otherwise(rule)).drop("_any")
