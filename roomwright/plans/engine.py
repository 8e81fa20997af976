"""The whole engines over a corpus of drawings: walls to rooms to labels, as compositions of operators.

Everything is keyed by drawing_id, so one shuffle on it serves the later joins and folds of a stage. Stages that several later
ones read are written once to the shared folder; else every reader would plan and run the whole lineage again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, units
from ..operators import adjacency, blocks, classify, doors, enrich, floors, layers, matching, merge, noding, older, raster, rooms, texts, walls
from ..operators.tables import written
from ..sources import dxf


@dataclass
class Drawing:
    """A corpus of drawings as tables. segments: drawing_id, sx, sy, ex, ey, layer; texts: text_no, text, x, y; doors: door_no,
    cx, cy, radius, source, layer; blocks: block_no, name, x, y. metres, sqft: factors per drawing unit, for all drawings or, with
    scales (drawing_id, metres, sqft), for those that it lacks. sheet: the same parts in one table with the columns of older.SHEET,
    the rows of a drawing one after the other in one partition; the older engine reads it in their place."""

    segments: DataFrame
    texts: DataFrame
    doors: DataFrame
    blocks: DataFrame
    metres: float = 1.0
    sqft: float = 10.7639
    scales: DataFrame | None = None
    sheet: DataFrame | None = None

    def scaled(self, rows: DataFrame) -> DataFrame:
        """Rows with the factors of their drawings, as columns metres and sqft."""
        if self.scales is None:
            return rows.withColumns({"metres": F.lit(self.metres), "sqft": F.lit(self.sqft)})
        found = rows.join(self.scales.select("drawing_id", "metres", "sqft"), "drawing_id", "left")
        return found.withColumns({"metres": F.coalesce("metres", F.lit(self.metres)), "sqft": F.coalesce("sqft", F.lit(self.sqft))})


def from_dxf(table: DataFrame, every_instance: bool = False) -> Drawing:
    """The tables of an entity table, for the current engine or, with every_instance, for the older one. Each drawing has the
    units of its own file. The table is written once, so that files are not parsed again for every reader."""
    table = written(table, "entities")
    flat = dxf.expand(table, every_instance)
    area = units.sqft_per_unit_v1 if every_instance else units.sqft_per_unit
    code = table.groupBy("drawing_id").agg(F.max("units").alias("units"))
    scales = written(code.select("drawing_id", units.metres_per_unit(F.col("units")).alias("metres"), area(F.col("units")).alias("sqft")), "scales")
    if every_instance:
        return Drawing(dxf.segments_v1(flat), dxf.texts_v1(flat), dxf.doors_v1(flat), dxf.blocks_v1(flat), scales=scales)
    return Drawing(dxf.segments(flat), dxf.texts(flat), dxf.doors(flat), dxf.blocks(flat), scales=scales)


def vector_rooms(d: Drawing, least_sqft: float = 8.0) -> DataFrame:
    """Rooms of the wall graph: gaps bridged, walls noded, faces filtered, numbered by area, with area_sqft, centre and shape."""
    walls = layers.wall_layers(layers.layer_counts(d.segments))
    lines = layers.at_least(layers.wall_segments(d.segments, walls), 1e-6, strict=True)
    found = written(rooms.noded_faces(noding.with_bridges(d.scaled(lines), metres=F.col("metres"))), "faces")
    found = d.scaled(rooms.with_cycle_fallback(found, noding.graph_edges(lines, 4))).drop("metres")
    found = written(rooms.numbered(rooms.without_outer(rooms.large_enough(found, least_sqft, F.col("sqft")))), "candidates")
    found = rooms.with_shape(rooms.sized(rooms.without_nested(found), F.col("sqft"))).drop("sqft")
    return written(rooms.numbered(rooms.without_thin(found)), "rooms")


def file_rooms(table: DataFrame, least_sqft: float = 8.0, small: int = rooms.SMALL) -> DataFrame:
    """vector_rooms of files (entities as dxf.entities gives them, not written in between): each file is parsed and its rooms are
    found in one pass, without dealing its rows. Files of more than `small` segments are parsed again for the joins."""
    units_of = F.col("units")
    flat = dxf.expand(table)
    scaled = dxf.segments(flat, "units").withColumns({"metres": units.metres_per_unit(units_of), "sqft": units.sqft_per_unit(units_of)})
    found = written(walls.streamed_rooms(scaled, least_sqft, small, whole=True), "rooms")
    large = found.where("room_no is null").select("drawing_id")
    named = F.concat(F.lit("Room "), F.col("room_no").cast("string"))
    result = rooms.with_shape(rooms.sized(found.where("room_no is not null"), F.col("sqft"))).drop("sqft").withColumn("name", named)
    if large.isEmpty():
        return result
    more = vector_rooms(from_dxf(table.join(large, "drawing_id", "left_semi")), least_sqft)
    return result.unionByName(more.select(*result.columns))


def fused_rooms(vector: DataFrame, seen: DataFrame) -> DataFrame:
    """Vector rooms confirmed by rooms from the picture (with sqft), and picture rooms that no vector room covers; numbered anew."""
    fused = matching.fuse(vector.select("drawing_id", F.col("room_no").alias("no"), "ring"), seen.select("drawing_id", F.col("raster_no").alias("no"), "ring"))
    kept = fused.where("vector_no is not null").join(vector.withColumnRenamed("room_no", "vector_no"), ["drawing_id", "vector_no"])
    extra = rooms.with_shape(rooms.sized(seen, F.col("sqft"))).drop("metres", "sqft").withColumn("name", F.lit("")).withColumnRenamed("raster_no", "_r")
    added = fused.where("raster_no is not null").join(extra, (fused.drawing_id == extra.drawing_id) & (fused.raster_no == extra._r)).drop(extra.drawing_id).drop("_r")
    both = kept.unionByName(added, allowMissingColumns=True)
    return both.withColumnRenamed("position", "room_no").drop("vector_no", "raster_no")


def run_pipeline(d: Drawing, least_sqft: float = 8.0, use_raster: bool = True, raster_size: int = 1024, room_words: DataFrame | None = None, floor_words: DataFrame | None = None, vision: DataFrame | None = None) -> dict[str, DataFrame]:
    """The current engine: rooms (with name, confidence, method, door_count, furniture, adjacent), doors, adjacency.

    room_words, floor_words: recognised words as in enrich. vision: answers by room (drawing_id, room_no, room_type,
    confidence); they are applied to the rooms that would be asked for.
    """
    if not use_raster and room_words is None and floor_words is None and vision is None:
        return _by_floors(d, least_sqft)
    return _by_joins(d, least_sqft, use_raster, raster_size, room_words, floor_words, vision)


def _door_table(d: Drawing, links: DataFrame) -> DataFrame:
    return doors.door_payload(d.doors.withColumns({c: F.lit(None).cast("double") for c in ("width_m", "radius_m") if c not in d.doors.columns}), links)


def _by_floors(d: Drawing, least_sqft: float, small: int = rooms.SMALL) -> dict[str, DataFrame]:
    """The engine as one fold per drawing. Drawings of more than `small` segments take the joins, which spread them over tasks."""
    found = written(walls.drawn_floors(d.segments, d.texts, d.doors, d.blocks, d.scales, d.metres, d.sqft, least_sqft, small), "floors")
    links, edges = (found.select("drawing_id", F.inline(c)) for c in ("links", "edges"))
    result = {"rooms": floors.room_rows(found), "doors": _door_table(d, links), "adjacency": edges, "floors": found, "of": d.segments}
    large = found.where("large").select("drawing_id")
    if large.isEmpty():
        return result
    parts = [t.join(large, "drawing_id", "left_semi") for t in (d.segments, d.texts, d.doors, d.blocks)]
    more = _by_joins(Drawing(*parts, d.metres, d.sqft, d.scales), least_sqft, False)
    out = {k: result[k].unionByName(more[k].select(*result[k].columns)) for k in ("rooms", "adjacency")}
    return out | {"doors": result["doors"].join(large, "drawing_id", "left_anti").unionByName(more["doors"])}


def _by_joins(d: Drawing, least_sqft: float, use_raster: bool, raster_size: int = 1024, room_words: DataFrame | None = None, floor_words: DataFrame | None = None, vision: DataFrame | None = None) -> dict[str, DataFrame]:
    table = vector_rooms(d, least_sqft)
    if use_raster:
        seen = raster.raster_rooms(d.scaled(d.segments), raster_size, sqft=F.col("sqft"))
        table = written(fused_rooms(table, written(d.scaled(seen), "raster")), "fused")
    links = written(doors.door_rooms(d.doors, table), "door-rooms")
    placed = blocks.blocks_in_rooms(d.blocks, table)
    for more in (doors.door_counts(links, table), blocks.furniture(placed), blocks.block_votes(placed)):
        table = table.join(more, ["drawing_id", "room_no"], "left")
    table = written(texts.named(table, texts.assign_texts(table, d.texts)), "named")
    edges = written(adjacency.adjacency(doors.door_adjacency(links), adjacency.shared_walls(table)), "adjacency")
    names = adjacency.neighbour_names(edges, table)
    if room_words is not None or floor_words is not None:
        none = (room_words if room_words is not None else floor_words.withColumns({"room_no": F.lit(0), "conf": F.lit(0.0)})).limit(0)
        table = enrich.ocr_labels(table, room_words if room_words is not None else none, floor_words if floor_words is not None else none)
        table = written(table, "ocr")
    both = adjacency.both_ways(edges)
    result = written(classify.classify_rooms(table, both), "classified")
    if vision is not None:
        first = result.select("drawing_id", "room_no", F.col("label").alias("name"), "confidence")
        known = table.drop("name").join(first, ["drawing_id", "room_no"])
        asked = classify.ask_vision(known).select("drawing_id", "room_no")
        again = classify.classify_rooms(known, both, vision.join(asked, ["drawing_id", "room_no"], "left_semi"), only_seen=True)
        result = again.unionByName(result.join(again.select("drawing_id", "room_no"), ["drawing_id", "room_no"], "left_anti"))
    done = table.drop("name").join(result.withColumnRenamed("label", "name"), ["drawing_id", "room_no"]).join(names, ["drawing_id", "room_no"], "left")
    return {"rooms": done, "doors": _door_table(d, links), "adjacency": edges}


def run_pipeline_v1(d: Drawing, vision: DataFrame | None = None, small: int = rooms.SMALL) -> dict[str, DataFrame]:
    """The older engine: cleaned and snapped walls, merged faces, texts, then geometry or contextual classification.
    vision: drawing_id, room_no, vision_label, vision_confidence.

    One fold per drawing, as its parts stream by. Drawings of more than `small` segments take the joins, which spread them."""
    rows = d.sheet if d.sheet is not None else older.sheet(d.segments, d.texts, d.doors, d.blocks, d.scales)
    found = written(older.floors(rows, d.sqft, small, whole=d.sheet is not None), "floors")
    table = _with_vision(found.select("drawing_id", F.inline("rooms")), vision)
    said = scoring.contextual_choice_v1(*map(F.col, ("rule_label", "rule_confidence", "rule_method", "original_label", "vision_label")), F.coalesce("vision_confidence", F.lit(0.0)))
    table = table.withColumn("_r", said).select("*", "_r.*").withColumnRenamed("label", "name").drop("_r", "rule_label", "rule_confidence", "rule_method")
    result = {"rooms": table, **{to: found.select("drawing_id", F.inline(c)) for to, c in (("links", "links"), ("adjacency", "pairs"))}}
    large = found.where("large").select("drawing_id")
    if large.isEmpty():
        return result
    parts = [t.join(large, "drawing_id", "left_semi") for t in (d.segments, d.texts, d.doors, d.blocks)]
    more = _v1_by_joins(Drawing(*parts, d.metres, d.sqft, d.scales), vision)
    return {k: t.unionByName(more[k].select(*t.columns)) for k, t in result.items()}


def _with_vision(table: DataFrame, vision: DataFrame | None) -> DataFrame:
    if vision is None:
        return table.withColumns({"vision_label": F.lit(None).cast("string"), "vision_confidence": F.lit(0.0)})
    return table.join(vision, ["drawing_id", "room_no"], "left")


def _v1_by_joins(d: Drawing, vision: DataFrame | None = None) -> dict[str, DataFrame]:
    walls = layers.wall_layers_v1(layers.layer_counts(d.segments))
    lines = layers.at_least(layers.wall_segments_v1(d.segments, walls), 0.005)
    edges = noding.snapped_edges(noding.node_edges(lines))
    edges = written(edges, "edges")
    found = rooms.faces_or_cycles(written(rooms.faces(edges), "faces"), edges)
    found = rooms.without_outer(rooms.large_enough(d.scaled(found), 10.0, F.col("sqft")), 1.8).drop("metres", "sqft")
    found = rooms.cycles_without_containers(written(rooms.numbered(found), "candidates"))
    merged = written(merge.merge_rooms(rooms.numbered(found)).withColumnRenamed("part", "room_no"), "merged")
    table = rooms.with_shape(rooms.sized(d.scaled(merged), F.col("sqft"))).drop("metres", "sqft").withColumn("name", F.concat(F.lit("Room "), F.col("room_no").cast("string")))
    links = written(doors.door_rooms(d.doors, table, 1.0, inside_counts=False), "door-rooms")
    table = table.join(doors.door_counts(links, table), ["drawing_id", "room_no"], "left")
    table = classify.geometry_names_v1(texts.named(table, texts.assign_texts(table, d.texts)))
    table = written(table, "named")
    table = table.join(blocks.furniture_v1(blocks.blocks_in_rooms(d.blocks, table)), ["drawing_id", "room_no"], "left")
    table = _with_vision(table, vision)
    pairs = doors.door_adjacency(links)
    done = classify.contextual_v1(table, adjacency.both_ways(pairs))
    return {"rooms": done.drop("name").withColumnRenamed("label", "name"), "links": links, "adjacency": pairs}


def _room(r: Column | dict[str, Column], none: Column) -> Column:
    """A room of the payload."""
    sure = F.coalesce(F.nullif(F.round(r["confidence"], 3), F.lit(0.0)), F.lit(0.5))
    return F.struct(
        r["room_no"].alias("room_no"), r["name"].alias("name"), F.round(r["area_sqft"], 2).alias("area_sqft"), F.coalesce(r["door_count"], F.lit(0)).alias("doors"), F.lit(0).alias("windows"), F.coalesce(r["adjacent"], none).alias("adjacent"), sure.alias("confidence"),
        F.coalesce(r["method"], F.lit("rules")).alias("classification_method"), F.coalesce(r["furniture"], none).alias("furniture"), F.array(F.round(r["cx"], 2), F.round(r["cy"], 2)).alias("centroid"),
        F.transform(r["ring"], lambda p: F.array(F.round(p["x"], 4), F.round(p["y"], 4))).alias("coordinates"),
    )


def payload(result: dict[str, DataFrame], drawings: DataFrame) -> DataFrame:
    """drawing_id, status, payload (JSON text with floors, rooms, doors, adjacency) of every drawing; no_rooms_detected where
    there are none. Areas have two digits, a missing or zero confidence is 0.5."""
    r = result["rooms"]
    none = F.array().cast("array<string>")
    room = _room({c: F.col(c) for c in r.columns}, none)
    if "floors" in result and drawings.select("drawing_id").sameSemantics(result["of"].select("drawing_id")):
        rows = _floor_rows(result["floors"].where("drawn"), none)
    else:
        by = r.groupBy("drawing_id").agg(F.array_sort(F.collect_list(room)).alias("rooms"))
        door = result["doors"].groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("door_no", "cx", "cy", "width_m", "source", "layer", "connected_rooms"))).alias("doors"))
        near = result["adjacency"].groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.array("i", "j"))).alias("adjacency"))
        rows = drawings.select("drawing_id").distinct().join(by, "drawing_id", "left").join(door, "drawing_id", "left").join(near, "drawing_id", "left")
    status = F.when(F.col("rooms").isNull(), "no_rooms_detected").otherwise("completed")
    floor = F.struct(F.lit(1).alias("floor"), "doors", "adjacency", F.coalesce("rooms", F.array()).alias("rooms"))
    return rows.select("drawing_id", status.alias("status"), F.to_json(F.struct(status.alias("status"), F.array(floor).alias("floors"))).alias("payload"))


def _floor_rows(found: DataFrame, none: Column) -> DataFrame:
    """drawing_id, rooms, doors, adjacency of floors as they are, without gathering them again."""
    rooms_ = F.array_sort(F.transform("rooms", lambda r: _room(r, none)))

    def door(d: Column) -> Column:
        touched = F.array_sort(F.transform(F.filter("links", lambda l: l["door_no"] == d["door_no"]), lambda l: l["room_no"]))
        width = F.coalesce(F.nullif(d["width_m"], F.lit(0.0)), F.lit(0.9))
        return F.struct(d["door_no"].alias("door_no"), d["x"].alias("cx"), d["y"].alias("cy"), width.alias("width_m"), F.coalesce(d["source"], F.lit("unknown")).alias("source"), d["layer"].alias("layer"), touched.alias("connected_rooms"))

    edges = F.array_sort(F.transform("edges", lambda e: F.array(e["i"], e["j"])))
    return found.select(
        "drawing_id", F.when(F.size("rooms") > 0, rooms_).alias("rooms"), F.when(F.size("doors") > 0, F.array_sort(F.transform("doors", door))).alias("doors"), F.when(F.size("edges") > 0, edges).alias("adjacency")
    )


def process_files(spark: SparkSession, path: str, **knobs) -> DataFrame:
    """status and payload of the drawings under a path."""
    table = dxf.read_dxf(spark, path)
    return payload(run_pipeline(from_dxf(table), **knobs), table)
