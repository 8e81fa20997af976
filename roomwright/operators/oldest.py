"""The oldest engine's first steps: its own view of the entities, cleaned segments, and cycles as rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import RING
from . import kernel
from .drawings import fold
from .noding import node_edges, snapped_edges
from .rooms import cycles

KINDS = ("LINE", "LWPOLYLINE", "POLYLINE", "TEXT", "MTEXT", "INSERT", "ATTRIB")


def entities_v0(table: DataFrame) -> DataFrame:
    """Model space entities of the kinds that the oldest engine reads, as they are: drawing_id, entity_no, etype, layer, pts, closed,
    text, name, attributes (tag, text). Blocks are not followed."""
    rows = table.where(F.col("block").isNull() & F.col("etype").isin(*KINDS))
    tags = F.transform("attribs", lambda a: F.struct(a["tag"].alias("tag"), a["text"].alias("text")))
    return rows.select("drawing_id", "entity_no", "etype", "layer", "pts", "closed", "text", "name", tags.alias("attributes"))


def clean_segments_v0(segments: DataFrame, tolerance: float = 0.01, least: float = 0.1) -> DataFrame:
    """drawing_id, part, line (points): segments of a least length, cut at each other, their ends snapped to a grid of the
    tolerance, and joined into one line wherever exactly two meet."""
    long = segments.where(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")) >= least)
    edges = snapped_edges(node_edges(long), tolerance, 0.0)

    def join(drawing: dict):
        for k, line in enumerate(kernel.chains([(e["ax"], e["ay"], e["bx"], e["by"]) for e in drawing["edges"]])):
            yield k + 1, [{"x": x, "y": y} for x, y in line]

    return fold(("edges", edges.select("drawing_id", "ax", "ay", "bx", "by")), {}, join, f"part long, line {RING}")


def rooms_v0(edges: DataFrame) -> DataFrame:
    """drawing_id, ring, area_raw: the oldest engine's rooms, the simple cycles of a basis of its edges (ax, ay, bx, by)."""
    return cycles(edges)

