"""Vector pictures: segments from SVG files, and SVG documents of drawings and rooms."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import drawing
from ..operators.drawings import fold

SEGMENT = "seg_no long, sx double, sy double, ex double, ey double, length double, angle double, layer string"
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_TOKEN = re.compile(r"([MmLlHhVvZzCcQqAa])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
#: How many numbers each path command takes, and which of them are its end point.
_TAKES = {"M": (2, 0, 1), "L": (2, 0, 1), "H": (1, 0, None), "V": (1, None, 0), "C": (6, 4, 5), "Q": (4, 2, 3), "A": (7, 5, 6)}


def path_points(data: str) -> list[tuple[float, float] | None]:
    """End points of a path's commands; curves count by their end point, None lifts the pen. Numbers that follow a closing
    command belong to no command and are skipped."""
    out: list[tuple[float, float] | None] = []
    x = y = x0 = y0 = 0.0
    command, numbers = "M", []
    for letter, number in _TOKEN.findall(data):
        if letter:
            command, numbers = letter, []
            if letter in "Zz":
                out += [(x0, y0), None]
                x, y = x0, y0
            continue
        if command in "Zz":
            continue
        numbers.append(float(number))
        takes, px, py = _TAKES[command.upper()]
        if len(numbers) < takes:
            continue
        bx, by = (x, y) if command.islower() else (0.0, 0.0)
        x, y = (x if px is None else bx + numbers[px]), (y if py is None else by + numbers[py])
        numbers = []
        out.append((x, y))
        if command in "Mm":
            x0, y0 = x, y
            command = "L" if command == "M" else "l"
    return out


def point_list(points: str) -> list[tuple[float, float]]:
    """Pairs of a points attribute; pairs that are no numbers are left out."""
    words = re.split(r"[\s,]+", points.strip())
    return [(float(a), float(b)) for a, b in zip(words[::2], words[1::2]) if _NUMBER.fullmatch(a) and _NUMBER.fullmatch(b)]


def _lines(e: ET.Element, tag: str) -> Iterator[tuple[tuple[float, float], tuple[float, float]]]:
    def n(name: str) -> float:
        return float(e.get(name, 0))

    if tag == "line":
        yield (n("x1"), n("y1")), (n("x2"), n("y2"))
        return
    if tag == "path":
        points = path_points(e.get("d", ""))
        yield from ((a, b) for a, b in zip(points, points[1:]) if a and b)
        return
    if tag == "rect":
        x, y, w, h = n("x"), n("y"), n("width"), n("height")
        points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    else:
        points = point_list(e.get("points", ""))
    yield from zip(points, points[1:])
    if tag == "rect" or (tag == "polygon" and len(points) >= 3):
        yield points[-1], points[0]


def parse(content: str, least: float = 1e-6) -> Iterator[tuple]:
    """Segments of a document's lines, polylines, polygons, paths and rectangles. An odd number of flips around an element
    negates y. Equal segments (four digits, either direction) come once."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return
    seen: set[tuple] = set()
    number = 0
    todo = [(root, 0)]
    while todo:
        e, flips = todo.pop()
        flips += "scale(1,-1)" in e.get("transform", "")
        todo += [(child, flips) for child in reversed(e)]
        tag = e.tag.split("}")[-1] if isinstance(e.tag, str) else ""
        if tag not in ("line", "polyline", "polygon", "path", "rect"):
            continue
        sign = -1.0 if flips % 2 else 1.0
        try:
            lines = list(_lines(e, tag))
        except ValueError:
            continue
        for (ax, ay), (bx, by) in lines:
            ay, by = sign * ay + 0.0, sign * by + 0.0
            size = math.hypot(bx - ax, by - ay)
            key = (round(ax, 4), round(ay, 4), round(bx, 4), round(by, 4))
            if size < least or key in seen or (*key[2:], *key[:2]) in seen:
                continue
            seen.add(key)
            number += 1
            yield number, ax, ay, bx, by, size, math.degrees(math.atan2(by - ay, bx - ax)), e.get("data-layer", "")


def segments(files: DataFrame) -> DataFrame:
    """Segments of (drawing_id, content)."""
    return fold(("files", files.select("drawing_id", "content")), {}, lambda d: (s for f in d["files"] for s in parse(f["content"] or "")), SEGMENT)


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """Segments of the .svg files under a path; drawing_id is the file's path."""
    files = spark.read.option("pathGlobFilter", "*.svg").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return segments(files.select(F.input_file_name().alias("drawing_id"), F.col("value").alias("content")))


def svg_documents(lines: DataFrame, texts: DataFrame | None = None, arcs: DataFrame | None = None, margin: float = 0.02) -> DataFrame:
    """drawing_id, content: lines, arcs and texts of each drawing in a group that is flipped to the screen's direction."""
    parts = lines.select("drawing_id", F.lit(0).alias("o"), drawing.svg_line(*map(F.col, ("sx", "sy", "ex", "ey", "layer"))).alias("e"), F.least("sx", "ex").alias("x0"), F.greatest("sx", "ex").alias("x1"), F.least("sy", "ey").alias("y0"), F.greatest("sy", "ey").alias("y1"))
    if arcs is not None:
        path = F.format_string('<path d="%s" data-layer="%s"/>', drawing.svg_arc(*map(F.col, ("cx", "cy", "radius", "start_deg", "end_deg"))), drawing.escaped(F.col("layer")))
        r = F.col("radius")
        parts = parts.union(arcs.select("drawing_id", F.lit(1), path, F.col("cx") - r, F.col("cx") + r, F.col("cy") - r, F.col("cy") + r))
    if texts is not None:
        parts = parts.union(texts.select("drawing_id", F.lit(2), drawing.svg_text(*map(F.col, ("x", "y", "text", "layer"))), "x", "x", "y", "y"))
    whole = parts.groupBy("drawing_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "e"))), lambda p: p["e"]), "\n").alias("body"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))]
    )
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    edge = F.greatest(w, h) * margin
    x, y, vw, vh = F.col("x0") - edge, F.col("y0") - edge, w + 2 * edge, h + 2 * edge
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.4f %.4f %.4f %.4f" width="%.4f" height="%.4f">\n<g transform="scale(1,-1) translate(0,%.4f)" stroke="#000000" stroke-width="0.1" fill="none">\n', x, y, vw, vh, vw, vh, -(y * 2 + vh))
    return whole.select("drawing_id", F.concat(head, "body", F.lit("\n</g>\n</svg>\n")).alias("content"))


def room_pictures(rooms: DataFrame, crops: bool = False) -> DataFrame:
    """drawing_id, (room_no,) content: rooms (drawing_id, room_no, ring, name) filled with evenly spread pastel colours, on one
    picture per drawing, or each on its own with a margin of a quarter."""
    own = W.partitionBy("drawing_id")
    count, number = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("room_no"))
    rows = rooms.withColumn("_e", drawing.svg_ring(F.col("ring"), drawing.hex_colour(drawing.pastel(number - 1, count)), F.coalesce("name", F.lit(""))))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    rows = rows.select("drawing_id", "room_no", "_e", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    if crops:
        rows = rows.withColumn("_c", drawing.crop(*map(F.col, ("x0", "y0", "x1", "y1")))).select("drawing_id", "room_no", F.col("_e").alias("body"), "_c.*")
        keys = ["drawing_id", "room_no"]
    else:
        rows = rows.groupBy("drawing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("room_no", "_e"))), lambda p: p["_e"]), "\n").alias("body"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
        keys = ["drawing_id"]
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.4f %.4f %.4f %.4f"><g transform="scale(1,-1)">', F.col("x0"), -F.col("y1"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return rows.select(*keys, F.concat(head, "body", F.lit("</g></svg>")).alias("content"))
