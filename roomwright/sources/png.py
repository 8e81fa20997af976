"""Pictures of drawings as PNG files: a floor with its rooms, and single rooms with a margin."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import drawing, shapes
from ..operators import kernel, raster
from ..operators.floors import Part, couples, fold_many

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WALL = (0, 0, 0)
WALL_COLUMNS, BOX = ("sx", "sy", "ex", "ey"), ("x0", "y0", "x1", "y1")


def encode(image: np.ndarray) -> bytes:
    """A [height, width, 3] array of bytes as a PNG file."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, width * 3)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + END


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


END = _chunk(b"IEND", b"")


def encode_indexed(rows: np.ndarray, palette: bytes) -> bytes:
    """A PNG file of numbers of colours. rows: bytes [height, 1 + width], zeros first; palette: three bytes per colour."""
    head = struct.pack(">IIBBBBB", rows.shape[1] - 1, rows.shape[0], 8, 3, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"PLTE", palette) + _chunk(b"IDAT", zlib.compress(rows, 1)) + END


def _lines(data: bytes) -> tuple[np.ndarray, int, np.ndarray | None]:
    """A file's lines of bytes, its width, and its palette, if it has one."""
    at, packed, width, height, palette = len(SIGNATURE), b"", 0, 0, None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, -1)[:, 1:], width, palette


def decode(data: bytes) -> np.ndarray:
    """The image of a file that encode or encode_indexed made."""
    lines, width, palette = _lines(data)
    return lines.reshape(-1, width, 3) if palette is None else palette[lines]


def colours_at(data: bytes, places: list[tuple[float, float]]) -> list[str]:
    """#rrggbb of the pixels at places, as shares of the width and height from the bottom left."""
    lines, width, palette = _lines(data)
    at = [(round((1 - y) * (len(lines) - 1)), round(x * (width - 1))) for x, y in places]
    return ["#" + (lines[j, 3 * i : 3 * i + 3] if palette is None else palette[lines[j, i]]).tobytes().hex() for j, i in at]


def fill(image: np.ndarray, ring: np.ndarray, colour: tuple[int, int, int]) -> None:
    """Paints the pixels whose centres an odd number of the ring's sides lies to the right of."""
    height, width = image.shape[:2]
    low, high = np.clip(np.floor(ring.min(axis=0)), 0, [width - 1, height - 1]).astype(int), np.clip(np.ceil(ring.max(axis=0)), 0, [width - 1, height - 1]).astype(int)
    xs, ys = np.arange(low[0], high[0] + 1), np.arange(low[1], high[1] + 1)
    odd = np.zeros((len(ys), len(xs)), bool)
    for (ax, ay), (bx, by) in zip(ring.tolist(), np.roll(ring, -1, axis=0).tolist()):
        crossed = np.flatnonzero((ay > ys) != (by > ys))
        if len(crossed):
            odd[crossed] ^= xs < ((bx - ax) * (ys[crossed] - ay) / (by - ay) + ax)[:, None]
    image[low[1] : high[1] + 1, low[0] : high[0] + 1][odd] = colour


def paint(box: tuple[float, float, float, float], rings: list[tuple[np.ndarray, str]], walls: np.ndarray, longest: int, stroke: int) -> np.ndarray:
    """The part of a drawing in a box (x0, y0, x1, y1): rooms in their colours (#rrggbb), then walls, on white."""
    x0, y0, x1, y1 = box
    w, h = max(x1 - x0, 1e-9), max(y1 - y0, 1e-9)
    scale = longest / max(w, h)
    width, height = max(int(np.ceil(w * scale)), 4), max(int(np.ceil(h * scale)), 4)

    def pixels(points: np.ndarray) -> np.ndarray:
        return np.stack([(points[:, 0] - x0) / w * (width - 1), height - 1 - (points[:, 1] - y0) / h * (height - 1)], axis=1)

    image = np.full((height, width, 3), 255, np.uint8)
    for ring, colour in rings:
        fill(image, pixels(ring), tuple(bytes.fromhex(colour[1:])))
    inside = (np.maximum(walls[:, 0], walls[:, 2]) >= x0) & (np.minimum(walls[:, 0], walls[:, 2]) <= x1) & (np.maximum(walls[:, 1], walls[:, 3]) >= y0) & (np.minimum(walls[:, 1], walls[:, 3]) <= y1)
    if inside.any():
        ends = np.concatenate([pixels(walls[inside, :2]), pixels(walls[inside, 2:])], axis=1)
        image[raster.draw(np.clip(ends, -4 * longest, 4 * longest), width, height, stroke)] = WALL
    return image


def _pictures(boxes: np.ndarray, rings: kernel.Rings, colours: list[str], room_of: np.ndarray, walls: np.ndarray, wall_of: np.ndarray, longest: int, stroke: int) -> tuple[list[int], list[int], list[bytes]]:
    """Widths, heights and PNG files of the parts of drawings in boxes, as paint() gives them. room_of, wall_of: the box of each
    room and wall, ascending. Rectangles and walls along the axes are spans of pixels, found for all boxes at once; boxes that
    hold anything else are painted by paint()."""
    n = len(boxes)
    low, span = boxes[:, :2], np.maximum(boxes[:, 2:] - boxes[:, :2], 1e-9)
    size = np.maximum(np.ceil(span * (longest / span.max(axis=1))[:, None]), 4).astype(np.int64)

    def pixels(of: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (x0, y0), (w, h), (width, height) = low[of].T, span[of].T, size[of].T
        return (x - x0) / w * (width - 1), height - 1 - (y - y0) / h * (height - 1)

    limit = size[room_of]
    left, bottom = pixels(room_of, rings.low_x, rings.low_y)
    right, top = pixels(room_of, rings.high_x, rings.high_y)
    rooms = np.stack([np.clip(np.ceil(v), 0, limit[:, k]).astype(np.int64) for v, k in ((left, 0), (right, 0), (top, 1), (bottom, 1))], axis=1)
    ax, ay = pixels(wall_of, walls[:, 0], walls[:, 1])
    bx, by = pixels(wall_of, walls[:, 2], walls[:, 3])
    limit = size[wall_of] - 1
    spans = []
    for p, q, k in ((ax, bx, 0), (ay, by, 1)):
        spans += [np.clip(np.rint(np.minimum(p, q)) - (stroke - 1), 0, limit[:, k]), np.clip(np.rint(np.maximum(p, q)), 0, limit[:, k]) + 1]
    lines = np.stack(spans, axis=1).astype(np.int64)
    room_at, wall_at = np.searchsorted(room_of, np.arange(n + 1)), np.searchsorted(wall_of, np.arange(n + 1))
    odd = np.diff(room_at) > 254
    odd[room_of[rings.full & ~(rings.box & (np.diff(rings.ends) == 4))]] = True
    odd[wall_of[(ax != bx) & (ay != by)]] = True
    rooms, lines, room_at, wall_at = rooms.tolist(), lines.tolist(), room_at.tolist(), wall_at.tolist()
    files = []
    for k, (width, height) in enumerate(size.tolist()):
        mine, own = range(room_at[k], room_at[k + 1]), slice(wall_at[k], wall_at[k + 1])
        if odd[k]:
            around = [(np.array(rings.ring(r)), colours[r]) for r in mine if rings.full[r]]
            files.append(encode(paint(tuple(boxes[k].tolist()), around, walls[own], longest, stroke)))
            continue
        rows = np.zeros((height, width + 1), np.uint8)
        image = rows[:, 1:]
        for code, r in enumerate(mine, 2):
            x0, x1, y0, y1 = rooms[r]
            image[y0:y1, x0:x1] = code
        for x0, x1, y0, y1 in lines[own]:
            image[y0:y1, x0:x1] = 1
        files.append(encode_indexed(rows, b"\xff\xff\xff\0\0\0" + bytes.fromhex("".join([colours[r][1:] for r in mine]))))
    return size[:, 0].tolist(), size[:, 1].tolist(), files


def _coloured(rooms: DataFrame) -> DataFrame:
    own = W.partitionBy("drawing_id")
    colour = drawing.hex_colour(drawing.pastel(F.row_number().over(own.orderBy("room_no")) - 1, F.count(F.lit(1)).over(own)))
    return rooms.select("drawing_id", "room_no", "ring", colour.alias("colour"))


def floor_png(rooms: DataFrame, segments: DataFrame, longest: int = 1024, stroke: int = 2) -> DataFrame:
    """drawing_id, width, height, png: each drawing's segments over its rooms (room_no, ring) in evenly spread pastel colours."""

    def draw(lists: dict[str, pa.Array], n: int) -> dict[str, pa.Array]:
        found, lines = Part(lists["rooms"], ("room_no",)), Part(lists["segments"], ())
        walls, rings = np.stack([lines.numbers(v) for v in WALL_COLUMNS], axis=1), kernel.Rings(found.rows.field("ring"))
        boxes = np.concatenate([np.full((n, 2), np.inf), np.full((n, 2), -np.inf)], axis=1)
        full = rings.full
        for of, x, y in ((lines.owner, walls[:, 0], walls[:, 1]), (lines.owner, walls[:, 2], walls[:, 3]), (found.owner[full], rings.low_x[full], rings.low_y[full]), (found.owner[full], rings.high_x[full], rings.high_y[full])):
            for k, v in enumerate((x, y)):
                np.minimum.at(boxes[:, k], of, v)
                np.maximum.at(boxes[:, 2 + k], of, v)
        width, height, files = _pictures(boxes, rings, found.rows.field("colour").to_pylist(), found.owner, walls, lines.owner, longest, stroke)
        return {"width": pa.array(width, pa.int32()), "height": pa.array(height, pa.int32()), "png": pa.array(files, pa.binary())}

    return fold_many({"segments": segments.select("drawing_id", *WALL_COLUMNS), "rooms": _coloured(rooms)}, draw, "width int, height int, png binary")


def room_png(rooms: DataFrame, segments: DataFrame, longest: int = 512, stroke: int = 2) -> DataFrame:
    """drawing_id, room_no, width, height, png: each room in its colour with the walls around it and a margin of a quarter."""
    b = shapes.bounds(F.col("ring"))
    boxed = _coloured(rooms).withColumn("_b", b).withColumn("box", drawing.crop(*(F.col(f"_b.{k}") for k in BOX))).drop("_b").select("*", "box.*").drop("box")

    def draw(lists: dict[str, pa.Array], n: int) -> dict[str, pa.Array]:
        found, lines = Part(lists["rooms"], ("room_no",)), Part(lists["segments"], ())
        walls, rings = np.stack([lines.numbers(v) for v in WALL_COLUMNS], axis=1), kernel.Rings(found.rows.field("ring"))
        boxes = np.stack([found.numbers(k) for k in BOX], axis=1)
        low, high = np.minimum(walls[:, :2], walls[:, 2:]), np.maximum(walls[:, :2], walls[:, 2:])
        of, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, w in couples(found.owner, lines.owner):
            near = (high[w] >= boxes[r, :2]).all(axis=1) & (low[w] <= boxes[r, 2:]).all(axis=1)
            of.append(r[near])
            which.append(w[near])
        width, height, files = _pictures(boxes, rings, found.rows.field("colour").to_pylist(), np.arange(len(boxes)), walls[np.concatenate(which)], np.concatenate(of), longest, stroke)
        columns = [found.rows.field("room_no").cast(pa.int64()), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(files, pa.binary())]
        ends = np.searchsorted(found.owner, np.arange(n + 1)).astype(np.int32)
        return {"pictures": pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["room_no", "width", "height", "png"]))}

    made = fold_many({"rooms": boxed, "segments": segments.select("drawing_id", *WALL_COLUMNS)}, draw, "pictures array<struct<room_no:long,width:int,height:int,png:binary>>")
    return made.select("drawing_id", F.inline("pictures"))
