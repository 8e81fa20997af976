"""Drawing exchange files (text form): group codes to an entity table, and segments, doors, texts and blocks from it.

The entity table has one row per entity: drawing_id, block (null in model space), entity_no (order in the file), etype, layer,
pts, radius, start_deg, end_deg, closed, text, name, rotation, xscale, yscale, attribs, units (of its file), once and each: its
places when insertions are expanded once per block or at every insertion, null in files whose blocks are empty. So a file is
parsed and its insertions are followed in one task, and everything after that is column expressions without a shuffle.

What cannot be read never stops a file: entities without readable coordinates have etype CORRUPT, attributes without are left
out, an unreadable unit counts as none, and a file ends at the first line that should be a group code and is no number.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import constants as K
from ..functions import shapes
from ..functions.text import any_of, block_type, block_type_v1, layer_name
from ..functions.units import metres_per_unit
from ..operators.drawings import ring_array
from ..operators.texts import distinct_texts

ENTITY = (
    f"block string, entity_no long, etype string, layer string, pts {shapes.RING}, radius double, start_deg double, end_deg double, closed boolean, text string, "
    "name string, rotation double, xscale double, yscale double, attribs array<struct<text:string,x:double,y:double,layer:string,tag:string>>, units int, once array<struct<n:long,x:double,y:double>>, each array<struct<n:long,x:double,y:double>>"
)
#: Entities of an output batch, about.
ROWS_AT_ONCE = 20_000
#: The formatting codes of multi-line texts.
_FORMAT = re.compile(r"\\[ACcFfHhQTW][^;]*;|\\[LlOoKk]|[{}]")


def plain_text(raw: str) -> str:
    """A multi-line text without formatting."""
    return _FORMAT.sub("", raw.replace("\\P", "\n").replace("\\~", " ")).replace("\\\\", "\\")


#: Group codes as they are commonly written.
_CODES = {form: k for k in range(1072) for form in (str(k), f"{k:>3}")}


def _groups(content: str) -> tuple[list[int], list[str]]:
    """Group codes and values, up to the first code that is no number."""
    lines = content.split("\n")
    texts, values = lines[::2], lines[1::2]
    if "\r" not in content:
        with contextlib.suppress(KeyError):
            codes = list(map(_CODES.__getitem__, texts[: len(values)]))
            return codes, values
    known: dict[str, int] = {}
    for text in set(texts):
        with contextlib.suppress(ValueError):
            known[text] = int(text)
    if len(known) < len(set(texts)):
        del texts[next(k for k, text in enumerate(texts) if text not in known) :]
    codes = [known[text] for text in texts[: len(values)]]
    if "\r" in content:
        values = [v.strip("\r") for v in values]
    return codes, values[: len(codes)]


class _Entity:
    """One entity's groups; of equal codes the first counts."""

    __slots__ = ("etype", "block", "number", "codes", "values", "first", "points", "attribs")

    def __init__(self, etype: str, block: str | None, number: int, codes: list[int], values: list[str]):
        self.etype, self.block, self.number, self.codes, self.values = etype, block, number, codes, values
        self.first = dict(zip(codes[::-1], values[::-1]))
        self.points: list[_Entity] = []
        self.attribs: list[_Entity] = []

    def number_of(self, code: int, default: float = 0.0) -> float:
        v = self.first.get(code)
        return default if v is None else float(v)

    def at(self, x: int = 10) -> tuple[float, float]:
        return float(self.first[x]), self.number_of(x + 10)

    def attributes(self) -> list[dict]:
        """Of an insertion; those without a place take the insertion's, those with an unreadable one are left out."""
        out, home = [], (self.number_of(10), self.number_of(20))
        for a in self.attribs:
            with contextlib.suppress(ValueError):
                x, y = a.at() if a.first.get(10) else home
                out.append({"text": a.first.get(1) or "", "x": x, "y": y, "layer": a.first.get(8), "tag": a.first.get(2)})
        return out

    def row(self, units: int) -> tuple:
        etype, first, pts, attribs, text = self.etype, self.first, [], [], None
        radius = start = end = rotation = None
        scale, closed = (None, None), False
        try:
            if etype == "LINE":
                pts = [self.at(), self.at(11)]
            elif etype == "LWPOLYLINE":
                x = None
                for code, v in zip(self.codes, self.values):
                    if code == 10:
                        x = float(v)
                    elif code == 20 and x is not None:
                        pts.append((x, float(v)))
                closed = bool(int(self.number_of(70)) & 1)
            elif etype == "POLYLINE":
                pts, closed = [p.at() for p in self.points], bool(int(self.number_of(70)) & 1)
            elif etype in ("ARC", "CIRCLE"):
                pts, radius = [self.at()], float(first[40])
                start, end = self.number_of(50), self.number_of(51, 360.0)
            elif etype in ("TEXT", "ATTRIB", "ATTDEF"):
                pts, text = [self.at()], first.get(1)
            elif etype == "INSERT":
                pts, text, rotation = [self.at()], first.get(1), self.number_of(50)
                scale, attribs = (self.number_of(41, 1.0), self.number_of(42, 1.0)), self.attributes()
            elif etype == "MTEXT":
                pts, text = [self.at()], plain_text("".join(v for c, v in zip(self.codes, self.values) if c in (1, 3)))
        except (KeyError, ValueError, OverflowError):
            etype, pts, attribs, text = "CORRUPT", [], [], None
            radius = start = end = rotation = None
            scale, closed = (None, None), False
        name = first.get(2) if self.etype in ("INSERT", "ATTRIB", "ATTDEF") else None
        return (self.block, self.number, etype, first.get(8), pts, radius, start, end, closed, text, name, rotation, *scale, attribs, units)


class _Skipped:
    """An entity of a type that is not asked for."""

    __slots__ = ("etype", "block", "number")

    def __init__(self, etype: str, block: str | None, number: int):
        self.etype, self.block, self.number = etype, block, number

    def row(self, units: int) -> tuple:
        return (self.block, self.number, None, None, [], None, None, None, False, None, None, None, None, None, [], units)


class _Inserted:
    """An insertion of which only its block and place are asked for."""

    __slots__ = ("block", "number", "first")

    def __init__(self, block: str | None, number: int, codes: list[int], values: list[str]):
        self.block, self.number = block, number
        self.first = dict(zip(codes[::-1], values[::-1]))

    def row(self, units: int) -> tuple:
        etype, first, pts = "INSERT", self.first, []
        try:
            pts = [(float(first[10]), float(first.get(20, 0.0)))]
            for code in (41, 42, 50):
                if code in first:
                    float(first[code])
        except (KeyError, ValueError, OverflowError):
            etype, pts = "CORRUPT", []
        return (self.block, self.number, etype, None, pts, None, None, None, False, None, first.get(2), None, None, None, [], units)


#: What structures a file, and what holds or belongs to other entities.
_READ_ALWAYS = frozenset(("SECTION", "ENDSEC", "BLOCK", "ENDBLK", "SEQEND", "POLYLINE", "VERTEX", "INSERT", "ATTRIB"))


def _units(codes: list[int], values: list[str]) -> int:
    """The code of the drawing unit in the header's groups, 0 if there is none that can be read."""
    variable = None
    for code, value in zip(codes, values):
        if code == 9:
            variable = value
        elif code == 70 and variable == "$INSUNITS":
            with contextlib.suppress(ValueError):
                return int(value)
    return 0


def parse(content: str, kinds: frozenset[str] | None = None) -> list[tuple]:
    """Entity rows of a file's text, without their places. kinds: the types whose groups are read, besides insertions; of others
    only block, number and type are told."""
    codes, values = _groups(content)
    starts = [k for k, code in enumerate(codes) if code == 0]
    out: list[_Entity | _Skipped | _Inserted] = []
    section = block = None
    owner: _Entity | _Skipped | _Inserted | None = None  # of vertices or attributes that follow
    units = number = 0
    # vertices and attributes are read for those that they belong to
    read = _READ_ALWAYS if kinds is None else _READ_ALWAYS - {v for v, of in (("POLYLINE", "POLYLINE"), ("VERTEX", "POLYLINE"), ("ATTRIB", "INSERT")) if of not in kinds}
    for k, stop in zip(starts, [*starts[1:], len(codes)]):
        value = values[k]
        other = kinds is not None and value not in kinds
        if other and value not in read:
            if section == "ENTITIES" or (section == "BLOCKS" and block is not None):
                number += 1
                if owner is None or value not in ("VERTEX", "ATTRIB"):
                    out.append(_Skipped(value, block, number))
                    owner = out[-1] if value == "POLYLINE" else None
            continue
        own, said = codes[k + 1 : stop], values[k + 1 : stop]
        if value == "SECTION":
            section = said[own.index(2)] if 2 in own else ""
            if section == "HEADER":
                units = _units(own, said)
        elif value == "ENDSEC":
            section = block = None
        elif value == "BLOCK":
            block = said[own.index(2)] if 2 in own else None
        elif value == "ENDBLK":
            block = None
        elif value == "SEQEND":
            owner = None
        elif section == "ENTITIES" or (section == "BLOCKS" and block is not None):
            number += 1
            now = _Inserted(block, number, own, said) if other and value == "INSERT" else _Entity(value, block, number, own, said)
            if value == "VERTEX" and owner:
                if isinstance(owner, _Entity):
                    owner.points.append(now)
            elif value == "ATTRIB" and owner:
                if isinstance(owner, _Entity):
                    owner.attribs.append(now)
            else:
                out.append(now)
                owner = now if value in ("POLYLINE", "INSERT") else None
    return [e.row(units) for e in out]


_BLOCK, _ETYPE, _PTS, _NAME = 0, 2, 4, 10


def places(rows: list[tuple], every_instance: bool, kinds: frozenset[str] | None = None) -> list[list[dict]]:
    """Per entity row where it is drawn: its number in the order of drawing, and how far it is moved.

    A block's contents follow its insertion, once per drawing, or with every_instance at each insertion outside of itself. Rotation
    and scale are left out. Block names compare in upper case. kinds: the types whose places are asked for."""
    out: list[list[dict]] = [[] for _ in rows]
    top, defined = [], {}
    for k, r in enumerate(rows):
        (top if r[_BLOCK] is None else defined.setdefault(r[_BLOCK].upper(), [])).append(k)
    seen: set[str] = set()
    number = 0
    todo = [(iter(top), 0.0, 0.0, None)]
    while todo:
        inside, ox, oy, name = todo[-1]
        k = next(inside, None)
        if k is None:
            todo.pop()
            if every_instance and name is not None:
                seen.discard(name)
            continue
        number += 1
        if kinds is None or rows[k][_ETYPE] in kinds:
            out[k].append({"n": number, "x": ox, "y": oy})
        if rows[k][_ETYPE] == "INSERT" and rows[k][_PTS]:
            inner = (rows[k][_NAME] or "").upper()
            if inner not in seen:
                seen.add(inner)
                x, y = rows[k][_PTS][0]
                todo.append((iter(defined.get(inner, [])), ox + x, oy + y, inner))
    return out


#: Types that texts_v1 and blocks_v1 look at.
TEXTS_V1, BLOCKS_V1 = ("TEXT", "MTEXT", "ATTRIB", "ATTDEF", "INSERT"), ("INSERT",)


def entities(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The entity table of (drawing_id, content). Whole files are parsed, one at a time. kinds: the table holds entities of these
    types only, with the numbers and places that they have among all."""
    kind = files.schema["drawing_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"drawing_id {kind}, {ENTITY}")
    shape = to_arrow_schema(schema)

    wanted = None if kinds is None else frozenset(kinds)

    def batch_of(keys: list, rows: list[tuple]) -> pa.RecordBatch:
        columns = [keys, *map(list, zip(*rows))]
        return pa.RecordBatch.from_arrays([ring_array(c).cast(f.type) if f.name == "pts" else pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[tuple] = []
        for batch in batches:
            for key, content in zip(batch.column("drawing_id").to_pylist(), batch.column("content").to_pylist()):
                rows = parse(content or "", wanted)
                if any(r[_BLOCK] is not None for r in rows):
                    rows = [(*r, once, each) for r, once, each in zip(rows, places(rows, False, wanted), places(rows, True, wanted))]
                else:
                    rows = [(*r, None, None) for r in rows]
                if wanted is not None:
                    rows = [r for r in rows if r[_ETYPE] in wanted]
                held += rows
                keys += [key] * len(rows)
                if len(held) > ROWS_AT_ONCE:
                    yield batch_of(keys, held)
                    keys, held = [], []
        if held:
            yield batch_of(keys, held)

    return files.select("drawing_id", "content").mapInArrow(run, schema)


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """The entity table of the .dxf files under a path; drawing_id is the file's path."""
    files = spark.read.option("pathGlobFilter", "*.[dD][xX][fF]").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return entities(files.select(F.input_file_name().alias("drawing_id"), F.col("value").alias("content")))


def converted(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """drawing_id, content, error of drawings in another form (drawing_id, raw): convert makes the exchange form of a file's bytes
    with whatever converter the workers have, or raises; then content is null and error tells why."""
    kind = files.schema["drawing_id"].dataType.simpleString()

    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        try:
            return convert(raw or b""), None
        except Exception as problem:  # noqa: BLE001  whatever a caller's converter raises
            return None, str(problem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                part = batch.slice(k, 1)
                made = one(part.column("raw")[0].as_py())
                yield pa.RecordBatch.from_arrays([part.column("drawing_id"), *(pa.array([v], pa.string()) for v in made)], ["drawing_id", "content", "error"])

    return files.select("drawing_id", "raw").mapInArrow(run, f"drawing_id {kind}, content string, error string")


def read_dwg(spark: SparkSession, path: str, convert: Callable[[bytes], str]) -> DataFrame:
    """drawing_id, content, error of the .dwg files under a path, made by the caller's converter. The reader leaves out files of no
    bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][wW][gG]").option("recursiveFileLookup", "true").load(path)
    return converted(files.select(F.col("path").alias("drawing_id"), F.col("content").alias("raw")), convert)


def uploads(rows: DataFrame) -> DataFrame:
    """drawing_id, status, content of uploaded files (drawing_id, name, raw): .dxf files as texts, others with their status only."""
    known = file_status(rows.withColumn("path", F.col("name"))).drop("path")
    return known.select("drawing_id", "status", F.when(F.col("status") == "uploaded", F.decode("raw", "UTF-8")).alias("content"))


def file_status(paths: DataFrame) -> DataFrame:
    """path, status of files by their extension: drawings in a proprietary form need a converter and are unsupported here."""
    lower = F.lower("path")
    return paths.withColumn("status", F.when(lower.endswith(".dxf"), "uploaded").when(lower.endswith(".dwg"), "unsupported").otherwise("rejected"))


# ---- expansion ----------------------------------------------------------------------------------------------------------

def expand(table: DataFrame, every_instance: bool = False) -> DataFrame:
    """Entities in the order of drawing, those of inserted blocks after their insertion, moved by (ox, oy); visit_no is the order.
    A block's contents appear once per drawing, or with every_instance at each insertion outside of itself."""
    own = F.array(F.struct(F.col("entity_no").alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    placed = table.withColumn("_at", F.explode(F.coalesce("each" if every_instance else "once", own)))
    kept = [c for c in table.columns if c not in ("block", "entity_no", "once", "each")]
    return placed.select(*kept, F.col("block").isNotNull().alias("in_block"), F.col("_at.n").alias("visit_no"), F.col("_at.x").alias("ox"), F.col("_at.y").alias("oy"))


def _moved() -> Column:
    return F.transform("pts", lambda p: shapes.point(p["x"] + F.col("ox"), p["y"] + F.col("oy")))


def _as_segments(rows: DataFrame, *more: str) -> DataFrame:
    """rows: drawing_id, visit_no, layer, line (points) -> segments; their numbers tell the order and have gaps."""
    steps = F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda k: F.struct(k.alias("k"), F.get("line", k).alias("a"), F.get("line", k + 1).alias("b")))
    cut = rows.where(F.size("line") > 1).select("drawing_id", "visit_no", "layer", *more, F.explode(steps).alias("s"))
    return cut.select("drawing_id", (F.shiftleft("visit_no", 32) + F.col("s.k")).alias("seg_no"), F.col("s.a.x").alias("sx"), F.col("s.a.y").alias("sy"), F.col("s.b.x").alias("ex"), F.col("s.b.y").alias("ey"), "layer", *more)


def _closing(points: Column) -> Column:
    return F.concat(points, F.slice(points, 1, 1))


def segments(flat: DataFrame, *more: str) -> DataFrame:
    """Wall candidates of the current engine: lines, polylines (small closed ones are hatching), arcs that are no door swings,
    circles of 0.05 m and more; without dust. more: columns to keep."""
    rows = flat.withColumns({"p": _moved(), "layer": layer_name(F.col("layer")), "_m": metres_per_unit(F.col("units")), "sweep": shapes.sweep(F.col("start_deg"), F.col("end_deg"))})
    x, y, r = F.get("p", F.lit(0))["x"], F.get("p", F.lit(0))["y"], F.col("radius")
    poly = F.col("etype").isin("LWPOLYLINE", "POLYLINE") & ~(F.col("closed") & (F.size("p") >= 3) & (shapes.area(F.col("p")) < 0.04))
    arc = (F.col("etype") == "ARC") & ~shapes.is_door_arc(r * F.col("_m"), F.col("sweep"))
    circle = (F.col("etype") == "CIRCLE") & (r * F.col("_m") >= 0.05)
    line = (
        F.when(F.col("etype") == "LINE", F.col("p"))
        .when(poly, F.when(F.col("closed"), _closing(F.col("p"))).otherwise(F.col("p")))
        .when(arc, shapes.arc_points(x, y, r, F.col("start_deg"), F.col("sweep"), shapes.chords(F.col("sweep"))))
        .when(circle, shapes.arc_points(x, y, r, F.lit(0.0), F.lit(360.0), F.lit(16)))
    )
    cut = _as_segments(rows.withColumn("line", line).where("line is not null"), *more)
    return cut.where(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")) >= 1e-6)


def doors(flat: DataFrame) -> DataFrame:
    """Door swings (arcs of door size) and door blocks of the current engine."""
    rows = flat.withColumns({"p": _moved(), "layer": layer_name(F.col("layer")), "sweep": shapes.sweep(F.col("start_deg"), F.col("end_deg")), "_rm": F.col("radius") * metres_per_unit(F.col("units"))})
    arc = (F.col("etype") == "ARC") & shapes.is_door_arc(F.col("_rm"), F.col("sweep"))
    block = (F.col("etype") == "INSERT") & (block_type(F.col("name")) == "DOOR")
    number = F.row_number().over(W.partitionBy("drawing_id").orderBy("visit_no")).cast("long")
    return rows.where(arc | block).select(
        "drawing_id", number.alias("door_no"), F.get("p", F.lit(0))["x"].alias("cx"), F.get("p", F.lit(0))["y"].alias("cy"), F.when(arc, F.col("radius")).otherwise(0.0).alias("radius"),
        F.when(arc, F.col("_rm")).otherwise(0.0).alias("radius_m"), F.when(arc, F.col("sweep")).otherwise(90.0).alias("sweep_deg"), F.when(arc, F.col("_rm")).otherwise(0.9).alias("width_m"),
        F.when(arc, "arc").otherwise("block").alias("source"), F.when(block, F.upper("name")).alias("block_name"), "layer",
    )


def texts(flat: DataFrame) -> DataFrame:
    """Texts of the current engine: trimmed, non-empty, the first of equal ones at a place."""
    rows = flat.where(F.col("etype").isin("TEXT", "MTEXT")).withColumn("p", F.get(_moved(), F.lit(0)))
    return distinct_texts(rows.select("drawing_id", F.col("visit_no").alias("text_no"), F.coalesce("text", F.lit("")).alias("text"), "p.x", "p.y", layer_name(F.col("layer")).alias("layer")))


def blocks(flat: DataFrame) -> DataFrame:
    rows = flat.where(F.col("etype") == "INSERT").withColumn("p", F.get(_moved(), F.lit(0)))
    return rows.select("drawing_id", F.col("visit_no").alias("block_no"), F.upper(F.coalesce("name", F.lit(""))).alias("name"), block_type(F.coalesce("name", F.lit(""))).alias("type"), "p.x", "p.y", layer_name(F.col("layer")).alias("layer"))


# ---- the older engine ---------------------------------------------------------------------------------------------------

#: Its queries go type by type, so its order is that of the types, then of the file.
_ORDER_V1 = ("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "TEXT", "MTEXT", "ATTRIB", "ATTDEF", "INSERT")

#: Chords of its circles.
CHORDS_V1 = 96


def segments_v1(flat: DataFrame) -> DataFrame:
    """Every arc and circle (96 chords) becomes chords; short open two-point polylines and small closed ones are dropped."""
    circle = F.col("etype") == "CIRCLE"
    rows = flat.withColumns({"p": F.when(~circle, _moved()), "sweep": shapes.sweep(F.col("start_deg"), F.col("end_deg"))})
    x, y, r = F.get("p", F.lit(0))["x"], F.get("p", F.lit(0))["y"], F.col("radius")
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    short = ~F.col("closed") & (F.size("p") == 2) & (F.hypot(b["x"] - a["x"], b["y"] - a["y"]) < 0.05)
    poly = F.col("etype").isin("LWPOLYLINE", "POLYLINE") & ~short & ~(F.col("closed") & (F.size("p") >= 3) & (shapes.area(F.col("p")) < 0.04))
    closes = F.col("closed") & (F.size("p") >= 3) & (F.element_at("p", 1) != F.element_at("p", -1))
    line = (
        F.when(F.col("etype") == "LINE", F.col("p"))
        .when(poly, F.when(closes, _closing(F.col("p"))).otherwise(F.col("p")))
        .when(F.col("etype") == "ARC", shapes.arc_points(x, y, r, F.col("start_deg"), F.col("sweep"), shapes.chords(F.col("sweep"))))
    )
    # circles all turn alike: their chords are places in one table of directions, and no points are listed for each
    first = F.get("pts", F.lit(0))
    made = rows.select("drawing_id", "visit_no", "layer", circle.alias("_round"), line.alias("line"), (first["x"] + F.col("ox")).alias("_x"), (first["y"] + F.col("oy")).alias("_y"), r.alias("_r"))
    n = F.when(F.col("_round"), CHORDS_V1).otherwise(F.size("line") - 1)
    cut = made.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    turns = [F.radians(F.lit(0.0) + F.lit(360.0) * F.lit(k) / F.lit(CHORDS_V1)) for k in range(CHORDS_V1 + 1)]
    ways = {"x": F.array(*map(F.cos, turns)), "y": F.array(*map(F.sin, turns))}

    def at(k: Column, axis: str) -> Column:
        return F.when(F.col("_round"), F.col(f"_{axis}") + F.col("_r") * F.get(ways[axis], k)).otherwise(F.get("line", k)[axis])

    ends = [at(F.col("_k") + more, axis).alias(name) for more, axis, name in ((0, "x", "sx"), (0, "y", "sy"), (1, "x", "ex"), (1, "y", "ey"))]
    return cut.select("drawing_id", (F.shiftleft("visit_no", 32) + F.col("_k")).alias("seg_no"), *ends, "layer")


def doors_v1(flat: DataFrame) -> DataFrame:
    """Arcs of 70 to 100 degrees whatever their size, circles on door layers, door blocks."""
    rows = flat.withColumns({"p": _moved(), "turn": F.pmod(F.col("end_deg") - F.col("start_deg"), F.lit(360.0))})
    arc = (F.col("etype") == "ARC") & F.col("turn").between(70.0, 100.0)
    circle = (F.col("etype") == "CIRCLE") & any_of(F.upper("layer"), K.DOOR_BLOCKS_V1)
    block = (F.col("etype") == "INSERT") & any_of(F.upper("name"), K.DOOR_BLOCKS_V1)
    rank = F.array_position(F.array(*map(F.lit, _ORDER_V1)), F.col("etype"))
    number = F.row_number().over(W.partitionBy("drawing_id").orderBy(rank, "visit_no")).cast("long")
    return rows.where(arc | circle | block).select(
        "drawing_id", number.alias("door_no"), F.get("p", F.lit(0))["x"].alias("cx"), F.get("p", F.lit(0))["y"].alias("cy"), F.when(block, 0.0).otherwise(F.col("radius")).alias("radius"),
        F.when(arc, F.col("turn")).when(circle, 360.0).otherwise(90.0).alias("sweep_deg"), F.when(block, F.abs("xscale")).otherwise(F.col("radius") * 2).alias("width_m"),
        F.when(arc, "arc").when(circle, "circle").otherwise("insert").alias("source"), F.when(block, F.col("name")).alias("block_name"), "layer",
    )


def texts_v1(flat: DataFrame) -> DataFrame:
    """Texts, attributes (templates only outside of blocks), and the attributes that insertions carry."""
    own = F.col("etype").isin("TEXT", "MTEXT", "ATTRIB") | ((F.col("etype") == "ATTDEF") & ~F.col("in_block"))
    p = F.get("pts", F.lit(0))

    def said(k, text, x, y, layer):
        return F.struct((F.col("visit_no") * 1000 + k).cast("long").alias("text_no"), F.coalesce(text, F.lit("")).alias("text"), (x + F.col("ox")).alias("x"), (y + F.col("oy")).alias("y"), layer.alias("layer"))

    carried = F.transform("attribs", lambda a, k: said(k + 1, a["text"], a["x"], a["y"], a["layer"]))
    rows = flat.where(own | (F.col("etype") == "INSERT"))
    rows = rows.select("drawing_id", F.explode(F.when(own, F.array(said(F.lit(0), F.col("text"), p["x"], p["y"], F.col("layer")))).otherwise(carried)).alias("t"))
    return distinct_texts(rows.select("drawing_id", "t.*"))


def blocks_v1(flat: DataFrame) -> DataFrame:
    rows = flat.where(F.col("etype") == "INSERT").withColumn("p", F.get(_moved(), F.lit(0)))
    return rows.select("drawing_id", F.col("visit_no").alias("block_no"), "name", block_type_v1(F.coalesce("name", F.lit(""))).alias("type"), "p.x", "p.y", "layer", "rotation", "xscale", "yscale")


def inspection(table: DataFrame) -> DataFrame:
    """drawing_id, in_block, etype, n: how many entities of each type the model space and the blocks hold."""
    return table.groupBy("drawing_id", F.col("block").isNotNull().alias("in_block"), "etype").agg(F.count(F.lit(1)).alias("n"))


# ---- writing ------------------------------------------------------------------------------------------------------------

def groups(*pairs) -> Column:
    """The text of group codes with values (columns or constants)."""
    parts = [F.concat(F.lit(f"{code}\n"), (v if isinstance(v, Column) else F.lit(str(v))).cast("string"), F.lit("\n")) for code, v in pairs]
    return F.concat(*parts)


def dxf_text(lines: DataFrame, labels: DataFrame | None = None, inserts: DataFrame | None = None, units: Column | int = 6) -> DataFrame:
    """drawing_id, content: one file per drawing with its segments, texts and block insertions. units: a number, or a column of
    the drawing_id."""

    rows = lines.select("drawing_id", groups((0, "LINE"), (8, F.col("layer")), (10, F.col("sx")), (20, F.col("sy")), (11, F.col("ex")), (21, F.col("ey"))).alias("e"))
    if labels is not None:
        rows = rows.unionByName(labels.select("drawing_id", groups((0, "TEXT"), (8, "A-TEXT"), (10, F.col("x")), (20, F.col("y")), (1, F.col("text"))).alias("e")))
    if inserts is not None:
        rows = rows.unionByName(inserts.select("drawing_id", groups((0, "INSERT"), (8, "A-FURN"), (2, F.col("name")), (10, F.col("x")), (20, F.col("y"))).alias("e")))
    return file_of(rows, units)


def file_of(entities: DataFrame, units: Column | int = 6, blocks: Column | None = None) -> DataFrame:
    """drawing_id, content: files of entities (drawing_id, e: their groups), in the order of the texts. blocks: the groups of the
    block section, a column of the drawing_id."""
    head = F.concat(groups((0, "SECTION"), (2, "HEADER"), (9, "$INSUNITS"), (70, units), (0, "ENDSEC")), F.lit("") if blocks is None else F.concat(groups((0, "SECTION"), (2, "BLOCKS")), blocks, groups((0, "ENDSEC"))), groups((0, "SECTION"), (2, "ENTITIES")))
    body = entities.groupBy("drawing_id").agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("body"))
    return body.select("drawing_id", F.concat(head, "body", F.lit("0\nENDSEC\n0\nEOF\n")).alias("content"))
