"""Registered queries of single rules: entity kinds of drawing files, fallbacks, merging, labels, reports, pictures, model calls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import answers, drawing, shapes, text
from ..operators import adjacency, ask, blocks, classify, enrich, layers, merge, noding, oldest, reports, rooms
from ..operators.drawings import plain
from ..operators.tables import written
from ..sources import dxf, png, store, svg
from . import catalog as C
from . import sqltext as S
from .engine import Drawing, file_rooms, payload, run_pipeline
from .fixtures import Drawings

query = C.query
c = C.c


def _to_5(rows: DataFrame, *names: str) -> list[Column]:
    return [F.floor(F.col(n) * 1e5 + 0.5).alias(f"{n}5") for n in names]


# ---- entity kinds of drawing files --------------------------------------------------------------------------------------

def _entities(d: Drawings, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Per room a closed outline and an open line through a polyline's vertices; per door an arc of 90 degrees and a circle; two
    insertions of one block that holds a line, and an attribute at the second."""
    g = dxf.groups
    x0, x1, y1 = c("x0", "x1", "y1")
    outline = g((0, "LWPOLYLINE"), (8, "P1"), (70, 1), (10, x0), (20, 0.0), (10, x1), (20, 0.0), (10, x1), (20, y1), (10, x0), (20, y1))
    vertices = [g((0, "VERTEX"), (10, x), (20, y)) for x, y in ((x0, F.lit(0.0)), (x1, y1), (x1, F.lit(0.0)))]
    open_line = F.concat(g((0, "POLYLINE"), (8, "P2"), (70, 0)), *vertices, g((0, "SEQEND")))
    insert = g((0, "INSERT"), (8, "I"), (2, "Unit 1"), (10, x0), (20, 10.0))
    tagged = F.concat(g((0, "INSERT"), (8, "I"), (2, "UNIT 1"), (10, x1), (20, 20.0)), g((0, "ATTRIB"), (8, "T"), (2, "TAG"), (1, F.concat(F.lit("room "), F.col("room_no"))), (10, x1), (20, 21.0)), g((0, "SEQEND")))
    arc = g((0, "ARC"), (8, "A"), (10, F.col("cx")), (20, F.col("cy")), (40, F.col("radius") + 0.5), (50, 0), (51, 90))
    circle = g((0, "CIRCLE"), (8, "A-DOOR"), (10, F.col("cx")), (20, F.col("cy")), (40, F.col("radius") + 0.25))
    has_door = F.col("room_no") > 1
    every = F.concat(F.array(outline, open_line, insert, tagged), F.when(has_door, F.array(arc, circle)).otherwise(F.array().cast("array<string>")))
    rows = d.room_and_door.select("drawing_id", F.explode(every).alias("e"))
    block = g((0, "BLOCK"), (2, "UNIT 1"), (0, "LINE"), (8, "B"), (10, 0), (20, 0), (11, 1), (21, 2), (0, "ENDBLK"))
    return dxf.entities(dxf.file_of(rows, blocks=block), kinds)


_sides = ",\nside AS (SELECT *,unnest([1,2,3,4]) AS k FROM fp_cell)"


@query("dxf_outlines", "SELECT drawing_id,CASE k WHEN 1 THEN x0 WHEN 2 THEN x1 WHEN 3 THEN x1 ELSE x0 END AS sx,CASE k WHEN 1 THEN y0 WHEN 2 THEN y0 WHEN 3 THEN y1 ELSE y1 END AS sy,CASE k WHEN 1 THEN x1 WHEN 2 THEN x1 WHEN 3 THEN x0 ELSE x0 END AS ex,CASE k WHEN 1 THEN y0 WHEN 2 THEN y1 WHEN 3 THEN y1 ELSE y0 END AS ey FROM side", _sides)
def dxf_outlines(d: Drawings) -> DataFrame:
    """Closed light polylines become their sides."""
    return dxf.segments(dxf.expand(_entities(d))).where("layer = 'P1'").select("drawing_id", "sx", "sy", "ex", "ey")


@query("dxf_vertices", "SELECT drawing_id,x0 AS sx,y0 AS sy,x1 AS ex,y1 AS ey FROM fp_cell UNION ALL SELECT drawing_id,x1,y1,x1,y0 FROM fp_cell")
def dxf_vertices(d: Drawings) -> DataFrame:
    """Old polylines with vertices of their own."""
    return dxf.segments(dxf.expand(_entities(d))).where("layer = 'P2'").select("drawing_id", "sx", "sy", "ex", "ey")


def _chords_sql(radius: str, turn: int, n: int) -> str:
    def at(axis: str, centre: str, k: str) -> str:
        return f"CAST(floor(({centre}+{radius}*{axis}(radians(0.0::DOUBLE+{turn}.0::DOUBLE*{k}/{n})))*1e5+0.5) AS BIGINT)"

    return f"SELECT drawing_id,{at('cos', 'cx', 'k')} AS sx5,{at('sin', 'cy', 'k')} AS sy5,{at('cos', 'cx', '(k+1)')} AS ex5,{at('sin', 'cy', '(k+1)')} AS ey5 FROM (SELECT *,unnest(range(0,{n})) AS k FROM fp_door)"


@query("dxf_circles", _chords_sql("(radius+0.25)", 360, 16))
def dxf_circles(d: Drawings) -> DataFrame:
    rows = dxf.segments(dxf.expand(_entities(d))).where("layer = 'A-DOOR'")
    return rows.select("drawing_id", *_to_5(rows, "sx", "sy", "ex", "ey"))


@query("dxf_circles_v1", _chords_sql("(radius+0.25)", 360, 96))
def dxf_circles_v1(d: Drawings) -> DataFrame:
    rows = dxf.segments_v1(dxf.expand(_entities(d, ("CIRCLE",)), every_instance=True)).where("layer = 'A-DOOR'")
    return rows.select("drawing_id", *_to_5(rows, "sx", "sy", "ex", "ey"))


@query("dxf_arcs", _chords_sql("(radius+0.5)", 90, 12))
def dxf_arcs(d: Drawings) -> DataFrame:
    """Arcs of 0.5 and 1.5 m are no door swings."""
    rows = dxf.segments(dxf.expand(_entities(d))).where("layer = 'A'")
    return rows.select("drawing_id", *_to_5(rows, "sx", "sy", "ex", "ey"))


@query("dxf_arcs_v1", _chords_sql("(radius+0.5)", 90, 12))
def dxf_arcs_v1(d: Drawings) -> DataFrame:
    rows = dxf.segments_v1(dxf.expand(_entities(d), every_instance=True)).where("layer = 'A'")
    return rows.select("drawing_id", *_to_5(rows, "sx", "sy", "ex", "ey"))


@query("dxf_block_once", "SELECT drawing_id,count(*) AS lines,CAST(min(w) AS DOUBLE) AS width,CAST(min(h) AS DOUBLE) AS height FROM (SELECT drawing_id,1.0 AS w,2.0 AS h FROM ext) GROUP BY ALL")
def dxf_block_once(d: Drawings) -> DataFrame:
    """The current engine draws a block's contents at one insertion only."""
    rows = dxf.segments(dxf.expand(_entities(d))).where("layer = 'B'")
    return rows.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("lines"), F.min(F.col("ex") - F.col("sx")).alias("width"), F.min(F.col("ey") - F.col("sy")).alias("height"))


@query("dxf_block_each", "SELECT drawing_id,x0 AS sx,10.0::DOUBLE AS sy,x0+1 AS ex,12.0::DOUBLE AS ey FROM fp_cell UNION ALL SELECT drawing_id,x1,20.0,x1+1,22.0 FROM fp_cell")
def dxf_block_each(d: Drawings) -> DataFrame:
    """The older engine draws it at every insertion."""
    return dxf.segments_v1(dxf.expand(_entities(d), every_instance=True)).where("layer = 'B'").select("drawing_id", "sx", "sy", "ex", "ey")


@query("dxf_doors_v1", "SELECT drawing_id,cx,cy,'arc' AS source,90.0::DOUBLE AS sweep_deg,(radius+0.5)*2 AS width_m FROM fp_door UNION ALL SELECT drawing_id,cx,cy,'circle',360.0,(radius+0.25)*2 FROM fp_door")
def dxf_doors_v1(d: Drawings) -> DataFrame:
    return dxf.doors_v1(dxf.expand(_entities(d), every_instance=True)).select("drawing_id", "cx", "cy", "source", "sweep_deg", "width_m")


@query("dxf_texts_v1", "SELECT drawing_id,concat('room ',room_no) AS text,x1 AS x,21.0::DOUBLE AS y,'T' AS layer FROM fp_cell")
def dxf_texts_v1(d: Drawings) -> DataFrame:
    """Attributes that insertions carry are texts of the older engine."""
    return dxf.texts_v1(dxf.expand(_entities(d, dxf.TEXTS_V1), every_instance=True)).select("drawing_id", "text", "x", "y", "layer")


@query("entities_v0", "SELECT drawing_id,'LWPOLYLINE' AS etype,4 AS points,NULL AS tag FROM fp_cell UNION ALL SELECT drawing_id,'POLYLINE',3,NULL FROM fp_cell UNION ALL SELECT drawing_id,'INSERT',1,NULL FROM fp_cell UNION ALL SELECT drawing_id,'INSERT',1,concat('TAG=room ',room_no) FROM fp_cell")
def entities_v0(d: Drawings) -> DataFrame:
    """The oldest engine's entities, with the tags that insertions carry."""
    tag = F.get("attributes", F.lit(0))
    return oldest.entities_v0(_entities(d)).select("drawing_id", "etype", F.size("pts").alias("points"), F.when(F.size("attributes") > 0, F.concat(tag["tag"], F.lit("="), tag["text"])).alias("tag"))


@query("clean_v0", "SELECT drawing_id,CAST(1 AS BIGINT) AS part,CAST(count(*)+1 AS INTEGER) AS points,sum(x1-x0) AS length FROM fp_cell GROUP BY ALL")
def clean_v0(d: Drawings) -> DataFrame:
    """The upper walls of a strip, room by room, hang together; ends 0.004 apart fall together, and short pieces go."""
    lines = d.cell.select("drawing_id", F.col("x0").alias("sx"), F.col("y1").alias("sy"), F.col("x1").alias("ex"), (F.col("y1") + 0.004).alias("ey"))
    short = d.cell.select("drawing_id", F.col("x0").alias("sx"), F.lit(-9.0).alias("sy"), (F.col("x0") + 0.05).alias("ex"), F.lit(-9.0).alias("ey"))
    found = oldest.clean_segments_v0(lines.unionByName(short))
    ends = F.get("line", F.size("line") - 1)["x"] - F.get("line", F.lit(0))["x"]
    return found.select("drawing_id", "part", F.size("line").alias("points"), F.round(F.abs(ends), 6).alias("length"))


@query("converted_drawings", "SELECT drawing_id,CASE WHEN drawing_id%4=0 THEN 'no drawing' END AS error,CASE WHEN drawing_id%4<>0 THEN n END AS segments FROM (SELECT drawing_id,count(*) AS n FROM fp_segment GROUP BY ALL)")
def converted_drawings(d: Drawings) -> DataFrame:
    """Files in another form go through a converter; here a reversed text, and every fourth file is broken."""
    files = dxf.dxf_text(d.segment).withColumn("raw", F.when(F.col("drawing_id") % 4 == 0, F.lit("?")).otherwise(F.reverse("content")).cast("binary"))

    def convert(raw: bytes) -> str:
        if raw == b"?":
            raise ValueError("no drawing")
        return raw.decode()[::-1]

    made = written(dxf.converted(files, convert), "converted")
    counts = dxf.entities(made.where("content is not null")).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("segments"))
    return made.join(counts, "drawing_id", "left").select("drawing_id", "error", "segments")


@query("uploaded_files", "SELECT drawing_id,CASE drawing_id%3 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'unsupported' ELSE 'rejected' END AS status,CASE WHEN drawing_id%3=0 THEN concat('0\\nEOF ',drawing_id) END AS content FROM ext".replace("\\n", "'||chr(10)||'"))
def uploaded_files(d: Drawings) -> DataFrame:
    name = F.concat(F.lit("a/plan."), F.get(F.array(*map(F.lit, ("DXF", "dwg", "pdf"))), (F.col("drawing_id") % 3).cast("int")))
    raw = F.concat(F.lit("0\nEOF "), F.col("drawing_id")).cast("binary")
    return dxf.uploads(d.cell.select("drawing_id").distinct().select("drawing_id", name.alias("name"), raw.alias("raw")))


@query("unreadable_entities", "SELECT drawing_id,'LINE' AS etype,count(*) AS n FROM fp_cell GROUP BY ALL UNION ALL SELECT drawing_id,'CORRUPT',3*count(*) FROM fp_cell GROUP BY ALL UNION ALL SELECT drawing_id,'INSERT',count(*) FROM fp_cell GROUP BY ALL")
def unreadable_entities(d: Drawings) -> DataFrame:
    """Bad numbers in lines, insertions, scales and units mark the entity or count as missing; nothing else is lost."""
    g = dxf.groups
    x0, x1 = c("x0", "x1")
    kinds = [
        g((0, "LINE"), (8, "W"), (10, x0), (20, 0), (11, x1), (21, 0)), g((0, "LINE"), (10, "oops"), (20, 0), (11, x1), (21, 0)), g((0, "INSERT"), (2, "A"), (10, "?"), (20, 1)), g((0, "INSERT"), (2, "A"), (10, x0), (20, 1), (41, "wide")),
        F.concat(g((0, "INSERT"), (2, "A"), (10, x0), (20, 1)), g((0, "ATTRIB"), (1, "T"), (10, "bad"), (20, 1)), g((0, "SEQEND"))),
    ]
    rows = d.cell.select("drawing_id", F.explode(F.array(*kinds)).alias("e"))
    table = dxf.entities(dxf.file_of(rows, units="metres"))
    return table.where("units = 0").groupBy("drawing_id", "etype").agg(F.count(F.lit(1)).alias("n"))


@query("door_layers", f"SELECT drawing_id,seq,layer,{S.contains_any('upper(layer)', K.DOOR_LAYER_HINTS)} AS door FROM (SELECT drawing_id,seq,CASE WHEN seq%3=0 THEN concat('x-dr',seq) ELSE layer END AS layer FROM fp_layer)")
def door_layers(d: Drawings) -> DataFrame:
    rows = d.layer.select("drawing_id", "seq", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("x-dr"), F.col("seq"))).otherwise(F.col("layer")).alias("layer"))
    return rows.withColumn("door", text.is_door_layer(F.col("layer")))


@query("svg_shapes", "SELECT drawing_id,k,CASE k WHEN 1 THEN x0 WHEN 2 THEN x1 WHEN 3 THEN x1 ELSE x0 END AS sx,CASE k WHEN 1 THEN y0 WHEN 2 THEN y0 WHEN 3 THEN y1 ELSE y1 END AS sy,CASE k WHEN 1 THEN x1 WHEN 2 THEN x1 WHEN 3 THEN x0 ELSE x0 END AS ex,CASE k WHEN 1 THEN y0 WHEN 2 THEN y1 WHEN 3 THEN y1 ELSE y0 END AS ey FROM side WHERE room_no<=3", _sides)
def svg_shapes(d: Drawings) -> DataFrame:
    """A rectangle as rect, polygon and path, by room: the first three rooms of each strip."""
    x0, x1, y1 = c("x0", "x1", "y1")
    n = [v.cast("string") for v in (x0, x1, y1, x1 - x0)]
    rect = F.concat(F.lit('<rect x="'), n[0], F.lit('" y="0" width="'), n[3], F.lit('" height="'), n[2], F.lit('"/>'))
    polygon = F.concat(F.lit('<polygon points="'), n[0], F.lit(",0 "), n[1], F.lit(",0 "), n[1], F.lit(","), n[2], F.lit(" "), n[0], F.lit(","), n[2], F.lit('"/>'))
    path = F.concat(F.lit('<path d="M '), n[0], F.lit(" 0 H "), n[1], F.lit(" V "), n[2], F.lit(" H "), n[0], F.lit(' Z"/>'))
    shape = F.when(F.col("room_no") == 1, rect).when(F.col("room_no") == 2, polygon).otherwise(path)
    files = d.cell.where("room_no <= 3").select(F.struct("drawing_id", "room_no").alias("drawing_id"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), shape, F.lit("</svg>")).alias("content"))
    return svg.segments(files).select("drawing_id.drawing_id", F.col("seg_no").cast("int").alias("k"), "sx", "sy", "ex", "ey")


# ---- units, fallbacks, merging ------------------------------------------------------------------------------------------

#: Units whose factors are exact in binary times a strip's coordinates: in feet, a room exactly 1.5 times as large as the next one
#: counts as larger by rounding in some drawings, and as equal in others.
_unit_codes = (4, 5, 6, 0)


@query(
    "mixed_units",
    f"""SELECT drawing_id,room_no,CAST(floor(area_raw*m*m*f*100+0.5) AS BIGINT) AS sqft100 FROM (SELECT *,{S.case([(f'drawing_id%4={k}', S.lit(1 / K.UNIT_METRES[u])) for k, u in enumerate(_unit_codes)], '1.0')} AS m,
{S.case([(f'drawing_id%4={k}', S.lit(K.UNIT_SQFT[u])) for k, u in enumerate(_unit_codes)], '1.0')} AS f FROM kept)""",
    C._by_area + ",\nkept AS (SELECT drawing_id,area_raw,row_number() OVER (PARTITION BY drawing_id ORDER BY area_raw,x0) AS room_no FROM byarea WHERE NOT (k=1 AND coalesce(area_raw>nxt*1.5,FALSE)))",
)
def mixed_units(d: Drawings) -> DataFrame:
    """Drawings in millimetres, centimetres, metres and no unit in one run: sizes by each file's own unit."""
    code = F.element_at(F.array(*map(F.lit, _unit_codes)), (F.col("drawing_id") % 4 + 1).cast("int"))
    times = F.element_at(F.array(*[F.lit(1 / K.UNIT_METRES[u]) for u in _unit_codes]), (F.col("drawing_id") % 4 + 1).cast("int"))
    lines = d.segment.select("drawing_id", "layer", *[(F.col(v) * times).alias(v) for v in ("sx", "sy", "ex", "ey")])
    found = file_rooms(dxf.entities(dxf.dxf_text(lines, units=code)))
    return found.select("drawing_id", "room_no", F.floor(F.col("area_sqft") * 100 + 0.5).alias("sqft100"))


def _outlines(d: Drawings) -> DataFrame:
    """Edges of each strip's outline."""
    whole = d.cell.groupBy("drawing_id").agg(F.max("x1").alias("w"), F.max("y1").alias("h"))
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.lit(0.0)), (F.col("w"), F.lit(0.0)), (F.col("w"), F.col("h")), (F.lit(0.0), F.col("h")))])
    sides = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.get(corners, k).alias("a"), F.get(corners, (k + 1) % 4).alias("b")))
    return whole.select("drawing_id", F.explode(sides).alias("s")).select("drawing_id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _some_faces(d: Drawings) -> DataFrame:
    return C.room_table(d).where("drawing_id % 2 = 0").select("drawing_id", "ring", "area_raw")


@query("cycle_fallback", "SELECT drawing_id,x0,y0,x1,y1,area_raw FROM fp_cell WHERE drawing_id%2=0 UNION ALL SELECT drawing_id,0.0,0.0,xmax,h,xmax*h FROM ext WHERE drawing_id%2=1")
def cycle_fallback(d: Drawings) -> DataFrame:
    """Drawings with fewer than two faces get the cycles of their edges that are no faces yet; the others keep their faces."""
    return C.box(rooms.with_cycle_fallback(_some_faces(d), _outlines(d)))


@query("cycle_fallback_v1", "SELECT drawing_id,x0,y0,x1,y1,area_raw FROM fp_cell WHERE drawing_id%2=0 UNION ALL SELECT drawing_id,0.0,0.0,xmax,h,xmax*h FROM ext WHERE drawing_id%2=1")
def cycle_fallback_v1(d: Drawings) -> DataFrame:
    """The older engine takes cycles for drawings without any face, and drops those that contain others."""
    found = rooms.numbered(rooms.faces_or_cycles(_some_faces(d), _outlines(d)))
    around = found.where("from_cycles").select("drawing_id", (F.col("room_no") + 100).alias("room_no"), F.transform("ring", lambda p: shapes.point(p["x"] * 3 - 1, p["y"] * 3 - 1)).alias("ring"), (F.col("area_raw") * 9).alias("area_raw"), F.lit(True).alias("from_cycles"))
    return C.box(rooms.cycles_without_containers(found.drop("name").unionByName(around)))


@query("edge_directions", "SELECT DISTINCT drawing_id,CASE WHEN sx<ex OR (sx=ex AND sy<=ey) THEN sx ELSE ex END AS ax,CASE WHEN sx<ex OR (sx=ex AND sy<=ey) THEN sy ELSE ey END AS ay,abs(ex-sx)<abs(ey-sy) AS vertical FROM fp_segment WHERE layer='A-WALL'")
def edge_directions(d: Drawings) -> DataFrame:
    """Which walls rise more than they run."""
    return noding.snapped_edges(noding.graph_edges(C.wall_lines(d)), 0.5).select("drawing_id", "ax", "ay", "vertical").distinct()


@query("side_ratios", "SELECT drawing_id,room_no,greatest(x1-x0,y1)/greatest(least(x1-x0,y1),1e-9) AS ratio FROM fp_cell")
def side_ratios(d: Drawings) -> DataFrame:
    return d.cell.select("drawing_id", "room_no", shapes.side_ratio(F.col("x1") - F.col("x0"), F.col("y1")).alias("ratio"))


def _merge_pass(name: str, source: str) -> str:
    """Rooms in order take up the next one if it belongs to them and is not taken up itself."""
    fits = "(p.h/least(2*(p.x1-p.x0)+2*p.h,2*(s.x1-s.x0)+2*s.h)>=0.3 OR ((s.x1+s.x0)-(p.x1+p.x0))/2<=2.0)"
    return f""",
{name}w AS (SELECT drawing_id,n,FALSE AS taken FROM {source} WHERE n=1 UNION ALL SELECT s.drawing_id,s.n,NOT w.taken AND {fits} FROM {name}w w JOIN {source} p ON p.drawing_id=w.drawing_id AND p.n=w.n JOIN {source} s ON s.drawing_id=w.drawing_id AND s.n=w.n+1),
{name} AS (SELECT p.drawing_id,row_number() OVER (PARTITION BY p.drawing_id ORDER BY p.n) AS n,p.x0,CASE WHEN t.taken THEN q.x1 ELSE p.x1 END AS x1,p.h FROM {source} p JOIN {name}w w ON w.drawing_id=p.drawing_id AND w.n=p.n
LEFT JOIN {source} q ON q.drawing_id=p.drawing_id AND q.n=p.n+1 LEFT JOIN {name}w t ON t.drawing_id=p.drawing_id AND t.n=p.n+1 WHERE NOT w.taken)"""


C.ORACLE_SQL["merge_rooms_v1"] = (
    C.CTES + ",\nm0 AS (SELECT drawing_id,room_no AS n,x0,x1,y1 AS h FROM fp_cell)" + _merge_pass("m1", "m0") + _merge_pass("m2", "m1") + _merge_pass("m3", "m2")
    + "\nSELECT drawing_id,x0,0.0::DOUBLE AS y0,x1,h AS y1,(x1-x0)*h AS area_raw FROM m3"
)
C.ORACLE_SQL["merge_groups_v0"] = C.CTES + "\nSELECT drawing_id,room_no,room_no AS part FROM fp_cell"


def _groups_sql(ratio: float, reach: float) -> str:
    return f""",
gw AS (SELECT drawing_id,room_no,FALSE AS taken FROM fp_cell WHERE room_no=1 UNION ALL SELECT s.drawing_id,s.room_no,NOT w.taken AND p.y1/least(2*(p.x1-p.x0)+2*p.y1,2*(s.x1-s.x0)+2*s.y1)>={ratio} AND ((s.x1+s.x0)-(p.x1+p.x0))/2<={reach}
FROM gw w JOIN fp_cell p ON p.drawing_id=w.drawing_id AND p.room_no=w.room_no JOIN fp_cell s ON s.drawing_id=w.drawing_id AND s.room_no=w.room_no+1)"""


@query("merge_groups_v0_loose", "SELECT drawing_id,room_no,CAST(sum(CASE WHEN taken THEN 0 ELSE 1 END) OVER (PARTITION BY drawing_id ORDER BY room_no) AS BIGINT) AS part FROM gw", _groups_sql(0.2, 6.0))
def merge_groups_v0_loose(d: Drawings) -> DataFrame:
    """With bars so low that neighbours do merge."""
    return merge.merge_groups_v0(C.room_table(d), 0.2, 6.0)


# ---- labels -------------------------------------------------------------------------------------------------------------

_near_of = S.near_confidence("cd", ["before", "after"])
_told_votes = [("gl", "gc"), ("bl", "bc"), ("nl", "nc"), ("vl", "vc")]
C.ORACLE_SQL["apply_vision"] = f"""{C.CTES}{C._classified},
again AS (SELECT t.drawing_id,t.room_no,t.named,t.gl,t.gc,t.bl,t.bc,t.cd,'Hall' AS vl,0.9::DOUBLE AS vc,coalesce(p.label,'') AS before,coalesce(q.label,'') AS after FROM told t
LEFT JOIN steps p ON p.drawing_id=t.drawing_id AND p.room_no=t.room_no-1 LEFT JOIN steps q ON q.drawing_id=t.drawing_id AND q.room_no=t.room_no+1 WHERE t.room_no%3=0),
seen AS (SELECT *,CASE WHEN nc>0 THEN cd ELSE '' END AS nl FROM (SELECT *,{_near_of} AS nc FROM again))
SELECT drawing_id,room_no,CASE WHEN named IS NOT NULL THEN named ELSE {S.vote(_told_votes)[0]} END AS label,CASE WHEN named IS NOT NULL THEN 0.9::DOUBLE ELSE {S.vote(_told_votes)[1]} END AS confidence,
CASE WHEN named IS NOT NULL THEN 'cad_label' ELSE 'vision+rules' END AS method FROM seen"""

C.ORACLE_SQL["label_map_grid"] = f"""{C.CTES}{C._grid},
queue AS (SELECT s.drawing_id,s.label_no,s.room_type,r.room_no,row_number() OVER (PARTITION BY s.drawing_id ORDER BY sqrt((s.x-(r.x0+r.x1)/2)*(s.x-(r.x0+r.x1)/2)+(s.y-r.y1/2)*(s.y-r.y1/2)),s.label_no,r.room_no) AS k FROM spot s JOIN fp_cell r USING (drawing_id)),
taken AS (SELECT DISTINCT drawing_id,CAST(0 AS BIGINT) AS k,CAST([] AS BIGINT[]) AS l,CAST([] AS BIGINT[]) AS r,FALSE AS hit FROM queue
UNION ALL SELECT drawing_id,qk,CASE WHEN ok THEN list_append(l,label_no) ELSE l END,CASE WHEN ok THEN list_append(r,room_no) ELSE r END,ok
FROM (SELECT t.drawing_id,t.l,t.r,q.k AS qk,q.label_no,q.room_no,NOT list_contains(t.l,q.label_no) AND NOT list_contains(t.r,q.room_no) AS ok FROM taken t JOIN queue q ON q.drawing_id=t.drawing_id AND q.k=t.k+1))
SELECT q.drawing_id,q.room_no,q.label_no,q.room_type FROM taken t JOIN queue q ON q.drawing_id=t.drawing_id AND q.k=t.k WHERE t.hit"""


def _part(shift: str) -> str:
    light, full = 0.72, 0.55
    high = light + full - light * full
    low = 2 * light - high
    t = f"t{shift}"
    value = f"CASE WHEN {t}<{1 / 6!r}::DOUBLE THEN {low!r}::DOUBLE+{high - low!r}::DOUBLE*6*{t} WHEN {t}<0.5 THEN {high!r}::DOUBLE WHEN {t}<{2 / 3!r}::DOUBLE THEN {low!r}::DOUBLE+{high - low!r}::DOUBLE*6*({2 / 3!r}::DOUBLE-{t}) ELSE {low!r}::DOUBLE END"
    return f"format('{{:02x}}',CAST(floor(({value})*255+0.5) AS INTEGER))"


_hue = "(room_no-1)/count(*) OVER (PARTITION BY drawing_id)::DOUBLE"
_colours = f""",
hue AS (SELECT drawing_id,room_no,{_hue} AS hue FROM fp_cell),
turns AS (SELECT *,(hue+{1 / 3!r}::DOUBLE)%1.0::DOUBLE AS tr,hue%1.0::DOUBLE AS tg,((hue+{-1 / 3!r}::DOUBLE)%1.0::DOUBLE+1.0::DOUBLE)%1.0::DOUBLE AS tb FROM hue),
colours AS (SELECT drawing_id,room_no,'#'||{_part('r')}||{_part('g')}||{_part('b')} AS colour FROM turns)"""
C.ORACLE_SQL["palette"] = C.CTES + _colours + "\nSELECT drawing_id,room_no,colour FROM colours"


C.ORACLE_SQL["pipeline_v1"] = f"""{C.CTES},
one AS (SELECT drawing_id,0.0::DOUBLE AS x0,xmax AS x1,0.0::DOUBLE AS y0,h AS y1,xmax*h AS area_raw FROM ext),
dc AS (SELECT drawing_id,count(*) AS n FROM (SELECT drawing_id,cx x,cy y,radius FROM fp_door) p JOIN one USING (drawing_id) WHERE {S.TO_LINE}<=1.0+radius GROUP BY ALL),
said AS (SELECT drawing_id,arg_min(text,text_no) AS txt FROM fp_text GROUP BY ALL),
fur AS (SELECT drawing_id,list(coalesce({S.first_contained('upper(name)', K.FURNITURE_V1)},'GENERIC')) AS f FROM fp_block GROUP BY ALL),
ctx AS (SELECT o.drawing_id,area_raw,area_raw*10.7639::DOUBLE AS area_sqft,greatest(x1,y1)/least(x1,y1) AS aspect,coalesce(dc.n,0) AS door_count,txt,f FROM one o LEFT JOIN dc USING (drawing_id) LEFT JOIN said USING (drawing_id) LEFT JOIN fur USING (drawing_id))
SELECT drawing_id,CAST(1 AS BIGINT) AS room_no,area_raw,CASE WHEN txt IS NOT NULL THEN txt WHEN list_contains(f,'STOVE') THEN 'Kitchen' WHEN list_contains(f,'BED') THEN 'Bedroom' WHEN list_has_any(f,['WC','SINK']) THEN CASE WHEN area_sqft<60 THEN 'Toilet' ELSE 'Bathroom' END
WHEN list_has_any(f,['SOFA','DINING']) THEN CASE WHEN area_sqft>140 THEN 'Hall' ELSE 'Living Room' END WHEN area_sqft<35 THEN 'Toilet' WHEN area_sqft>200 AND door_count>=2 AND aspect<3 THEN 'Hall' ELSE {S.geometry_v1()} END AS name,
CASE WHEN txt IS NOT NULL THEN 0.95::DOUBLE WHEN list_contains(f,'STOVE') THEN 0.93::DOUBLE WHEN list_contains(f,'BED') THEN 0.92::DOUBLE WHEN list_has_any(f,['WC','SINK']) THEN 0.91::DOUBLE
WHEN list_has_any(f,['SOFA','DINING']) THEN CASE WHEN area_sqft>140 THEN 0.83::DOUBLE ELSE 0.8::DOUBLE END WHEN area_sqft<35 THEN 0.76::DOUBLE WHEN area_sqft>200 AND door_count>=2 AND aspect<3 THEN 0.8::DOUBLE ELSE 0.62::DOUBLE END AS confidence,
CASE WHEN txt IS NOT NULL THEN 'text' WHEN list_has_any(f,['STOVE','BED','WC','SINK','SOFA','DINING']) THEN 'rules+furniture' WHEN area_sqft<35 OR (area_sqft>200 AND door_count>=2 AND aspect<3) THEN 'rules+area' ELSE 'rules' END AS method FROM ctx"""


_kept_cells = ",\nkept AS (SELECT drawing_id,x0,x1,0.0::DOUBLE AS y0,y1,area_raw,row_number() OVER (PARTITION BY drawing_id ORDER BY area_raw,x0) AS room_no FROM byarea WHERE NOT (k=1 AND coalesce(area_raw>nxt*1.5,FALSE)))"
_kept_feat = f""",
ownk AS (SELECT drawing_id,min(room_no) AS room_no,block_no,{S.block_hint('name', 1)} AS hint,{S.block_hint('name', 2)} AS sure FROM fp_block JOIN kept USING (drawing_id) WHERE {S.INSIDE} GROUP BY drawing_id,block_no,name),
featk AS (SELECT c.drawing_id,c.room_no,c.area_raw*10.7639::DOUBLE AS area_sqft,greatest(c.x1-c.x0,c.y1)/least(c.x1-c.x0,c.y1) AS aspect,least(1.0,{4 * C.math.pi!r}::DOUBLE*area_raw/((2*(x1-x0)+2*y1)*(2*(x1-x0)+2*y1))) AS compactness,
t.text AS raw,coalesce(o.hint,'') AS bl,coalesce(o.sure,0.0) AS bc FROM kept c JOIN walk w ON w.drawing_id=c.drawing_id AND w.room_no=c.room_no LEFT JOIN fp_text t ON t.drawing_id=c.drawing_id AND t.text_no=w.pick LEFT JOIN ownk o ON o.drawing_id=c.drawing_id AND o.room_no=c.room_no),
linkk AS (SELECT drawing_id,door_no,room_no FROM (SELECT drawing_id,door_no,cx x,cy y,radius FROM fp_door) p JOIN kept r USING (drawing_id) WHERE {S.TO_LINE}<=1.5+radius OR {S.INSIDE}),
edgek AS (SELECT DISTINCT a.drawing_id,a.room_no,b.room_no AS other FROM linkk a JOIN linkk b ON a.drawing_id=b.drawing_id AND a.door_no=b.door_no AND a.room_no<>b.room_no
UNION SELECT a.drawing_id,a.room_no,b.room_no FROM kept a JOIN kept b ON a.drawing_id=b.drawing_id AND (a.x1=b.x0 OR a.x0=b.x1)),
others AS (SELECT drawing_id,room_no,list(other ORDER BY other) AS os FROM edgek GROUP BY ALL),
firsts AS (SELECT drawing_id,list(coalesce(raw,concat('Room ',room_no)) ORDER BY room_no) AS names FROM featk GROUP BY ALL),
toldk AS (SELECT *,CASE WHEN bl<>'' THEN bl ELSE gl END AS cd,'' AS vl,0.0::DOUBLE AS vc FROM (SELECT f.*,coalesce(os,[]) AS os,{S.room_label('raw')} AS named,{S.geometry(0)} AS gl,{S.geometry(1)} AS gc FROM featk f LEFT JOIN others o ON o.drawing_id=f.drawing_id AND o.room_no=f.room_no))"""
_hits = f"len(list_filter(around,lambda n: {S.goes_with('cd', 'n')}))"
_hosted = f"len(list_filter(around,lambda n: {S.goes_with('n', 'cd')}))>0"
_label_steps = f""",
stepk AS (SELECT drawing_id,CAST(0 AS BIGINT) AS room_no,CAST([] AS VARCHAR[]) AS labels,CAST(NULL AS VARCHAR) AS label,0.0::DOUBLE AS confidence,'' AS method FROM firsts
UNION ALL SELECT drawing_id,room_no,list_append(labels,label),label,confidence,method FROM (SELECT drawing_id,room_no,labels,CASE WHEN named IS NOT NULL THEN named ELSE {S.vote(_told_votes)[0]} END AS label,CASE WHEN named IS NOT NULL THEN 0.9::DOUBLE ELSE {S.vote(_told_votes)[1]} END AS confidence,
CASE WHEN named IS NOT NULL THEN 'cad_label' WHEN bl<>'' AND bc>0 THEN 'rules+blocks' ELSE 'rules' END AS method FROM (SELECT *,CASE WHEN nc>0 THEN cd ELSE '' END AS nl FROM (SELECT *,CASE WHEN {_hits}>0 THEN least(0.85::DOUBLE,0.4::DOUBLE+0.15::DOUBLE*{_hits}) WHEN {_hosted} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS nc
FROM (SELECT t.*,s.labels,list_transform(t.os,lambda o: CASE WHEN o<=len(s.labels) THEN s.labels[o] ELSE f.names[o] END) AS around FROM stepk s JOIN toldk t ON t.drawing_id=s.drawing_id AND t.room_no=s.room_no+1 JOIN firsts f ON f.drawing_id=s.drawing_id)))))"""
_labels_of_kept = C._by_area + _kept_cells + C._assign.replace("fp_cell", "kept") + _kept_feat + _label_steps
C.ORACLE_SQL["pipeline_v2_labels"] = C.CTES + _labels_of_kept + "\nSELECT drawing_id,room_no,label AS name,confidence,method FROM stepk WHERE room_no>0"


@query(
    "payload_rooms",
    "SELECT s.drawing_id,'completed' AS status,s.room_no,s.label AS name,round(f.area_sqft,2) AS area_sqft,CASE WHEN round(s.confidence,3)=0 THEN 0.5::DOUBLE ELSE round(s.confidence,3) END AS confidence,s.method AS classification_method FROM stepk s JOIN featk f ON f.drawing_id=s.drawing_id AND f.room_no=s.room_no",
    _labels_of_kept,
)
def payload_rooms(d: Drawings) -> DataFrame:
    """The rooms as the payload's JSON has them."""
    drawn = Drawing(d.segment, d.text, d.door, d.block)
    rows = payload(run_pipeline(drawn, use_raster=False), drawn.segments)
    kind = "status string, floors array<struct<rooms:array<struct<room_no:long,name:string,area_sqft:double,confidence:double,classification_method:string>>>>"
    read = rows.select("drawing_id", F.from_json("payload", kind).alias("p"))
    return read.select("drawing_id", "p.status", F.explode(F.get("p.floors", F.lit(0))["rooms"]).alias("r")).select("drawing_id", "status", "r.*")


@query("empty_payload", "SELECT drawing_id,'no_rooms_detected' AS status,0 AS rooms FROM ext")
def empty_payload(d: Drawings) -> DataFrame:
    """Drawings without rooms."""
    none = run_pipeline(Drawing(d.segment.where("layer = 'A-DIMS'"), d.text, d.door, d.block), use_raster=False)
    rows = payload(none, d.segment)
    read = F.from_json("payload", "floors array<struct<rooms:array<struct<room_no:long>>>>")
    return rows.select("drawing_id", "status", F.size(read["floors"][0]["rooms"]).alias("rooms"))


@query("room_questions", "SELECT drawing_id,room_no,concat('Area: ',format('{:.0f}',area_raw+0.25),' sqft') AS area,'Furniture: BED, SOFA' AS furniture,CASE WHEN room_no%2=0 THEN 'Adjacent rooms: unknown' ELSE 'Adjacent rooms: Hall' END AS adjacent FROM fp_cell")
def room_questions(d: Drawings) -> DataFrame:
    """The lines of a question about one room."""
    near = F.when(F.col("room_no") % 2 == 1, F.array(F.lit("Hall")))
    lines = F.split(answers.room_question(F.col("area_raw") + 0.25, F.array(F.lit("BED"), F.lit("SOFA")), near), "\n")
    return d.cell.select("drawing_id", "room_no", *[F.get(lines, F.lit(k)).alias(n) for k, n in ((1, "area"), (2, "furniture"), (3, "adjacent"))])


@query("floor_questions", "SELECT drawing_id,concat(count(*),' detected rooms:') AS heading,CAST(count(*) AS INTEGER) AS lines FROM fp_cell GROUP BY ALL")
def floor_questions(d: Drawings) -> DataFrame:
    line = answers.room_line(F.col("room_no"), F.col("area_raw"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit("Hall"))
    rows = d.cell.select("drawing_id", line.alias("line")).groupBy("drawing_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("rooms"), F.count(F.lit(1)).alias("n"))
    asked = answers.floor_question(F.col("rooms"), F.col("n"))
    return rows.select("drawing_id", F.regexp_extract(asked, r"(\d+ detected rooms:)", 1).alias("heading"), F.regexp_count(asked, F.lit("(?m)^  Room ")).alias("lines"))


@query("answers_v1", "SELECT drawing_id,l_partkey,l_suppkey,CASE l_partkey%3 WHEN 0 THEN 1 ELSE 0 END AS n FROM fp_feature")
def answers_v1(d: Drawings) -> DataFrame:
    """The older reader wants JSON from the first bracket to the end."""
    good = '```json\n[{"room_index": 1, "room_type": "Hall"}]\n```'
    said = F.get(F.array(F.lit(good), F.lit("[1, 2"), F.lit("no list")), (F.col("l_partkey") % 3).cast("int"))
    return d.feature.select("drawing_id", "l_partkey", "l_suppkey", F.size(answers.answer_list_v1(said)).alias("n"))


@query("model_fallback", "SELECT drawing_id,room_no,CASE room_no%4 WHEN 0 THEN 'first: hi' WHEN 1 THEN 'second: hi' END AS answer,CASE room_no%4 WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS model,CASE room_no%4 WHEN 2 THEN 'bad picture' WHEN 3 THEN '429 second' END AS error FROM fp_cell")
def model_fallback(d: Drawings) -> DataFrame:
    """Quota errors go on to the next model, others do not."""

    def call(model: str, question: str, picture: bytes | None) -> str:
        kind = int(question) % 4
        if kind == 2:
            raise ValueError("bad picture")
        if kind == 3 or (kind == 1 and model == "first"):
            raise RuntimeError(f"429 {model}")
        return f"{model}: hi"

    asked = d.cell.select("drawing_id", "room_no", F.col("room_no").cast("string").alias("question"))
    return ask.ask_models(asked, call, ("first", "second"), ["drawing_id", "room_no"])


@query("picture_rooms_named", "SELECT drawing_id,room_no,CASE WHEN room_no%2=0 THEN 'one' WHEN room_no%3=0 THEN 'floor' END AS room_type FROM fp_cell WHERE room_no%2=0 OR room_no%3=0")
def picture_rooms_named(d: Drawings) -> DataFrame:
    """Answers about whole floors come before those about single rooms."""
    bulk = d.cell.where("room_no % 2 = 0").select("drawing_id", "room_no", F.lit("one").alias("room_type"), F.lit(0.5).alias("confidence"))
    single = d.cell.where("room_no % 3 = 0").select("drawing_id", "room_no", F.lit("floor").alias("room_type"), F.lit(0.5).alias("confidence"))
    return enrich.both_answers(bulk, single).select("drawing_id", "room_no", "room_type")


# ---- reports, store, pictures -------------------------------------------------------------------------------------------

@query("unsure_rooms", "SELECT drawing_id,room_no,label FROM steps WHERE room_no>0 AND coalesce(confidence,0)<0.75", C._classified)
def unsure_rooms(d: Drawings) -> DataFrame:
    table = C.strip_rooms(d)
    found = classify.classify_rooms(table, adjacency.both_ways(adjacency.shared_walls(table)))
    return reports.unsure_rooms(found).select("drawing_id", "room_no", "label")


@query("furnished_rooms", f"SELECT c.drawing_id,count(*) AS rooms,count(p.room_no) AS furnished FROM fp_cell c LEFT JOIN (SELECT DISTINCT drawing_id,room_no FROM placed WHERE {S.block_hint('name', 0)}<>'GENERIC') p USING (drawing_id,room_no) GROUP BY ALL", C._placed)
def furnished_rooms(d: Drawings) -> DataFrame:
    table = C.room_table(d)
    return reports.furnished_rooms(table.join(blocks.furniture(blocks.blocks_in_rooms(d.block, table)), ["drawing_id", "room_no"], "left"))


@query(
    "corpus_precision",
    "SELECT count(*) AS files,avg(coalesce(precision,0)) AS average_precision,avg(coalesce(precision,0))>=0.25 AS passed FROM ext e LEFT JOIN prec p USING (drawing_id) WHERE e.drawing_id%5<>0",
    C._scored,
)
def corpus_precision(d: Drawings) -> DataFrame:
    """Every drawing but each fifth is in the labelled corpus."""
    ids = d.cell.where("drawing_id % 5 <> 0").select(F.col("drawing_id").cast("string").alias("file")).distinct()
    sample = F.struct("file", F.array(*map(F.lit, ("Living  Hall", "kitchenette", "W.C."))).alias("expected_labels"))
    texts = ids.groupBy(F.pmod(F.xxhash64("file"), F.lit(8))).agg(F.to_json(F.struct(F.lit(0.25).alias("min_precision"), F.collect_list(sample).alias("samples"))).alias("content")).select("content")
    predicted = d.cell.select("drawing_id").distinct().join(d.text.select("drawing_id", F.col("text").alias("label")), "drawing_id", "left")
    return reports.corpus_precision(predicted.withColumn("drawing_id", F.col("drawing_id").cast("string")), reports.corpus_samples(texts))


@query("older_rooms", "SELECT drawing_id,room_no,CAST(NULL AS DOUBLE) AS confidence,CAST(NULL AS VARCHAR) AS method FROM fp_cell")
def older_rooms(d: Drawings) -> DataFrame:
    """Rows of an older schema get the columns that they lack."""
    return store.with_columns_of(d.cell.select("drawing_id", "room_no"), "drawing_id long, room_no long, confidence double, method string")


@query("file_kinds", "SELECT DISTINCT layer AS path,CASE WHEN layer='ROOF' THEN 'uploaded' WHEN layer='SLAB' THEN 'unsupported' ELSE 'rejected' END AS status FROM fp_layer")
def file_kinds(d: Drawings) -> DataFrame:
    rows = d.layer.select("layer").distinct()
    name = F.when(F.col("layer") == "ROOF", "x/a.DXF").when(F.col("layer") == "SLAB", "b.dwg").otherwise(F.concat("layer", F.lit(".txt")))
    return dxf.file_status(rows.withColumn("path", name)).select(F.col("layer").alias("path"), "status")


def _seen_colours(pictures: DataFrame) -> DataFrame:
    """drawing_id, room_no, w, h, colour: of the pixels at places (room_no, px, py), from the bottom left as shares, of each picture."""

    def run(batches):
        for batch in batches:
            found, count = [], []
            for data, places in zip(batch.column("png").to_pylist(), plain(batch.column("places"))):
                count.append(len(places))
                found += zip([p["room_no"] for p in places], png.colours_at(data, [(p["px"], p["py"]) for p in places]))
            if found:
                number, colour = zip(*found)
                own = pa.array(np.repeat(np.arange(batch.num_rows), count))
                yield pa.RecordBatch.from_arrays([batch.column("drawing_id").take(own), pa.array(number, pa.int64()), *(batch.column(n).take(own) for n in ("width", "height")), pa.array(colour, pa.string())], ["drawing_id", "room_no", "w", "h", "colour"])

    return pictures.select("drawing_id", "width", "height", "png", "places").mapInArrow(run, "drawing_id long, room_no long, w int, h int, colour string")


_picture_size = """,
frame AS (SELECT drawing_id,max(x1) AS fw,max(y1)+1 AS fh FROM fp_cell GROUP BY ALL),
img AS (SELECT drawing_id,greatest(CAST(ceil(fw*(256.0::DOUBLE/greatest(fw,fh))) AS INTEGER),4) AS w,greatest(CAST(ceil(fh*(256.0::DOUBLE/greatest(fw,fh))) AS INTEGER),4) AS h FROM frame)"""


@query("floor_pictures", "SELECT drawing_id,room_no,w,h,colour FROM colours JOIN img USING (drawing_id)", _colours + _picture_size)
def floor_pictures(d: Drawings) -> DataFrame:
    """Floors as PNG files: their sizes, and the colours that the rooms' centres have in the files."""
    whole = d.cell.groupBy("drawing_id").agg(F.max("x1").alias("fw"), F.max("y1").alias("fh"))
    middle = ((F.col("x0") + F.col("x1")) / 2 / F.col("fw")).alias("px"), ((F.col("y1") / 2 + 1) / (F.col("fh") + 1)).alias("py")
    places = d.cell.join(whole, "drawing_id").select("drawing_id", F.struct("room_no", *middle).alias("p")).groupBy("drawing_id").agg(F.collect_list("p").alias("places"))
    return _seen_colours(png.floor_png(C.room_table(d), d.segment, longest=256, stroke=1).join(places, "drawing_id"))


@query("room_crops", "SELECT drawing_id,room_no,colour FROM colours", _colours)
def room_crops(d: Drawings) -> DataFrame:
    """Single rooms as PNG files: the colours of their centres."""
    pictures = png.room_png(C.room_table(d), d.segment, longest=64, stroke=1)
    centre = F.struct("room_no", F.lit(0.5).alias("px"), F.lit(0.5).alias("py"))
    return _seen_colours(pictures.withColumn("places", F.array(centre))).select("drawing_id", "room_no", "colour")


@query("room_shapes_svg", "SELECT drawing_id,room_no,concat('fill=\"',colour,'\"') AS fill FROM colours", _colours)
def room_shapes_svg(d: Drawings) -> DataFrame:
    """The colours of single rooms' SVG pictures."""
    pictures = svg.room_pictures(C.room_table(d), crops=True)
    return pictures.select("drawing_id", "room_no", F.regexp_extract("content", '(fill="#[0-9a-f]{6}")', 1).alias("fill"))


@query("layer_filter_switch", "SELECT drawing_id,layer,seq FROM fp_layer f WHERE EXISTS (SELECT 1 FROM ranked w WHERE w.drawing_id=f.drawing_id AND (CASE WHEN w.anyw THEN w.wall ELSE w.k<=5 END) AND contains(upper(f.layer),w.layer))", C._wall_layers_sql(K.WALL_LAYER_HINTS_V1, "", "")[1])
def layer_filter_switch(d: Drawings) -> DataFrame:
    """The older engine's layers: those with wall words, else the five fullest."""
    return layers.wall_segments_v1(d.layer, layers.wall_layers_v1(layers.layer_counts(d.layer, F.col("seq"))))
