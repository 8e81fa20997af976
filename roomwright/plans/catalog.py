"""Registered queries: each operator on the derived drawings, and its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import answers, drawing, scoring, shapes, text, units
from ..operators import adjacency, blocks, cells, classify, doors, enrich, layers, matching, merge, noding, reports, rooms, texts
from ..operators.tables import written
from . import sqltext as S
from .fixtures import CTES, Drawings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, more: str = "") -> Callable:
    """Registers a function of the derived drawings; sql is the body after the fixtures' CTEs and `more` CTEs."""

    def register(build: Callable[[Drawings], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(Drawings(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"{CTES}{more}\n{sql}"
        return build

    return register


def c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def room_table(d: Drawings) -> DataFrame:
    """The strips' rooms as rings, numbered from left to right."""
    return d.cell.select("drawing_id", "room_no", shapes.rectangle(*c("x0", "y0", "x1", "y1")).alias("ring"), "area_raw", F.concat(F.lit("Room "), F.col("room_no").cast("string")).alias("name"))


def box(rows: DataFrame) -> DataFrame:
    b = shapes.bounds(F.col("ring"))
    return rows.withColumn("_b", b).select("drawing_id", *[F.col(f"_b.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")], "area_raw")


# ---- sources, layers, segments -------------------------------------------------------------------------------------------

@query("segment_length", "SELECT drawing_id,layer,sx,sy,ex,ey,sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) AS length,degrees(atan2(ey-sy,ex-sx)) AS angle FROM fp_segment")
def segment_length(d: Drawings) -> DataFrame:
    xy = c("sx", "sy", "ex", "ey")
    return d.segment.select("*", shapes.length(*xy).alias("length"), shapes.angle(*xy).alias("angle"))


_code = "drawing_id%9"


@query(
    "unit_conversion",
    f"""SELECT drawing_id,coalesce({S.exact(_code, K.UNIT_METRES)},1.0) AS to_metres,coalesce({S.exact(_code, K.UNIT_SQFT)},10.7639::DOUBLE) AS area_to_sqft,
sqrt(coalesce({S.exact(_code, K.UNIT_SQFT)},10.7639::DOUBLE)) AS linear_to_feet,coalesce({S.exact(_code, K.UNIT_FEET)},1.0::DOUBLE) AS feet_v1,
coalesce({S.exact(_code, K.UNIT_FEET)},1.0::DOUBLE)*coalesce({S.exact(_code, K.UNIT_FEET)},1.0::DOUBLE) AS sqft_v1 FROM (SELECT DISTINCT drawing_id FROM fp_cell)""",
)
def unit_conversion(d: Drawings) -> DataFrame:
    code = F.col("drawing_id") % 9
    return d.cell.select("drawing_id").distinct().select(
        "drawing_id", units.metres_per_unit(code).alias("to_metres"), units.sqft_per_unit(code).alias("area_to_sqft"), units.feet_per_unit(code).alias("linear_to_feet"),
        units.feet_per_unit_v1(code).alias("feet_v1"), units.sqft_per_unit_v1(code).alias("sqft_v1"),
    )


_counts = ",\ncounts AS (SELECT drawing_id,upper(trim(layer)) AS layer,count(*) AS n,min(seq) AS first_seen FROM fp_layer GROUP BY ALL)"


@query("layer_counts", "SELECT drawing_id,layer,n FROM counts", _counts)
def layer_counts(d: Drawings) -> DataFrame:
    return layers.layer_counts(d.layer, F.col("seq")).select("drawing_id", "layer", "n")


def _wall_layers_sql(hints, noise: str, hinted_order: str) -> tuple[str, str]:
    more = _counts + f""",
tagged AS (SELECT *,{S.contains_any('layer', hints)} AS wall FROM counts),
ranked AS (SELECT *,bool_or(wall) OVER (PARTITION BY drawing_id) AS anyw,row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC,first_seen,layer) AS k FROM tagged)"""
    return f"SELECT drawing_id,layer,row_number() OVER (PARTITION BY drawing_id ORDER BY {hinted_order}n DESC,first_seen,layer) AS rank FROM ranked WHERE CASE WHEN anyw THEN wall ELSE k<=5{noise} END", more


@query("wall_layers", *_wall_layers_sql(K.WALL_LAYER_HINTS, f" AND NOT {S.contains_any('layer', K.NOISE_LAYERS)}", ""))
def wall_layers(d: Drawings) -> DataFrame:
    return layers.wall_layers(layers.layer_counts(d.layer, F.col("seq")))


@query("wall_layers_v1", *_wall_layers_sql(K.WALL_LAYER_HINTS_V1, "", "CASE WHEN anyw THEN layer END,"))
def wall_layers_v1(d: Drawings) -> DataFrame:
    return layers.wall_layers_v1(layers.layer_counts(d.layer, F.col("seq")))


_noise = S.contains_any("upper(layer)", K.GRAPH_NOISE)


@query("wall_segment_filter", f"SELECT * FROM fp_segment WHERE NOT {_noise}")
def wall_segment_filter(d: Drawings) -> DataFrame:
    return layers.wall_segments(d.segment)


@query(
    "wall_segment_listed",
    f"SELECT drawing_id,layer,seq FROM fp_layer f WHERE NOT {_noise} AND ({S.contains_any('upper(layer)', K.GRAPH_WALL_HINTS)} OR EXISTS (SELECT 1 FROM walls w WHERE w.drawing_id=f.drawing_id AND contains(upper(f.layer),w.layer)))",
    _wall_layers_sql(K.WALL_LAYER_HINTS, f" AND NOT {S.contains_any('layer', K.NOISE_LAYERS)}", "")[1]
    + f",\nwalls AS (SELECT drawing_id,layer FROM ranked WHERE CASE WHEN anyw THEN wall ELSE k<=5 AND NOT {S.contains_any('layer', K.NOISE_LAYERS)} END)",
)
def wall_segment_listed(d: Drawings) -> DataFrame:
    return layers.wall_segments(d.layer, layers.wall_layers(layers.layer_counts(d.layer, F.col("seq"))))


@query("wall_segments_v1", "SELECT * FROM fp_segment WHERE NOT contains(upper(layer),'DIM') AND contains(upper(layer),'A-WALL')")
def wall_segments_v1(d: Drawings) -> DataFrame:
    walls = d.segment.select("drawing_id", F.lit("A-WALL").alias("layer")).distinct()
    return layers.wall_segments_v1(d.segment, walls, ("DIM",))


@query("segment_min_length", "SELECT drawing_id,layer,sx,sy,ex,ey FROM fp_segment WHERE sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy))>=2.5")
def segment_min_length(d: Drawings) -> DataFrame:
    return layers.at_least(d.segment, 2.5)


_sweep = "(CASE WHEN end_deg=start_deg THEN 360.0::DOUBLE ELSE ((end_deg-start_deg)%360.0::DOUBLE+360.0::DOUBLE)%360.0::DOUBLE END)"
_metres = f"coalesce({S.exact('units', K.UNIT_METRES)},1.0)"


@query("door_arc_classify", f"SELECT drawing_id,{_sweep} AS sweep_deg,radius*{_metres} AS radius_m,radius*{_metres} BETWEEN 0.65::DOUBLE AND 1.10::DOUBLE AND {_sweep} BETWEEN 60 AND 105 AS is_door,{_sweep} BETWEEN 70 AND 100 AS is_door_v1 FROM fp_arc")
def door_arc_classify(d: Drawings) -> DataFrame:
    sweep, radius_m = shapes.sweep(*c("start_deg", "end_deg")), F.col("radius") * units.metres_per_unit(F.col("units"))
    return d.arc.select("drawing_id", sweep.alias("sweep_deg"), radius_m.alias("radius_m"), shapes.is_door_arc(radius_m, sweep).alias("is_door"), sweep.between(70.0, 100.0).alias("is_door_v1"))


_n = f"greatest(3,CAST(floor(12*({_sweep}/90.0::DOUBLE)) AS INTEGER))"
_at = f"radians(start_deg+{_sweep}*k/{_n})"


@query("arc_tessellate", f"SELECT drawing_id,k,CAST(floor((5.0+radius*cos({_at}))*1e5+0.5) AS BIGINT) AS x5,CAST(floor((7.0+radius*sin({_at}))*1e5+0.5) AS BIGINT) AS y5 FROM (SELECT *,unnest(range(0,{_n}+1)) AS k FROM fp_arc)")
def arc_tessellate(d: Drawings) -> DataFrame:
    sweep = shapes.sweep(*c("start_deg", "end_deg"))
    points = shapes.arc_points(F.lit(5.0), F.lit(7.0), F.col("radius"), F.col("start_deg"), sweep, shapes.chords(sweep))
    rows = d.arc.select("drawing_id", F.posexplode(points).alias("k", "p"))
    return rows.select("drawing_id", F.col("k").cast("long").alias("k"), *[F.floor(F.col(f"p.{a}") * 1e5 + 0.5).alias(f"{a}5") for a in "xy"])


@query(
    "text_dedupe",
    "SELECT drawing_id,text_no,text,x,y FROM (SELECT *,row_number() OVER (PARTITION BY drawing_id,upper(text),round(x,2),round(y,2) ORDER BY text_no) AS k FROM twice) WHERE k=1",
    ",\ntwice AS (SELECT drawing_id,text_no,text,x,y FROM fp_text UNION ALL SELECT drawing_id,text_no+100,upper(text),x+0.001,y FROM fp_text)",
)
def text_dedupe(d: Drawings) -> DataFrame:
    again = d.text.select("drawing_id", (F.col("text_no") + 100).alias("text_no"), F.concat(F.lit(" "), F.upper("text")).alias("text"), (F.col("x") + 0.001).alias("x"), "y")
    return texts.distinct_texts(d.text.unionByName(again))


_kind = S.first_contained("upper(name)", K.FURNITURE)


@query("block_type", f"SELECT drawing_id,block_no,name,CASE WHEN {S.contains_any('upper(name)', K.DOOR_BLOCKS)} THEN 'DOOR' ELSE coalesce({_kind},'GENERIC') END AS type,coalesce({S.first_contained('upper(name)', K.FURNITURE_V1)},'GENERIC') AS type_v1 FROM fp_block")
def block_type(d: Drawings) -> DataFrame:
    return d.block.select("drawing_id", "block_no", "name", text.block_type(F.col("name")).alias("type"), text.block_type_v1(F.col("name")).alias("type_v1"))


@query("block_room_hint", f"SELECT drawing_id,block_no,{S.block_hint('name', 0)} AS type,{S.block_hint('name', 1)} AS room,{S.block_hint('name', 2)} AS confidence FROM fp_block")
def block_room_hint(d: Drawings) -> DataFrame:
    return d.block.select("drawing_id", "block_no", text.block_hint(F.col("name")).alias("h")).select("drawing_id", "block_no", "h.*")


@query("label_normalize", f"SELECT drawing_id,raw,{S.room_label('raw')} AS label FROM fp_label")
def label_normalize(d: Drawings) -> DataFrame:
    return d.label.select("drawing_id", "raw", text.room_label(F.col("raw")).alias("label"))


@query("label_normalize_ocr", f"SELECT drawing_id,raw,{S.ocr_label('raw')} AS label FROM fp_label")
def label_normalize_ocr(d: Drawings) -> DataFrame:
    return d.label.select("drawing_id", "raw", text.ocr_label(F.col("raw")).alias("label"))


@query("label_normalize_bulk", f"SELECT DISTINCT raw,coalesce({S.short_label('raw')},{S.title('raw')}) AS label,{S.short_label('raw')} IS NOT NULL AS known FROM fp_label")
def label_normalize_bulk(d: Drawings) -> DataFrame:
    return d.label.select("raw").distinct().select("raw", text.offline_label(F.col("raw")).alias("label"), text.short_label(F.col("raw")).isNotNull().alias("known"))


# ---- wall graph and rooms -----------------------------------------------------------------------------------------------

_ends = ",\nends AS (SELECT DISTINCT drawing_id,x,y FROM (SELECT drawing_id,sx x,sy y FROM fp_segment WHERE layer='A-WALL' UNION ALL SELECT drawing_id,ex,ey FROM fp_segment WHERE layer='A-WALL'))"


def wall_lines(d: Drawings) -> DataFrame:
    return layers.at_least(layers.wall_segments(d.segment), 1e-6, strict=True)


@query("endpoint_unique", "SELECT * FROM ends", _ends)
def endpoint_unique(d: Drawings) -> DataFrame:
    return noding.endpoints(wall_lines(d))


_gap_cells = _ends + """,
placed AS MATERIALIZED (SELECT drawing_id,x,y,CAST(floor(x/1.1::DOUBLE) AS BIGINT) AS i,CAST(floor(y/1.1::DOUBLE) AS BIGINT) AS j FROM ends),
near AS MATERIALIZED (SELECT drawing_id,x,y,i+di AS i,j+dj AS j FROM placed,(SELECT unnest([-1,0,1]) AS di),(SELECT unnest([-1,0,1]) AS dj))"""


@query(
    "gap_bridges",
    """SELECT a.drawing_id,a.x AS sx,a.y AS sy,b.x AS ex,b.y AS ey FROM near a JOIN placed b ON a.drawing_id=b.drawing_id AND a.i=b.i AND a.j=b.j
WHERE (a.x<b.x OR (a.x=b.x AND a.y<b.y)) AND sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) BETWEEN 0.7 AND 1.1""",
    _gap_cells,
)
def gap_bridges(d: Drawings) -> DataFrame:
    return noding.gap_bridges(wall_lines(d))


@query("graph_edges", "SELECT DISTINCT drawing_id,sx AS ax,sy AS ay,ex AS bx,ey AS by FROM fp_segment WHERE layer='A-WALL'")
def graph_edges(d: Drawings) -> DataFrame:
    return noding.graph_edges(wall_lines(d))


def strip_faces(d: Drawings) -> DataFrame:
    return rooms.noded_faces(noding.with_bridges(wall_lines(d)))


@query("polygonize_rooms", "SELECT drawing_id,x0,y0,x1,y1,area_raw FROM fp_cell")
def polygonize_rooms(d: Drawings) -> DataFrame:
    return box(strip_faces(d))


@query("polygonize_by_grid", "SELECT drawing_id,x0,y0,x1,y1,area_raw FROM fp_cell")
def polygonize_by_grid(d: Drawings) -> DataFrame:
    """The same faces, with every drawing cut in the cells of a grid, the way that giant drawings take."""
    made = cells.faces(d.sheet.select("drawing_id", "layers", "lines"), cells.bridged_walls, whole=True)
    return made.select("drawing_id", "x0", "y0", "x1", "y1", "area_raw")


_kept = "(k=1 AND coalesce(area_raw>nxt*{},FALSE))"
_by_area = ",\nbyarea AS (SELECT *,row_number() OVER w AS k,lead(area_raw) OVER w AS nxt FROM fp_cell WINDOW w AS (PARTITION BY drawing_id ORDER BY area_raw DESC,x0 DESC))"


@query("outer_removal", f"SELECT drawing_id,x0,y0,x1,y1,area_raw FROM byarea WHERE NOT {_kept.format(1.5)}", _by_area)
def outer_removal(d: Drawings) -> DataFrame:
    return box(rooms.without_outer(room_table(d)))


@query("outer_removal_v1", f"SELECT drawing_id,x0,y0,x1,y1,area_raw FROM byarea WHERE NOT {_kept.format(1.8)}", _by_area)
def outer_removal_v1(d: Drawings) -> DataFrame:
    return box(rooms.without_outer(room_table(d), 1.8))


@query("min_area_filter", "SELECT drawing_id,x0,y0,x1,y1,area_raw FROM fp_cell WHERE area_raw>=200.0/10.7639")
def min_area_filter(d: Drawings) -> DataFrame:
    return box(rooms.large_enough(room_table(d), 200.0))


@query("room_numbering", "SELECT drawing_id,x0,row_number() OVER (PARTITION BY drawing_id ORDER BY area_raw,x0) AS room_no,concat('Room ',row_number() OVER (PARTITION BY drawing_id ORDER BY area_raw,x0)) AS name FROM fp_cell")
def room_numbering(d: Drawings) -> DataFrame:
    return rooms.numbered(room_table(d)).select("drawing_id", F.get("ring", F.lit(0))["x"].alias("x0"), "room_no", "name")


def _nested_rooms(d: Drawings) -> DataFrame:
    whole = d.cell.groupBy("drawing_id").agg(F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    outer = whole.select("drawing_id", F.lit(0).cast("long").alias("room_no"), shapes.rectangle(F.lit(0.0), F.lit(0.0), F.col("x1"), F.col("y1")).alias("ring"), (F.col("x1") * F.col("y1")).alias("area_raw"))
    return room_table(d).drop("name").unionByName(outer)


_nested = ",\nnest AS (SELECT drawing_id,room_no,x0,y0,x1,y1,area_raw FROM fp_cell UNION ALL SELECT drawing_id,0,0.0,0.0,xmax,h,xmax*h FROM ext)"


@query("nested_removal", "SELECT drawing_id,room_no FROM nest a WHERE NOT EXISTS (SELECT 1 FROM nest b WHERE a.drawing_id=b.drawing_id AND a.room_no<>b.room_no AND b.x0<=a.x0 AND b.x1>=a.x1 AND b.y0<=a.y0 AND b.y1>=a.y1 AND b.area_raw>a.area_raw*1.05)", _nested)
def nested_removal(d: Drawings) -> DataFrame:
    return rooms.without_nested(_nested_rooms(d)).select("drawing_id", "room_no")


@query("containment_removal", "SELECT drawing_id,room_no FROM nest a WHERE NOT EXISTS (SELECT 1 FROM nest b WHERE a.drawing_id=b.drawing_id AND a.room_no<>b.room_no AND (b.x0+b.x1)/2>a.x0 AND (b.x0+b.x1)/2<a.x1 AND a.area_raw>b.area_raw*1.1)", _nested)
def containment_removal(d: Drawings) -> DataFrame:
    return rooms.without_containers(_nested_rooms(d)).select("drawing_id", "room_no")


@query("thin_filter", "SELECT drawing_id,area_sqft,compactness FROM fp_feature WHERE NOT (compactness<0.10::DOUBLE AND area_sqft<35)")
def thin_filter(d: Drawings) -> DataFrame:
    return rooms.without_thin(d.feature).select("drawing_id", "area_sqft", "compactness")


@query(
    "room_shape_features",
    f"""SELECT drawing_id,room_no,area_raw,area_raw*10.7639::DOUBLE AS area_sqft,2*(x1-x0)+2*y1 AS perimeter,greatest(x1-x0,y1)/greatest(least(x1-x0,y1),1e-9) AS aspect,1.0::DOUBLE AS convexity,
least(1.0,{4 * math.pi!r}::DOUBLE*area_raw/((2*(x1-x0)+2*y1)*(2*(x1-x0)+2*y1))) AS compactness,CAST(floor((x0+x1)*5e4+0.5) AS BIGINT) AS cx5,CAST(floor(y1*5e4+0.5) AS BIGINT) AS cy5 FROM fp_cell""",
)
def room_shape_features(d: Drawings) -> DataFrame:
    rows = rooms.sized(rooms.with_shape(room_table(d)))
    return rows.select("drawing_id", "room_no", "area_raw", "area_sqft", "perimeter", "aspect", "convexity", "compactness", *[F.floor(F.col(f"c{a}") * 1e5 + 0.5).alias(f"c{a}5") for a in "xy"])


@query("cycle_basis_counts", "SELECT drawing_id,CAST(1 AS BIGINT) AS n FROM ext")
def cycle_basis_counts(d: Drawings) -> DataFrame:
    """The unbridged walls of a strip meet only at its corners, in no cut point, so the outline is the one cycle."""
    return rooms.cycles(noding.graph_edges(wall_lines(d), 4)).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))


@query("snapped_edges", "SELECT drawing_id,count(*) AS n FROM (SELECT DISTINCT drawing_id,sx,sy,ex,ey FROM fp_segment WHERE layer='A-WALL') GROUP BY ALL")
def snapped_edges(d: Drawings) -> DataFrame:
    """Edges 0.0003 apart fall together on the grid of 0.001."""
    g = noding.graph_edges(wall_lines(d))
    moved = g.select("drawing_id", (F.col("bx") + 0.0003).alias("ax"), F.col("by").alias("ay"), (F.col("ax") - 0.0003).alias("bx"), F.col("ay").alias("by"))
    return noding.snapped_edges(g.unionByName(moved)).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))


@query("merge_groups_v0", None)
def merge_groups_v0(d: Drawings) -> DataFrame:
    return merge.merge_groups_v0(room_table(d))


@query("merge_rooms_v1", None)
def merge_rooms_v1(d: Drawings) -> DataFrame:
    return box(merge.merge_rooms(room_table(d)))


# ---- doors, blocks, texts, adjacency ------------------------------------------------------------------------------------

_pairs = "FROM (SELECT drawing_id,door_no,cx x,cy y,radius FROM fp_door) p JOIN fp_cell r USING (drawing_id)"
_links = f",\nlinks AS (SELECT drawing_id,door_no,room_no {_pairs} WHERE {S.TO_LINE}<=1.5+radius OR {S.INSIDE})"


@query("door_room_join", "SELECT * FROM links", _links)
def door_room_join(d: Drawings) -> DataFrame:
    return doors.door_rooms(d.door, room_table(d))


@query("door_room_join_v1", f"SELECT drawing_id,door_no,room_no {_pairs} WHERE {S.TO_LINE}<=1.0+radius")
def door_room_join_v1(d: Drawings) -> DataFrame:
    return doors.door_rooms(d.door, room_table(d), 1.0, inside_counts=False)


@query("door_counts", "SELECT r.drawing_id,r.room_no,count(l.door_no) AS door_count FROM fp_cell r LEFT JOIN links l USING (drawing_id,room_no) GROUP BY ALL", _links)
def door_counts(d: Drawings) -> DataFrame:
    table = room_table(d)
    return doors.door_counts(doors.door_rooms(d.door, table), table)


_by_door = _links + ",\nbydoor AS (SELECT DISTINCT a.drawing_id,a.room_no i,b.room_no j FROM links a JOIN links b ON a.drawing_id=b.drawing_id AND a.door_no=b.door_no AND a.room_no<b.room_no)"


@query("door_adjacency", "SELECT * FROM bydoor", _by_door)
def door_adjacency(d: Drawings) -> DataFrame:
    return doors.door_adjacency(doors.door_rooms(d.door, room_table(d)))


@query("door_payload", "SELECT d.drawing_id,d.door_no,any_value(cx) AS cx,any_value(cy) AS cy,CASE WHEN any_value(radius)=0 THEN 0.9::DOUBLE ELSE any_value(radius) END AS width_m,any_value(source) AS source,any_value(layer) AS layer,list(room_no ORDER BY room_no) AS connected_rooms FROM fp_door d JOIN links USING (drawing_id,door_no) GROUP BY d.drawing_id,d.door_no", _links)
def door_payload(d: Drawings) -> DataFrame:
    rows = d.door.withColumns({"width_m": F.lit(None).cast("double"), "radius_m": F.col("radius")})
    return doors.door_payload(rows, doors.door_rooms(d.door, room_table(d)))


_placed = f",\nplaced AS (SELECT drawing_id,block_no,name,min(room_no) AS room_no FROM fp_block JOIN fp_cell USING (drawing_id) WHERE {S.INSIDE} GROUP BY ALL)"


@query("block_in_room", "SELECT drawing_id,block_no,name,room_no FROM placed", _placed)
def block_in_room(d: Drawings) -> DataFrame:
    return blocks.blocks_in_rooms(d.block, room_table(d))


def _furniture_sql(kind: str) -> str:
    return f"SELECT drawing_id,room_no,list(kind ORDER BY block_no) AS furniture FROM (SELECT *,{kind} AS kind FROM placed) WHERE kind<>'GENERIC' GROUP BY ALL"


@query("furniture_list", _furniture_sql(S.block_hint("name", 0)), _placed)
def furniture_list(d: Drawings) -> DataFrame:
    return blocks.furniture(blocks.blocks_in_rooms(d.block, room_table(d)))


@query("furniture_list_v1", _furniture_sql(f"coalesce({S.first_contained('upper(name)', K.FURNITURE_V1)},'GENERIC')"), _placed)
def furniture_list_v1(d: Drawings) -> DataFrame:
    return blocks.furniture_v1(blocks.blocks_in_rooms(d.block, room_table(d)))


_votes = f""",
votes AS (SELECT drawing_id,room_no,room,sum(sure) AS s,min(block_no) AS f FROM (SELECT *,{S.block_hint('name', 1)} AS room,{S.block_hint('name', 2)} AS sure FROM gathered) WHERE room<>'' GROUP BY ALL)"""
_gathered = ",\ngathered AS (SELECT drawing_id,(room_no+1)//2 AS room_no,block_no,name FROM placed)"


@query("block_votes", "SELECT drawing_id,room_no,arg_max(room,s*1000-f) AS block_room_hint,least(1.0,max(s)) AS block_confidence FROM votes GROUP BY ALL", _placed + _gathered + _votes)
def block_votes(d: Drawings) -> DataFrame:
    """Two neighbouring rooms count as one, so that votes add up and tie."""
    placed = blocks.blocks_in_rooms(d.block, room_table(d))
    return blocks.block_votes(placed.withColumn("room_no", F.floor((F.col("room_no") + 1) / 2)))


_assign = """,
cand AS (SELECT r.drawing_id,r.room_no,t.text_no,(x>x0 AND x<x1 AND y>y0 AND y<y1) AS ins,sqrt((x-(x0+x1)/2)*(x-(x0+x1)/2)+(y-(y0+y1)/2)*(y-(y0+y1)/2)) AS dist FROM fp_cell r JOIN fp_text t USING (drawing_id)),
near AS (SELECT * FROM cand WHERE ins OR dist<=5),
walk AS (SELECT DISTINCT drawing_id,CAST(0 AS BIGINT) AS room_no,CAST([] AS BIGINT[]) AS used,CAST(NULL AS BIGINT) AS pick FROM fp_cell
UNION ALL SELECT s.drawing_id,s.room_no+1,CASE WHEN s.nxt IS NULL THEN s.used ELSE list_append(s.used,s.nxt) END,s.nxt FROM (SELECT w.drawing_id,w.room_no,w.used,
arg_min(n.text_no,CASE WHEN n.ins THEN n.text_no*1e-9 ELSE 1+n.dist+n.text_no*1e-9 END) FILTER (WHERE n.text_no IS NOT NULL AND NOT list_contains(w.used,n.text_no)) AS nxt
FROM walk w JOIN fp_cell r ON r.drawing_id=w.drawing_id AND r.room_no=w.room_no+1 LEFT JOIN near n ON n.drawing_id=w.drawing_id AND n.room_no=w.room_no+1 GROUP BY w.drawing_id,w.room_no,w.used) s)"""


@query("text_room_assign", "SELECT w.drawing_id,w.room_no,w.pick AS text_no,t.text FROM walk w LEFT JOIN fp_text t ON t.drawing_id=w.drawing_id AND t.text_no=w.pick WHERE w.room_no>0", _assign)
def text_room_assign(d: Drawings) -> DataFrame:
    return texts.assign_texts(rooms.sized(room_table(d)), d.text)


_walls = ",\nbywall AS (SELECT a.drawing_id,a.room_no i,b.room_no j,a.y1 AS length FROM fp_cell a JOIN fp_cell b ON a.drawing_id=b.drawing_id AND b.room_no=a.room_no+1)"


@query("shared_wall_adjacency", "SELECT * FROM bywall", _walls)
def shared_wall_adjacency(d: Drawings) -> DataFrame:
    return adjacency.shared_walls(room_table(d))


_edges = _by_door + _walls + ",\nedges AS (SELECT drawing_id,i,j,'door' AS source,CAST(NULL AS DOUBLE) AS length FROM bydoor UNION ALL SELECT drawing_id,i,j,'shared_wall',length FROM bywall ANTI JOIN bydoor USING (drawing_id,i,j))"


def strip_adjacency(d: Drawings) -> DataFrame:
    table = room_table(d)
    by_door = doors.door_adjacency(doors.door_rooms(d.door.where("radius > 0"), table))
    return adjacency.adjacency(by_door, adjacency.shared_walls(table))


_edges_arc = _edges.replace("FROM fp_door) p", "FROM fp_door WHERE radius>0) p")


@query("adjacency_graph", "SELECT * FROM edges", _edges_arc)
def adjacency_graph(d: Drawings) -> DataFrame:
    return strip_adjacency(d)


@query("neighbor_names", "SELECT drawing_id,room_no,list(o ORDER BY dr DESC,o) AS neighbours,list(concat('Room ',o) ORDER BY dr DESC,o) AS adjacent FROM (SELECT drawing_id,i room_no,j o,source='door' dr FROM edges UNION ALL SELECT drawing_id,j,i,source='door' FROM edges) GROUP BY ALL", _edges_arc)
def neighbor_names(d: Drawings) -> DataFrame:
    return adjacency.neighbour_names(strip_adjacency(d), room_table(d))


# ---- fusion -------------------------------------------------------------------------------------------------------------

def _two_sides(d: Drawings) -> tuple[DataFrame, DataFrame]:
    ring = shapes.rectangle(*c("x0", "y0", "x1", "y1")).alias("ring")
    return d.cell.select("drawing_id", F.col("room_no").alias("no"), ring), d.raster.select("drawing_id", F.col("raster_no").alias("no"), ring)


_common = "(least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0))"
_iou = f""",
iou AS (SELECT a.drawing_id,a.room_no AS left_no,b.raster_no AS right_no,{_common}/greatest((a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0)-{_common},1e-12) AS iou
FROM fp_cell a JOIN fp_raster b USING (drawing_id) WHERE least(a.x1,b.x1)>greatest(a.x0,b.x0) AND least(a.y1,b.y1)>greatest(a.y0,b.y0))"""


@query("iou_matrix", "SELECT * FROM iou", _iou)
def iou_matrix(d: Drawings) -> DataFrame:
    return matching.overlaps(*_two_sides(d))


_greedy = _iou + """,
queue AS (SELECT *,row_number() OVER (PARTITION BY drawing_id ORDER BY iou DESC,left_no DESC,right_no DESC) AS k FROM iou WHERE iou>=0.25),
taken AS (SELECT DISTINCT drawing_id,CAST(0 AS BIGINT) AS k,CAST([] AS BIGINT[]) AS l,CAST([] AS BIGINT[]) AS r,FALSE AS hit FROM queue
UNION ALL SELECT t.drawing_id,q.k,CASE WHEN ok THEN list_append(l,left_no) ELSE l END,CASE WHEN ok THEN list_append(r,right_no) ELSE r END,ok
FROM (SELECT t.*,q.k AS qk,q.left_no,q.right_no,NOT list_contains(t.l,q.left_no) AND NOT list_contains(t.r,q.right_no) AS ok FROM taken t JOIN queue q ON q.drawing_id=t.drawing_id AND q.k=t.k+1) t, LATERAL (SELECT t.qk AS k) q),
matched AS (SELECT t.drawing_id,row_number() OVER (PARTITION BY t.drawing_id ORDER BY t.k) AS rank,left_no,right_no,iou FROM taken t JOIN queue q ON q.drawing_id=t.drawing_id AND q.k=t.k WHERE t.hit)"""


@query("greedy_match", "SELECT * FROM matched", _greedy)
def greedy_match(d: Drawings) -> DataFrame:
    return matching.greedy_matches(matching.overlaps(*_two_sides(d)))


_fused = _greedy + """,
fused AS (SELECT drawing_id,0 AS p,rank AS q,left_no AS vector_no,CAST(NULL AS BIGINT) AS raster_no,'vector' AS source,iou>=0.7 AS raster_confirmed,iou<0.7 AS raster_partial,iou AS iou_score FROM matched
UNION ALL SELECT drawing_id,1,room_no,room_no,NULL,'vector',FALSE,FALSE,NULL FROM fp_cell c WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.drawing_id=c.drawing_id AND m.left_no=c.room_no)
UNION ALL SELECT drawing_id,2,raster_no,NULL,raster_no,'raster',FALSE,FALSE,NULL FROM fp_raster f WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.drawing_id=f.drawing_id AND m.right_no=f.raster_no)
AND NOT EXISTS (SELECT 1 FROM iou i WHERE i.drawing_id=f.drawing_id AND i.right_no=f.raster_no AND i.iou>0.1))"""


@query("fuse_rooms", "SELECT drawing_id,row_number() OVER (PARTITION BY drawing_id ORDER BY p,q) AS position,vector_no,raster_no,source,raster_confirmed,raster_partial,iou_score FROM fused", _fused)
def fuse_rooms(d: Drawings) -> DataFrame:
    return matching.fuse(*_two_sides(d))


@query("match_statistics", "SELECT drawing_id,count_if(raster_confirmed) AS strong,count_if(raster_partial) AS partial,count_if(source='raster') AS extras FROM fused GROUP BY ALL", _fused)
def match_statistics(d: Drawings) -> DataFrame:
    return matching.match_statistics(matching.fuse(*_two_sides(d)))


# ---- classification -----------------------------------------------------------------------------------------------------

@query("geometry_score", f"SELECT drawing_id,area_sqft,aspect,compactness,{S.geometry(0)} AS label,{S.geometry(1)} AS confidence FROM fp_feature")
def geometry_score(d: Drawings) -> DataFrame:
    return d.feature.select("drawing_id", "area_sqft", "aspect", "compactness", scoring.geometry_score(*c("area_sqft", "aspect", "compactness")).alias("g")).select("drawing_id", "area_sqft", "aspect", "compactness", "g.*")


_types = "[" + ",".join(map(S.lit, K.ROOM_TYPES)) + "]"
_signal = f""",
sig AS (SELECT *,{S.geometry(0)} AS gl,{S.geometry(1)} AS gc,CASE WHEN l_suppkey%3=0 THEN '' ELSE {_types}[1+l_partkey%15] END AS bl,CASE WHEN l_suppkey%3=0 THEN 0.0 ELSE (l_partkey%7)/8.0::DOUBLE END AS bc,
{_types}[1+l_suppkey%15] AS n1,{_types}[1+(l_suppkey+l_partkey)%15] AS n2,CASE WHEN l_partkey%2=0 THEN '' ELSE {_types}[1+(l_partkey//2)%15] END AS vl,CASE WHEN l_partkey%2=0 THEN 0.0 ELSE (l_suppkey%5)/4.0::DOUBLE END AS vc FROM fp_feature),
cand AS (SELECT *,CASE WHEN bl<>'' THEN bl ELSE gl END AS cd FROM sig),
nears AS (SELECT *,{S.near_confidence('cd', ['n1', 'n2'])} AS nc FROM cand),
near2 AS (SELECT *,CASE WHEN nc>0 THEN cd ELSE '' END AS nl FROM nears)"""


def _signals(d: Drawings) -> DataFrame:
    types = F.array(*map(F.lit, K.ROOM_TYPES))

    def pick(k: Column) -> Column:
        return F.get(types, k.cast("int"))

    p, s = c("l_partkey", "l_suppkey")
    rows = d.feature.withColumns({
        "geo": scoring.geometry_score(*c("area_sqft", "aspect", "compactness")),
        "block": F.struct(F.when(s % 3 == 0, "").otherwise(pick(p % 15)).alias("label"), F.when(s % 3 == 0, 0.0).otherwise((p % 7) / 8.0).alias("confidence")),
        "names": F.array(pick(s % 15), pick((s + p) % 15)),
        "seen": F.struct(F.when(p % 2 == 0, "").otherwise(pick(F.floor(p / 2) % 15)).alias("label"), F.when(p % 2 == 0, 0.0).otherwise((s % 5) / 4.0).alias("confidence")),
    })
    candidate = F.when(F.col("block.label") != "", F.col("block.label")).otherwise(F.col("geo.label"))
    return rows.withColumn("near", scoring.neighbour_score(candidate, F.col("names")))


@query("adjacency_score", "SELECT drawing_id,l_partkey,l_suppkey,nl AS label,nc AS confidence FROM near2", _signal)
def adjacency_score(d: Drawings) -> DataFrame:
    return _signals(d).select("drawing_id", "l_partkey", "l_suppkey", "near.*")


_vote = S.vote([("gl", "gc"), ("bl", "bc"), ("nl", "nc"), ("vl", "vc")])
_method = "CASE WHEN vl<>'' AND vc>0 THEN 'vision+rules' WHEN bl<>'' AND bc>0 THEN 'rules+blocks' ELSE 'rules' END"


@query("weighted_vote", f"SELECT drawing_id,l_partkey,l_suppkey,{_vote[0]} AS label,{_vote[1]} AS confidence,{_method} AS method FROM near2", _signal)
def weighted_vote(d: Drawings) -> DataFrame:
    return _signals(d).select("drawing_id", "l_partkey", "l_suppkey", scoring.weighted_vote(*c("geo", "block", "near", "seen")).alias("v")).select("drawing_id", "l_partkey", "l_suppkey", "v.*")


@query("raster_boost", f"SELECT drawing_id,l_partkey,l_suppkey,CASE WHEN l_partkey%3=0 THEN least(1.0,{_vote[1]}+0.05::DOUBLE) ELSE {_vote[1]} END AS confidence,CASE WHEN l_partkey%3=0 AND {_method}='rules' THEN 'rules+raster' ELSE {_method} END AS method FROM near2", _signal)
def raster_boost(d: Drawings) -> DataFrame:
    vote = scoring.with_raster(scoring.weighted_vote(*c("geo", "block", "near", "seen")), F.col("l_partkey") % 3 == 0)
    return _signals(d).select("drawing_id", "l_partkey", "l_suppkey", vote.alias("v")).select("drawing_id", "l_partkey", "l_suppkey", "v.confidence", "v.method")


def strip_rooms(d: Drawings) -> DataFrame:
    """The strips' rooms with everything that classification takes."""
    table = rooms.sized(rooms.with_shape(room_table(d)))
    table = written(texts.named(table, texts.assign_texts(table, d.text)), "strip-named")
    placed = blocks.blocks_in_rooms(d.block, table)
    for more in (blocks.furniture(placed), blocks.block_votes(placed)):
        table = table.join(more, ["drawing_id", "room_no"], "left")
    return written(table, "strip-rooms")


_classified = _assign + _placed + f""",
own AS (SELECT drawing_id,room_no,block_no,{S.block_hint('name', 0)} AS kind,{S.block_hint('name', 1)} AS hint,{S.block_hint('name', 2)} AS sure FROM placed),
feat0 AS (SELECT c.drawing_id,c.room_no,c.area_raw*10.7639::DOUBLE AS area_sqft,greatest(c.x1-c.x0,c.y1)/least(c.x1-c.x0,c.y1) AS aspect,
least(1.0,{4 * math.pi!r}::DOUBLE*area_raw/((2*(x1-x0)+2*y1)*(2*(x1-x0)+2*y1))) AS compactness,t.text AS raw,coalesce(o.hint,'') AS bl,coalesce(o.sure,0.0) AS bc
FROM fp_cell c JOIN walk w ON w.drawing_id=c.drawing_id AND w.room_no=c.room_no LEFT JOIN fp_text t ON t.drawing_id=c.drawing_id AND t.text_no=w.pick LEFT JOIN own o ON o.drawing_id=c.drawing_id AND o.room_no=c.room_no),
feat AS (SELECT *,{S.room_label('raw')} AS named,{S.geometry(0)} AS gl,{S.geometry(1)} AS gc,lead(coalesce(raw,concat('Room ',room_no))) OVER (PARTITION BY drawing_id ORDER BY room_no) AS nextn FROM feat0),
told AS (SELECT *,CASE WHEN bl<>'' THEN bl ELSE gl END AS cd,'' AS vl,0.0::DOUBLE AS vc FROM feat),
steps AS (SELECT drawing_id,CAST(0 AS BIGINT) AS room_no,CAST(NULL AS VARCHAR) AS label,0.0::DOUBLE AS confidence,'' AS method FROM fp_cell GROUP BY ALL
UNION ALL SELECT drawing_id,room_no,CASE WHEN named IS NOT NULL THEN named ELSE {S.vote([("gl", "gc"), ("bl", "bc"), ("nl", "nc"), ("vl", "vc")])[0]} END,CASE WHEN named IS NOT NULL THEN 0.9::DOUBLE ELSE {S.vote([("gl", "gc"), ("bl", "bc"), ("nl", "nc"), ("vl", "vc")])[1]} END,
CASE WHEN named IS NOT NULL THEN 'cad_label' WHEN bl<>'' AND bc>0 THEN 'rules+blocks' ELSE 'rules' END
FROM (SELECT *,CASE WHEN nc>0 THEN cd ELSE '' END AS nl FROM (SELECT t.*,{S.near_confidence('t.cd', ['s.label', 't.nextn'])} AS nc FROM steps s JOIN told t ON t.drawing_id=s.drawing_id AND t.room_no=s.room_no+1)))"""


@query("classify_v2", "SELECT drawing_id,room_no,label,confidence,method FROM steps WHERE room_no>0", _classified)
def classify_v2(d: Drawings) -> DataFrame:
    table = strip_rooms(d)
    return classify.classify_rooms(table, adjacency.both_ways(adjacency.shared_walls(table)))


@query("needs_vision", "SELECT drawing_id,l_partkey,l_suppkey FROM fp_feature WHERE l_partkey%3<>0 AND compactness<0.75")
def needs_vision(d: Drawings) -> DataFrame:
    label = F.when(F.col("l_partkey") % 3 == 0, "Hall").otherwise("")
    return d.feature.where(scoring.needs_vision(label, F.col("compactness"))).select("drawing_id", "l_partkey", "l_suppkey")


@query("apply_vision", None)
def apply_vision(d: Drawings) -> DataFrame:
    """Rooms whose number is divisible by three are seen as halls and classified again on top of the first names."""
    table = strip_rooms(d)
    links = written(adjacency.both_ways(adjacency.shared_walls(table)), "strip-links")
    first = classify.classify_rooms(table, links)
    vision = table.where(F.col("room_no") % 3 == 0).select("drawing_id", "room_no", F.lit("Hall").alias("room_type"), F.lit(0.9).alias("confidence"))
    again = table.drop("name").join(first.select("drawing_id", "room_no", F.col("label").alias("name")), ["drawing_id", "room_no"])
    return classify.classify_rooms(again, links, vision, only_seen=True)


@query("classify_v1_geometry", f"SELECT drawing_id,area_sqft,aspect,door_count,{S.geometry_v1()} AS label FROM fp_feature")
def classify_v1_geometry(d: Drawings) -> DataFrame:
    return d.feature.select("drawing_id", "area_sqft", "aspect", "door_count", scoring.geometry_label_v1(*c("area_sqft", "aspect", "door_count")).alias("label"))


_v1 = f""",
ctx AS (SELECT *,['STOVE','BED','WC','SINK','SOFA','DINING','DESK','TREE'][1+l_suppkey%8] AS f1,{_types}[1+l_partkey%15] AS n1,CASE WHEN l_partkey%7=0 THEN 'Lobby 1' END AS txt,CASE WHEN l_partkey%5=0 THEN 'Balcony' END AS vis,(l_suppkey%11)/10.0::DOUBLE AS vconf FROM fp_feature),
rule AS (SELECT *,CASE WHEN f1='STOVE' THEN 'Kitchen' WHEN f1='BED' THEN 'Bedroom' WHEN f1 IN ('WC','SINK') THEN CASE WHEN area_sqft<60 THEN 'Toilet' ELSE 'Bathroom' END WHEN f1 IN ('SOFA','DINING') THEN CASE WHEN area_sqft>140 THEN 'Hall' ELSE 'Living Room' END
WHEN area_sqft<35 THEN 'Toilet' WHEN area_sqft>200 AND door_count>=2 AND aspect<3 THEN 'Hall' ELSE {S.geometry_v1()} END AS rl,
CASE WHEN f1='STOVE' THEN 0.93::DOUBLE WHEN f1='BED' THEN 0.92::DOUBLE WHEN f1 IN ('WC','SINK') THEN 0.91::DOUBLE WHEN f1 IN ('SOFA','DINING') THEN CASE WHEN area_sqft>140 THEN 0.83::DOUBLE ELSE 0.8::DOUBLE END WHEN area_sqft<35 THEN 0.76::DOUBLE WHEN area_sqft>200 AND door_count>=2 AND aspect<3 THEN 0.8::DOUBLE ELSE 0.62::DOUBLE END AS rc,
CASE WHEN f1 NOT IN ('DESK','TREE') THEN 'rules+furniture' WHEN area_sqft<35 OR (area_sqft>200 AND door_count>=2 AND aspect<3) THEN 'rules+area' ELSE 'rules' END AS rm FROM ctx),
near1 AS (SELECT *,CASE WHEN rl='Kitchen' AND n1='Hall' THEN least(0.95::DOUBLE,rc+0.03::DOUBLE) WHEN rl IN ('Toilet','Bathroom') AND n1 IN ('Bedroom','Hall') THEN least(0.93::DOUBLE,rc+0.03::DOUBLE) ELSE rc END AS ac FROM rule)"""


@query(
    "classify_v1_contextual",
    """SELECT drawing_id,l_partkey,l_suppkey,CASE WHEN txt IS NOT NULL THEN txt WHEN ac<0.75 AND vis IS NOT NULL AND vconf>=0.72 THEN vis ELSE rl END AS label,
CASE WHEN txt IS NOT NULL THEN 0.95::DOUBLE WHEN ac<0.75 AND vis IS NOT NULL AND vconf>=0.72 THEN least(0.9::DOUBLE,vconf) ELSE ac END AS confidence,
CASE WHEN txt IS NOT NULL THEN 'text' WHEN ac<0.75 AND vis IS NOT NULL AND vconf>=0.72 THEN 'vision-refine' ELSE rm END AS method,
CASE WHEN txt IS NOT NULL OR (ac<0.75 AND vis IS NOT NULL AND vconf>=0.72) THEN FALSE ELSE ac<0.75 END AS needs_ai FROM near1""",
    _v1,
)
def classify_v1_contextual(d: Drawings) -> DataFrame:
    p, s = c("l_partkey", "l_suppkey")
    kind = F.get(F.array(*map(F.lit, ("STOVE", "BED", "WC", "SINK", "SOFA", "DINING", "DESK", "TREE"))), (s % 8).cast("int"))
    near = F.get(F.array(*map(F.lit, K.ROOM_TYPES)), (p % 15).cast("int"))
    found = scoring.contextual_v1(*c("area_sqft", "aspect", "door_count"), F.array(kind), F.array(near), F.when(p % 7 == 0, "Lobby 1"), F.when(p % 5 == 0, "Balcony"), (s % 11) / 10.0)
    return d.feature.select("drawing_id", "l_partkey", "l_suppkey", found.alias("r")).select("drawing_id", "l_partkey", "l_suppkey", "r.*")


_multi = f",\nmulti AS (SELECT *,CASE WHEN l_partkey%4=0 THEN ' hall' WHEN l_partkey%4=1 THEN 'Bedroom' END AS txt,CASE WHEN l_suppkey%3=0 THEN 'HALL' WHEN l_suppkey%3=1 THEN 'bedroom' END AS vis,(l_suppkey%10)/10.0::DOUBLE AS vconf,CASE WHEN l_linenumber%4=0 THEN NULL ELSE {S.geometry_v1()} END AS geo FROM fp_feature)"
_same = "upper(trim({}))=upper(trim({}))"
_sigs = f""",
opts AS (SELECT *,CASE WHEN txt IS NULL THEN -1 WHEN {_same.format('vis', 'txt')} THEN 0.97::DOUBLE WHEN {_same.format('geo', 'txt')} THEN 0.95::DOUBLE ELSE 0.92::DOUBLE END AS tc,
CASE WHEN vis IS NULL THEN -1 WHEN {_same.format('geo', 'vis')} THEN least(0.92::DOUBLE,vconf+0.10::DOUBLE) ELSE vconf END AS vc,CASE WHEN geo IS NULL THEN -1 ELSE 0.60::DOUBLE END AS gc FROM multi)"""


@query(
    "classify_v1_multisignal",
    f"""SELECT drawing_id,l_partkey,l_suppkey,CASE WHEN greatest(tc,vc,gc)<0 THEN 'Unknown' WHEN tc>=vc AND tc>=gc THEN txt WHEN vc>=gc THEN vis ELSE geo END AS label,CASE WHEN greatest(tc,vc,gc)<0 THEN 0.5::DOUBLE ELSE greatest(tc,vc,gc) END AS confidence,
CASE WHEN greatest(tc,vc,gc)<0 THEN 'geometry' WHEN tc>=vc AND tc>=gc THEN CASE WHEN {_same.format('vis', 'txt')} THEN 'text+vision' WHEN {_same.format('geo', 'txt')} THEN 'text+geometry' ELSE 'text' END
WHEN vc>=gc THEN CASE WHEN {_same.format('geo', 'vis')} THEN 'vision+geometry' ELSE 'vision' END ELSE 'geometry' END AS method FROM opts""",
    _multi + _sigs,
)
def classify_v1_multisignal(d: Drawings) -> DataFrame:
    p, s = c("l_partkey", "l_suppkey")
    geo = F.when(F.col("l_linenumber") % 4 != 0, scoring.geometry_label_v1(*c("area_sqft", "aspect", "door_count")))
    found = scoring.multi_signal_v1(F.when(p % 4 == 0, " hall").when(p % 4 == 1, "Bedroom"), F.when(s % 3 == 0, "HALL").when(s % 3 == 1, "bedroom"), (s % 10) / 10.0, geo)
    return d.feature.select("drawing_id", "l_partkey", "l_suppkey", found.alias("r")).select("drawing_id", "l_partkey", "l_suppkey", "r.*")


@query("classify_v0", "SELECT drawing_id,area_sqft,aspect,CASE WHEN area_sqft>150 THEN 'Hall' WHEN area_sqft BETWEEN 60 AND 120 THEN 'Bedroom' WHEN area_sqft<40 THEN 'Toilet' WHEN aspect>5 THEN 'Corridor' ELSE 'Unknown' END AS label FROM fp_feature")
def classify_v0(d: Drawings) -> DataFrame:
    return d.feature.select("drawing_id", "area_sqft", "aspect", scoring.label_v0(*c("area_sqft", "aspect")).alias("label"))


# ---- recognised words and vision answers --------------------------------------------------------------------------------

_words = f",\nwords AS (SELECT drawing_id,room_no,o AS ord,{S.ocr_label('t')} AS label,conf FROM (SELECT drawing_id,room_no,unnest([1,2,3]) AS o,unnest([CASE WHEN l_partkey%3=0 THEN 'Bed Room' ELSE 'x' END,'Living 2',CASE WHEN l_suppkey%2=0 THEN 'dining room' ELSE 'WC' END]) AS t,unnest([0.9,CASE WHEN l_suppkey%4=0 THEN 0.2 ELSE 0.4 END,0.35]) AS conf FROM c))"


def _room_words(d: Drawings) -> DataFrame:
    base = d.strip
    p, s = c("l_partkey", "l_suppkey")
    word = lambda k, t, conf: F.struct(F.lit(k).alias("ord"), t.alias("text"), conf.alias("conf"))
    items = F.array(
        word(1, F.when(p % 3 == 0, "Bed Room").otherwise("x"), F.lit(0.9)), word(2, F.lit("Living 2"), F.when(s % 4 == 0, 0.2).otherwise(0.4)), word(3, F.when(s % 2 == 0, "dining room").otherwise("WC"), F.lit(0.35))
    )
    return base.select("drawing_id", "room_no", F.explode(items).alias("w")).select("drawing_id", "room_no", "w.*")


@query("ocr_room_words", "SELECT drawing_id,room_no,arg_max(label,length(label)*10-ord) AS label FROM words WHERE conf>=0.35 AND label IS NOT NULL GROUP BY ALL", _words)
def ocr_room_words(d: Drawings) -> DataFrame:
    return enrich.primary_words(_room_words(d))


_floor = f""",
unl AS (SELECT drawing_id,room_no,row_number() OVER (PARTITION BY drawing_id ORDER BY area_raw,room_no) AS k FROM fp_cell ANTI JOIN (SELECT drawing_id,text_no AS room_no FROM fp_text) USING (drawing_id,room_no)),
fw AS (SELECT drawing_id,label,row_number() OVER (PARTITION BY drawing_id ORDER BY block_no) AS k FROM (SELECT *,{S.ocr_label("CASE WHEN contains(name,'TREE') THEN 'passage 3' ELSE name END")} AS label FROM fp_block) WHERE label IS NOT NULL)"""


@query("ocr_floor_assign", "SELECT drawing_id,room_no,label FROM unl JOIN fw USING (drawing_id,k)", _floor)
def ocr_floor_assign(d: Drawings) -> DataFrame:
    words = d.block.select("drawing_id", F.col("block_no").alias("ord"), F.when(F.contains("name", F.lit("TREE")), "passage 3").otherwise(F.col("name")).alias("text"))
    labels = d.text.select("drawing_id", F.col("text_no").alias("room_no"), F.col("text").alias("original_label"))
    return enrich.floor_words(words, room_table(d).withColumn("area_sqft", F.col("area_raw")).join(labels, ["drawing_id", "room_no"], "left"))


@query("label_map_index", "SELECT c.drawing_id,c.room_no,t.text AS vision_label,CASE WHEN t.text IS NULL THEN NULL WHEN t.text_no%2=0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS vision_confidence,coalesce(t.text,concat('Room ',c.room_no)) AS name FROM fp_cell c LEFT JOIN fp_text t ON t.drawing_id=c.drawing_id AND t.text_no=c.room_no")
def label_map_index(d: Drawings) -> DataFrame:
    labels = d.text.select("drawing_id", F.col("text_no").alias("room_index"), F.col("text").alias("room_type"), F.when(F.col("text_no") % 2 == 1, 0.5).alias("confidence"))
    return enrich.labels_by_index(room_table(d), labels).select("drawing_id", "room_no", "vision_label", "vision_confidence", "name")


_places = list(K.GRID_PLACES) + ["elsewhere"]
_spot = "[" + ",".join(map(S.lit, _places)) + "][1+text_no%10]"
_grid = f""",
lab AS (SELECT drawing_id,text_no AS label_no,text AS room_type,{_spot} AS place FROM fp_text),
bx AS (SELECT drawing_id,min((x0+x1)/2) AS ax,max((x0+x1)/2) AS bx,min(y1/2) AS ay FROM fp_cell GROUP BY ALL),
spot AS (SELECT lab.*,ax+coalesce({S.exact('place', {k: v[0] for k, v in K.GRID_PLACES.items()})},0.5)*CASE WHEN bx=ax THEN 1.0 ELSE bx-ax END AS x,ay+coalesce({S.exact('place', {k: v[1] for k, v in K.GRID_PLACES.items()})},0.5)*1.0 AS y FROM lab JOIN bx USING (drawing_id))"""


@query("grid_points", "SELECT drawing_id,label_no,room_type,place AS approximate_location,x,y FROM spot", _grid)
def grid_points(d: Drawings) -> DataFrame:
    return enrich.grid_points(_grid_labels(d), _centres(d))


def _grid_labels(d: Drawings) -> DataFrame:
    return d.text.select("drawing_id", F.col("text_no").alias("label_no"), F.col("text").alias("room_type"), F.get(F.array(*map(F.lit, _places)), (F.col("text_no") % 10).cast("int")).alias("approximate_location"))


def _centres(d: Drawings) -> DataFrame:
    return d.cell.select("drawing_id", "room_no", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), (F.col("y1") / 2).alias("cy"))


@query("label_map_grid", None)
def label_map_grid(d: Drawings) -> DataFrame:
    return enrich.labels_by_grid(_grid_labels(d), _centres(d))




@query("vision_json_parse", f"SELECT drawing_id,l_partkey,l_suppkey,CASE WHEN l_partkey%16<15 THEN {_types}[1+l_partkey%16] END AS room_type,CASE WHEN l_partkey%16<15 THEN CASE WHEN l_suppkey%3=0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END END AS confidence FROM fp_feature")
def vision_json_parse(d: Drawings) -> DataFrame:
    p, s = c("l_partkey", "l_suppkey")
    kind = F.get(F.array(*map(F.lit, (*K.ROOM_TYPES, "Garage"))), (p % 16).cast("int"))
    said = F.concat(F.lit('Sure! ```json\n{"room_type": "'), kind, F.lit('", "confidence": '), F.when(s % 3 == 0, "0").otherwise("0.25"), F.lit("}\n``` done"))
    return d.feature.select("drawing_id", "l_partkey", "l_suppkey", answers.answer_object(said).alias("a")).select("drawing_id", "l_partkey", "l_suppkey", "a.room_type", "a.confidence")


@query("vision_json_list", "SELECT drawing_id,room_no AS room_index,'Hall' AS room_type,0.5::DOUBLE AS confidence FROM fp_cell")
def vision_json_list(d: Drawings) -> DataFrame:
    entry = F.format_string('{"room_index": %d, "room_type": "Hall", "confidence": 0.5}', "room_no")
    said = F.concat(F.lit("```json\n["), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("]\n```"))
    rows = d.cell.groupBy("drawing_id").agg(said.alias("said"))
    return rows.select("drawing_id", F.explode(answers.answer_list(F.col("said"))).alias("a")).select("drawing_id", F.col("a.room_index").cast("long").alias("room_index"), "a.room_type", "a.confidence")


@query("vision_index_mapping", "SELECT drawing_id,room_no,'Kitchen' AS room_type,0.5::DOUBLE AS confidence FROM (SELECT drawing_id,room_no,row_number() OVER (PARTITION BY drawing_id ORDER BY room_no) AS k FROM fp_cell WHERE room_no%2=1) WHERE k<=2")
def vision_index_mapping(d: Drawings) -> DataFrame:
    """Odd rooms are asked for; the answers 1 and 2 belong to the first two of them."""
    unsure = classify.ask_vision(d.cell.withColumns({"original_label": F.when(F.col("room_no") % 2 == 0, "x"), "confidence": F.lit(0.1)}))
    said = d.cell.select("drawing_id").distinct().select("drawing_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("room_index"), F.lit("Kitchen").alias("room_type"), F.lit(0.0).alias("confidence"))
    return enrich.map_answers(said, unsure)


@query("vision_question", "SELECT drawing_id,room_no,concat('  Room ',room_no,': area=',format('{:.0f}',area_raw+0.25),'sqft  furniture=none  adjacent=[Room 1, x]  current_guess=?') AS line FROM fp_cell")
def vision_question(d: Drawings) -> DataFrame:
    line = answers.room_line(F.col("room_no"), F.col("area_raw") + 0.25, F.array().cast("array<string>"), F.array(F.lit("Room 1"), F.lit("x")), F.lit(None).cast("string"))
    return d.cell.select("drawing_id", "room_no", line.alias("line"))


@query("quota_errors", "SELECT drawing_id,l_partkey,l_partkey%4 IN (0,2) AS quota FROM fp_feature")
def quota_errors(d: Drawings) -> DataFrame:
    message = F.get(F.array(*map(F.lit, ("HTTP 429 too many", "bad picture", "Quota exceeded", "timeout"))), (F.col("l_partkey") % 4).cast("int"))
    return d.feature.select("drawing_id", "l_partkey", text.is_quota_error(message).alias("quota"))


# ---- pictures -----------------------------------------------------------------------------------------------------------

@query("room_bounds", "SELECT drawing_id,min(least(sx,ex)) AS x0,min(least(sy,ey)) AS y0,max(greatest(sx,ex)) AS x1,max(greatest(sy,ey)) AS y1 FROM fp_segment GROUP BY ALL")
def room_bounds(d: Drawings) -> DataFrame:
    return segment_bounds(d.segment)


def segment_bounds(segments: DataFrame) -> DataFrame:
    return segments.groupBy("drawing_id").agg(F.min(F.least("sx", "ex")).alias("x0"), F.min(F.least("sy", "ey")).alias("y0"), F.max(F.greatest("sx", "ex")).alias("x1"), F.max(F.greatest("sy", "ey")).alias("y1"))


@query("snapshot_crop", "SELECT drawing_id,room_no,x0-greatest(0.5,(x1-x0)*0.25) AS x0,y0-greatest(0.5,(y1-y0)*0.25) AS y0,x1+greatest(0.5,(x1-x0)*0.25) AS x1,y1+greatest(0.5,(y1-y0)*0.25) AS y1 FROM fp_cell")
def snapshot_crop(d: Drawings) -> DataFrame:
    return d.cell.select("drawing_id", "room_no", drawing.crop(*c("x0", "y0", "x1", "y1")).alias("b")).select("drawing_id", "room_no", "b.*")


_pix = """,
frame AS (SELECT drawing_id,min(least(sx,ex)) AS x0,min(least(sy,ey)) AS y0,max(greatest(sx,ex))-min(least(sx,ex)) AS w,max(greatest(sy,ey))-min(least(sy,ey)) AS h FROM fp_segment GROUP BY ALL),
img AS (SELECT *,greatest(CAST(ceil(w*(1024.0::DOUBLE/greatest(w,h))) AS INTEGER),4) AS iw,greatest(CAST(ceil(h*(1024.0::DOUBLE/greatest(w,h))) AS INTEGER),4) AS ih FROM frame)"""


@query("pixel_transform", "SELECT drawing_id,iw AS w,ih AS h,greatest(0,least(iw-1,CAST(trunc((sx-x0)/w*(iw-1)) AS INTEGER))) AS px,greatest(0,least(ih-1,CAST(trunc(ih-1-(sy-y0)/h*(ih-1)) AS INTEGER))) AS py FROM fp_segment JOIN img USING (drawing_id)", _pix)
def pixel_transform(d: Drawings) -> DataFrame:
    frame = segment_bounds(d.segment).select("drawing_id", "x0", "y0", (F.col("x1") - F.col("x0")).alias("_w"), (F.col("y1") - F.col("y0")).alias("_h"))
    rows = d.segment.join(frame, "drawing_id").withColumn("i", drawing.image_size(*c("_w", "_h")))
    return rows.withColumn("p", drawing.to_pixel(*c("sx", "sy", "x0", "y0", "_w", "_h", "i.w", "i.h"))).select("drawing_id", "i.*", "p.*")


@query("palette", None)
def palette(d: Drawings) -> DataFrame:
    counts = d.cell.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"))
    return d.cell.join(counts, "drawing_id").select("drawing_id", "room_no", drawing.hex_colour(drawing.pastel(F.col("room_no") - 1, F.col("n"))).alias("colour"))


@query("svg_elements", """SELECT drawing_id,concat('<line x1="',format('{:.4f}',sx),'" y1="',format('{:.4f}',sy),'" x2="',format('{:.4f}',ex),'" y2="',format('{:.4f}',ey),'" data-layer="',layer,'"/>') AS element FROM fp_segment""")
def svg_elements(d: Drawings) -> DataFrame:
    return d.segment.select("drawing_id", drawing.svg_line(*c("sx", "sy", "ex", "ey", "layer")).alias("element"))


@query("svg_arc_path", "SELECT drawing_id,l_partkey,l_suppkey,CASE WHEN (CASE WHEN end_deg<=start_deg THEN end_deg+360 ELSE end_deg END)-start_deg>180 THEN 1 ELSE 0 END AS large,format('{:.4f}',radius) AS radius FROM fp_arc WHERE end_deg<>start_deg+180 AND end_deg<>start_deg-180")
def svg_arc_path(d: Drawings) -> DataFrame:
    """Arcs other than half circles; svg_arc_path_all has those too."""
    return _arc_paths(d.arc.where("abs(end_deg - start_deg) <> 180"))


@query("svg_arc_path_all", "SELECT drawing_id,l_partkey,l_suppkey,CASE WHEN (CASE WHEN end_deg<=start_deg THEN end_deg+360 ELSE end_deg END)-start_deg>180 THEN 1 ELSE 0 END AS large,format('{:.4f}',radius) AS radius FROM fp_arc")
def svg_arc_path_all(d: Drawings) -> DataFrame:
    return _arc_paths(d.arc)


def _arc_paths(arcs: DataFrame) -> DataFrame:
    path = drawing.svg_arc(F.lit(5.0), F.lit(7.0), *c("radius", "start_deg", "end_deg"))
    rows = arcs.withColumn("p", F.split(path, " "))
    return rows.select("drawing_id", "l_partkey", "l_suppkey", F.get("p", F.lit(7)).cast("int").alias("large"), F.get("p", F.lit(4)).alias("radius"))


# ---- reports ------------------------------------------------------------------------------------------------------------

_scored = """,
pred AS (SELECT DISTINCT drawing_id,regexp_replace(lower(trim(text)),'\\s+',' ','g') AS label FROM fp_text),
want AS (SELECT drawing_id,unnest(['living hall','kitchenette','w.c.']) AS label FROM ext),
prec AS (SELECT p.drawing_id,count(w.label)/count(*)::DOUBLE AS precision FROM pred p LEFT JOIN want w USING (drawing_id,label) GROUP BY ALL)"""


def _expected(d: Drawings) -> DataFrame:
    return d.cell.select("drawing_id").distinct().select("drawing_id", F.explode(F.array(*map(F.lit, ("Living  Hall", "kitchenette", "W.C.")))).alias("label"))


@query("precision_metric", "SELECT * FROM prec", _scored)
def precision_metric(d: Drawings) -> DataFrame:
    return reports.precision(d.text.select("drawing_id", F.col("text").alias("label")), _expected(d))


@query("unknown_labels", f"SELECT DISTINCT label FROM pred WHERE label NOT IN ({','.join(S.lit(t.lower()) for t in K.ROOM_TYPES)})", _scored)
def unknown_labels(d: Drawings) -> DataFrame:
    return reports.unknown_labels(d.text.select(F.col("text").alias("label")))


_bench = ",\nbench AS (SELECT drawing_id,count(*) AS segments,count(*)*0.25::DOUBLE AS total_sec FROM fp_segment GROUP BY ALL)"


def benchmark_summary(runs: DataFrame, target: float = 3.0) -> DataFrame:
    """Files, average of total_sec, share of runs under the target."""
    return runs.agg(F.count(F.lit(1)).alias("files"), F.avg("total_sec").alias("average_total_sec"), F.avg((F.col("total_sec") < target).cast("double")).alias("share_under_target"))


@query("benchmark_report", "SELECT count(*) AS files,avg(total_sec) AS average_total_sec,avg(CASE WHEN total_sec<3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_under_target FROM bench", _bench)
def benchmark_report(d: Drawings) -> DataFrame:
    return benchmark_summary(d.segment.groupBy("drawing_id").agg((F.count(F.lit(1)) * 0.25).alias("total_sec")))


@query("largest_drawings", "SELECT drawing_id,segments FROM bench ORDER BY segments DESC,drawing_id LIMIT 5", _bench)
def largest_drawings(d: Drawings) -> DataFrame:
    """The five largest, a top-k report."""
    return d.segment.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("segments")).orderBy(F.desc("segments"), "drawing_id").limit(5)


@query("room_name_summary", "SELECT drawing_id,count(*) AS rooms,list(concat('Room ',room_no) ORDER BY room_no)[1:8] AS first_names FROM fp_cell GROUP BY ALL")
def room_name_summary(d: Drawings) -> DataFrame:
    named = F.array_sort(F.collect_list(F.struct("room_no", "name")))
    return room_table(d).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("rooms"), F.slice(F.transform(named, lambda r: r["name"]), 1, 8).alias("first_names"))


from . import more, whole  # noqa: E402, F401  register the queries of whole engines, sources, sinks, and of single rules
