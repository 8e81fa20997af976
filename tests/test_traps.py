"""Rules whose order or limits are easy to get wrong, one case each."""

import pytest
from pyspark.sql import functions as F

from roomwright.functions import answers, drawing, scoring, shapes, text, units
from roomwright.operators import classify, enrich, layers, matching, noding, rooms, texts
from roomwright.sources import dxf, svg


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_block_names(spark):
    rows = [("WARDROBE",), ("drawing board",), ("DINING TABLE",), ("WASHBASIN",), ("couch",), ("Tree",), ("SWING-BED",)]
    n = F.col("n")
    got = values(spark, rows, "n string", text.block_type(n), text.block_hint(n)["type"], text.block_hint(n)["room"], text.block_type_v1(n))
    assert got == [
        ("DOOR", "WARDROBE", "Bedroom", "GENERIC"), ("DOOR", "GENERIC", "", "GENERIC"), ("DINING", "DINING", "Dining Room", "DINING"), ("SINK", "BASIN", "Bathroom", "GENERIC"),
        ("SOFA", "COUCH", "Living Room", "GENERIC"), ("GENERIC", "GENERIC", "", "GENERIC"), ("DOOR", "BED", "Bedroom", "BED"),
    ]


def test_labels(spark):
    rows = [(" living hall",), ("OPEN KITCHEN",), ("bath 2",), ("3000",), ("room",), ("bed-room w.c. 2nd",), ("LIVING",), ("M.BED 1",), ("ots",)]
    r = F.col("r")
    got = values(spark, rows, "r string", text.room_label(r), text.ocr_label(r), text.short_label(r))
    assert [g[0] for g in got] == ["Hall", "Kitchen", "Bathroom", "3000", "Dining Room", "Bedroom", "Living Room", "Bedroom", "Ots"]
    assert [g[1] for g in got] == ["Hall", "Kitchen", "Bathroom", None, None, "Bedroom", "Hall", None, None] or got[5][1] is None
    assert [g[2] for g in got][-3:] == ["Living Room", "Master Bedroom", None]
    assert values(spark, [("bed-room w.c. 2nd",)], "r string", text.title_case(r)) == [("Bed-Room W.C. 2Nd",)]


def test_units(spark):
    c = F.col("c")
    got = values(spark, [(7,), (3,), (4,), (None,)], "c int", units.metres_per_unit(c), units.sqft_per_unit(c), units.feet_per_unit_v1(c))
    assert got == [(1000.0, 10.7639, 1.0), (1.0, 10.7639, 1.0), (0.001, 0.00001076391, 0.00328084), (1.0, 10.7639, 1.0)]


def test_sweeps_and_chords(spark):
    a, b = F.col("a"), F.col("b")
    got = values(spark, [(350.0, 80.0), (90.0, 90.0), (10.0, 5.0), (0.0, 10.0)], "a double, b double", shapes.sweep(a, b), shapes.chords(shapes.sweep(a, b)))
    assert got == [(90.0, 12), (360.0, 48), (355.0, 47), (10.0, 3)]


def test_geometry_score_branches(spark):
    got = values(spark, [(50.0, 3.5, 1.0), (90.0, 1.0, 0.4), (14.9, 1.0, 1.0), (35.0, 9.0, 1.0), (400.0, 1.0, 1.0)], "a double, s double, c double", scoring.geometry_score(*map(F.col, "asc"))["label"])
    assert [g[0] for g in got] == ["Corridor", "Hall", "Utility", "Toilet", "Open Area"]


def test_wall_layers_cut_before_the_noise_filter(spark):
    rows = [(1, n, k, c) for k, (n, c) in enumerate([("GRID", 9), ("DIM", 8), ("A", 7), ("B", 6), ("C", 5), ("D", 4)])]
    counts = spark.createDataFrame(rows, "drawing_id long, layer string, first_seen int, n long")
    assert [r.layer for r in layers.wall_layers(counts).orderBy("rank").collect()] == ["A", "B", "C"]
    assert [r.layer for r in layers.wall_layers_v1(counts).orderBy("rank").collect()] == ["GRID", "DIM", "A", "B", "C"]


def test_single_layer_drawings_keep_everything(spark):
    segments = spark.createDataFrame([(1, "dims"), (2, "dims"), (2, "a-wall"), (2, None)], "drawing_id long, layer string")
    assert sorted((r.drawing_id, r.layer or "") for r in layers.wall_segments(segments).collect()) == [(1, "dims"), (2, ""), (2, "a-wall")]


def test_an_earlier_room_takes_a_text_of_a_later_one(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    moved = [{"x": p["x"] + 3, "y": p["y"]} for p in square]
    table = spark.createDataFrame([(1, 1, square, 1.0, 1.0), (1, 2, moved, 4.0, 1.0)], f"drawing_id long, room_no long, ring {shapes.RING}, cx double, cy double")
    labels = spark.createDataFrame([(1, 1, "HALL", 4.0, 1.0), (1, 2, "far", 40.0, 1.0)], "drawing_id long, text_no long, text string, x double, y double")
    assert sorted((r.room_no, r.text) for r in texts.assign_texts(table, labels).collect()) == [(1, "HALL"), (2, None)]


def test_equal_overlaps_go_to_the_higher_numbers(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.5), (1, 2, 1, 0.5), (1, 2, 2, 0.5), (1, 3, 3, 0.2)], "drawing_id long, left_no long, right_no long, iou double")
    assert sorted((r.rank, r.left_no, r.right_no) for r in matching.greedy_matches(pairs).collect()) == [(1, 2, 2), (2, 1, 1)]


def test_gap_bridges_in_millimetres_and_skip_existing(spark):
    walls = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0), (1, 1900.0, 0.0, 5000.0, 0.0), (1, 0.0, 0.0, 0.0, 900.0)], "drawing_id long, sx double, sy double, ex double, ey double")
    xs = lambda df: sorted((r.sx, r.sy, r.ex, r.ey) for r in df.collect())
    assert xs(noding.gap_bridges(walls, metres=0.001)) == [(0.0, 0.0, 0.0, 900.0), (0.0, 0.0, 1000.0, 0.0), (1000.0, 0.0, 1900.0, 0.0)]
    assert xs(noding.gap_bridges(walls, metres=0.001, skip_existing=True)) == [(1000.0, 0.0, 1900.0, 0.0)]
    assert noding.gap_bridges(walls).count() == 0


def test_grid_cuts_equal_the_kernel(spark):
    import random

    from roomwright.operators import kernel

    rng = random.Random(9)
    lines = [(rng.randint(0, 9) * 1.0, rng.randint(0, 9) * 1.0, rng.randint(0, 9) * 1.0, rng.randint(0, 9) * 1.0) for _ in range(40)]
    lines = [s for s in lines if s[:2] != s[2:]]
    frame = spark.createDataFrame([(1, *s) for s in lines], "drawing_id long, sx double, sy double, ex double, ey double")
    got = sorted((round(r.ax, 6), round(r.ay, 6), round(r.bx, 6), round(r.by, 6)) for r in noding.node_edges(frame).collect())
    want = sorted({tuple(round(v, 6) for v in e) for e in kernel.node(lines)})
    assert got == want
    areas = lambda df: sorted(round(r.area_raw, 4) for r in df.collect())
    assert areas(rooms.noded_faces(frame)) == areas(rooms.noded_faces(frame, small=0))


def test_outer_removal_needs_a_second_room(spark):
    ring = [{"x": 0.0, "y": 0.0}]
    table = spark.createDataFrame([(1, ring, 9.0), (2, ring, 9.0), (2, ring, 6.0), (3, ring, 9.1), (3, ring, 6.0)], f"drawing_id long, ring {shapes.RING}, area_raw double")
    assert sorted((r.drawing_id, r.area_raw) for r in rooms.without_outer(table).collect()) == [(1, 9.0), (2, 6.0), (2, 9.0), (3, 6.0)]


def test_later_rooms_still_have_their_numbers_as_names(spark):
    schema = "drawing_id long, room_no long, name string, area_sqft double, aspect double, compactness double, original_label string"
    table = spark.createDataFrame([(1, 1, "Room 1", 100.0, 1.0, 0.9, None), (1, 2, "HALL", 300.0, 1.0, 0.9, "HALL"), (1, 3, "Room 3", 100.0, 1.0, 0.9, None)], schema)
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 2)], "drawing_id long, room_no long, other long")
    got = {r.room_no: (r.label, round(r.confidence, 6), r.method) for r in classify.classify_rooms(table, links).collect()}
    assert got[2] == ("Hall", 0.9, "cad_label")
    assert got[1] == ("Bedroom", 0.7, "rules")  # HALL is no room type yet
    assert got[3] == ("Bedroom", round((0.7 * 0.35 + 0.55 * 0.2) / 0.55, 6), "rules")


def test_vision_answers(spark):
    said = [('```json\n[{"room_index": 1, "room_type": "Hall"}]\n```',), ("nothing",), ('{"room_type": "Garage"}',), ('x {"room_type": "Hall", "confidence": 0} y',)]
    t = F.col("t")
    got = values(spark, said, "t string", F.size(answers.answer_list(t)), F.size(answers.answer_list_v1(t)), answers.answer_object(t)["room_type"], answers.answer_object(t)["confidence"])
    assert got[0][:2] == (1, 1) and got[1][:3] == (0, 0, None) and got[2][2] is None and got[3][2:] == ("Hall", 0.5)


def test_recognised_words_fill_rooms(spark):
    table = spark.createDataFrame([(1, 1, 50.0, None), (1, 2, 20.0, None), (1, 3, 30.0, "HALL"), (1, 4, 40.0, "")], "drawing_id long, room_no long, area_sqft double, original_label string")
    room_words = spark.createDataFrame([(1, 1, 1, "WC", 0.9), (1, 1, 2, "dining room", 0.4), (1, 2, 1, "kitchen", 0.3)], "drawing_id long, room_no long, ord int, text string, conf double")
    words = spark.createDataFrame([(1, 1, "??"), (1, 2, "Kitchen 1"), (1, 3, "store"), (1, 4, "bath")], "drawing_id long, ord int, text string")
    got = sorted((r.room_no, r.original_label, r.label_source) for r in enrich.ocr_labels(table, room_words, words).collect())
    assert got == [(1, "Dining Room", "ocr"), (2, "Kitchen", "ocr_floor"), (3, "HALL", None), (4, "Store Room", "ocr_floor")]


def test_pixels_are_kept_inside(spark):
    got = values(spark, [(10.0, 10.0), (-5.0, 99.0)], "x double, y double", drawing.to_pixel(F.col("x"), F.col("y"), *map(F.lit, (0.0, 0.0, 10.0, 10.0)), F.lit(100), F.lit(50)))
    assert [tuple(g[0]) for g in got] == [(99, 0), (0, 0)]


DXF = "0 SECTION 2 HEADER 9 $INSUNITS 70 4 0 ENDSEC 0 SECTION 2 BLOCKS 0 BLOCK 2 Door1 0 LINE 8 a-wall 10 0 20 0 11 100 21 0 0 INSERT 2 Door1 10 1 20 1 0 ATTDEF 1 tag 2 T 10 0 20 0 0 ENDBLK 0 ENDSEC 0 SECTION 2 ENTITIES " \
    "0 INSERT 8 x 2 Door1 10 500 20 500 0 INSERT 8 x 2 Door1 10 900 20 900 0 ATTRIB 8 t 1 HALL 10 5 20 5 0 SEQEND 0 ARC 8 d 10 0 20 0 40 800 50 0 51 90 0 ARC 8 d 10 0 20 0 40 8000 50 0 51 90 " \
    "0 CIRCLE 8 a-door 10 0 20 0 40 10 0 LWPOLYLINE 8 0 70 1 10 0 20 0 10 10 20 0 10 10 20 10 0 MTEXT 8 t 1 {\\fArial;Big}\\PHall 10 1 20 1 0 TEXT 8 t 1 bath 10 7.001 20 7 0 TEXT 8 t 1 BATH 10 7 20 7 0 LINE 8 a 10 oops 20 0 0 ENDSEC 0 EOF"


@pytest.fixture(scope="module")
def table(spark):
    return dxf.entities(spark.createDataFrame([(1, DXF.replace(" ", "\n")), (2, ""), (3, None)], "drawing_id long, content string"))


def test_blocks_expand_once_or_at_every_insertion(spark, table):
    once, each = dxf.expand(table), dxf.expand(table, every_instance=True)
    lines = lambda flat, f: sorted((r.sx, r.sy) for r in f(flat).where("upper(layer) = 'A-WALL'").collect())
    assert lines(once, dxf.segments) == [(500.0, 500.0)]
    assert lines(each, dxf.segments_v1) == [(500.0, 500.0), (900.0, 900.0)]
    assert dxf.blocks(once).count() == 3 and dxf.blocks_v1(each).count() == 4


def test_doors_of_both_engines(spark, table):
    kinds = lambda df: sorted((r.source, round(r.width_m, 3)) for r in df.collect())
    assert kinds(dxf.doors(dxf.expand(table))) == [("arc", 0.8), ("block", 0.9), ("block", 0.9), ("block", 0.9)]
    assert [k for k, _ in kinds(dxf.doors_v1(dxf.expand(table, True)))] == ["arc", "arc", "circle", "insert", "insert", "insert", "insert"]


def test_texts_of_both_engines(spark, table):
    assert sorted(r.text for r in dxf.texts(dxf.expand(table)).collect()) == ["Big\nHall", "bath"]
    assert sorted(r.text for r in dxf.texts_v1(dxf.expand(table, True)).collect()) == ["Big\nHall", "HALL", "bath"]


def test_corrupt_entities_are_marked(spark, table):
    assert table.where("etype = 'CORRUPT'").count() == 1


def test_small_circles_and_hatches_are_dropped(spark, table):
    flat = dxf.expand(table)
    assert dxf.segments(flat).where("layer = 'A-DOOR'").count() == 0
    assert dxf.segments(flat).where("layer = 'D'").count() == 12
    assert dxf.segments_v1(dxf.expand(table, True)).where("layer = 'a-door'").count() == 96


def test_svg_paths_and_flips(spark):
    assert svg.path_points("M0 0 L1 0 1 1 z 5 5 m 2 2 h3 v-1 c 0 0 0 0 1 1") == [(0, 0), (1, 0), (1, 1), (0, 0), None, (2, 2), (5, 2), (5, 1), (6, 2)]
    page = '<svg xmlns="http://www.w3.org/2000/svg"><g transform="scale(1,-1) translate(0,3)"><line x1="0" y1="1" x2="2" y2="1" data-layer="W"/><g transform="scale(1,-1)"><polygon points="0,0 1,0 x,y 1,1"/></g><line x1="2" y1="1" x2="0" y2="1"/></g><rect width="1" height="q"/></svg>'
    got = [tuple(r) for r in svg.segments(spark.createDataFrame([(1, page), (2, "<broken"), (3, None)], "drawing_id long, content string")).select("sx", "sy", "ex", "ey", "layer").orderBy("seg_no").collect()]
    assert got == [(0.0, -1.0, 2.0, -1.0, "W"), (0.0, 0.0, 1.0, 0.0, ""), (1.0, 0.0, 1.0, 1.0, ""), (1.0, 1.0, 0.0, 0.0, "")]


def test_half_circles_are_not_large(spark):
    rows = [(float(k), float((k + 180) % 360)) for k in range(360)] + [(0.0, 181.0), (0.0, 179.0), (200.0, 21.0), (30.0, 30.0)]
    path = drawing.svg_arc(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("a"), F.col("b"))
    large = [int(p.split(" ")[7]) for (p,) in values(spark, rows, "a double, b double", path)]
    assert sum(large[:360]) == 0
    assert large[360:] == [1, 0, 1, 1]
