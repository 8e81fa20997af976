"""The fold of whole floors against the joins that it stands for, on drawings with odd outlines, texts, doors and blocks."""

import os

import pytest
from pyspark.sql import functions as F

from roomwright.functions import shapes, text
from roomwright.operators import adjacency, blocks, classify, doors, floors, rooms, texts
from roomwright.plans import catalog, engine

SF = "/root/testdata/sf0.001"
OUTLINES = [
    (1, 1, [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]), (1, 2, [(2, 2), (4, 2), (4, 4), (2, 4)]), (1, 3, [(4, 0), (9, 0), (9, 4), (4, 4)]), (2, 1, [(0, 0), (30, 0), (30, 2), (0, 2)]),
    (2, 2, [(0, 2), (10, 2), (15, 9), (0, 9)]), (3, 1, [(0, 0), (1, 0), (1, 1), (0, 1)]), (4, 1, [(0, 0), (9, 0), (9, 9), (0, 9)]), (4, 2, [(3, 3), (6, 3), (6, 6), (3, 6)]),
]
TEXTS = [(1, 1, "bath 2", 1.0, 3.0), (1, 2, None, 3.0, 3.0), (1, 3, "  ", 3.0, 3.0), (1, 4, "bed-room 2nd", 3.0, 1.0), (2, 1, "3000", 5.0, 5.0), (2, 2, "lift-lobby", 2.0, 1.0), (9, 1, "lost", 0.0, 0.0), (4, 1, "Hall", 20.0, 4.5)]
DOORS = [(1, 1, 2.0, 3.0, None), (1, 2, 4.0, 3.0, 1.0), (2, 1, 20.0, 2.0, 0.9), (2, 2, 13.5, 6.0, 0.0), (4, 1, 4.5, 4.5, 0.1), (9, 1, 0.0, 0.0, 1.0)]
BLOCKS = [(1, 1, "WC-01", 3.0, 1.0), (1, 2, "laundry", 1.0, 1.0), (1, 3, "SOFA couch", 3.0, 3.0), (1, 4, "bed", 3.0, 3.0), (1, 5, None, 8.0, 1.0), (2, 1, "SINK", 2.0, 3.0), (2, 2, "basin", 2.0, 4.0), (2, 3, "TUB", 12.0, 8.5), (4, 1, "table", 4.0, 4.0), (4, 2, "TREE", 1.0, 1.0), (3, 1, "BED", 1.0, 0.5)]


@pytest.fixture(scope="module")
def parts(spark):
    table = spark.createDataFrame([(d, k, [{"x": float(x), "y": float(y)} for x, y in ring]) for d, k, ring in OUTLINES], f"drawing_id long, room_no long, ring {shapes.RING}")
    table = table.withColumns({"area_raw": shapes.area(F.col("ring")), "name": F.concat(F.lit("Room "), F.col("room_no").cast("string"))})
    return (
        table, spark.createDataFrame(TEXTS, "drawing_id long, text_no long, text string, x double, y double"),
        spark.createDataFrame(DOORS, "drawing_id long, door_no long, cx double, cy double, radius double"), spark.createDataFrame(BLOCKS, "drawing_id long, block_no long, name string, x double, y double"),
    )


def joined(table, labels, swings, things):
    table = rooms.sized(rooms.with_shape(table))
    links = doors.door_rooms(swings, table)
    placed = blocks.blocks_in_rooms(things, table)
    for more in (doors.door_counts(links, table), blocks.furniture(placed), blocks.block_votes(placed)):
        table = table.join(more, ["drawing_id", "room_no"], "left")
    table = texts.named(table, texts.assign_texts(table, labels.where("text is not null")))
    edges = adjacency.adjacency(doors.door_adjacency(links), adjacency.shared_walls(table))
    found = classify.classify_rooms(table, adjacency.both_ways(edges)).withColumnRenamed("label", "name")
    names = adjacency.neighbour_names(edges, table)
    return table.drop("name").join(found, ["drawing_id", "room_no"]).join(names, ["drawing_id", "room_no"], "left"), links, edges


def plain(rows):
    def of(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else tuple(map(of, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(map(of, r)) for r in rows), key=repr)


def test_the_fold_equals_the_joins(parts):
    table, links, edges = joined(*parts)
    found = floors.floors(*parts)
    columns = ["drawing_id", *[f.split(" ")[0] for f in floors.ROOM.split(", ")]]
    assert plain(floors.room_rows(found).select(*columns).collect()) == plain(table.select(*columns).collect())
    assert plain(found.select("drawing_id", F.inline("links")).collect()) == plain(links.where("drawing_id < 9").collect())
    assert plain(found.select("drawing_id", F.inline("edges")).collect()) == plain(edges.select("drawing_id", "i", "j", "source", "length").collect())


def test_labels_of_distinct_texts_equal_the_column_functions(spark):
    raw = [" living hall", "OPEN KITCHEN", "bath 2", "3000", "room", "bed-room w.c. 2nd", "LIVING", "M.BED 1", "ots", "o'neil x2y", "a_b", "", "Bed", "éléonore z", "corridor", "store/pantry"]
    rows = spark.createDataFrame([(v,) for v in raw], "r string").select("r", text.room_label(F.col("r")), text.block_hint(F.col("r"))).collect()
    assert [(floors.room_label(r[0]), floors.block_hint(r[0])) for r in rows] == [(r[1], tuple(r[2])) for r in rows]


def test_the_flagship_writes_nothing_and_deals_rows_only_once(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    plan = catalog.QUERIES["floor_payload"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert set(os.listdir(folder)) == before
    dealt = [line for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
    assert dealt and all("REPARTITION_BY_COL" in line for line in dealt)


@pytest.fixture(scope="module")
def drawn(spark, parts):
    lines = [(0, 0, 8, 0), (8, 0, 8, 6), (8, 6, 0, 6), (0, 6, 0, 0), (4, 0, 4, 2.5), (4, 3.5, 4, 6), (0, 3, 4, 2.9), (6, 6, 6, 5)]
    nested = [(0, 0, 20, 0), (20, 0, 20, 9), (20, 9, 0, 9), (0, 9, 0, 0), (10, 0, 10, 9), (2, 2, 6, 2), (6, 2, 4, 6), (4, 6, 2, 2), (10, 4, 20, 4)]
    rows = [(1, "a-wall", *v) for v in lines] + [(2, "0", *v) for v in nested] + [(2, "DIM", 0, 0, 10, 9)] + [(3, "a-dims", 0, 0, 1, 1), (3, None, 0, 0, 5, 5)] + [(4, "STRUCTURE x", *v) for v in lines[:4]] + [(4, "GRID", 0, 1, 8, 1), (4, "my CORE", 3, 0, 3, 6)]
    segments = spark.createDataFrame([(d, layer, *map(float, v)) for d, layer, *v in rows], "drawing_id long, layer string, sx double, sy double, ex double, ey double")
    _, labels, swings, things = parts
    extra = {"source": F.lit("arc"), "layer": F.lit("D"), "width_m": F.when(F.col("door_no") == 1, 0.8)}
    return engine.Drawing(segments, labels.where("text is not null"), swings.withColumns(extra), things)


def test_the_engine_as_a_fold_equals_the_joins(drawn):
    columns = ["drawing_id", "room_no", "area_raw", "ring", "name", "confidence", "method", "door_count", "furniture", "adjacent"]
    want, got = (run["rooms"].select(*columns).collect() for run in (engine._by_joins(drawn, 8.0, False), engine._by_floors(drawn, 8.0)))
    assert len(want) > 5
    assert plain(got) == plain(want)
