"""Reading some types of a file's entities gives the rows that reading all gives; a strip's segments come from one pass."""

from roomwright.operators import blocks
from roomwright.plans.fixtures import BODIES, ROOMS, Drawings
from roomwright.sources import dxf

FILE = "\n".join(
    ["0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", "B", "0", "LINE", "8", "L", "10", "0", "20", "0", "11", "1", "21", "1", "0", "INSERT", "2", "C", "10", "1", "20", "1", "0", "ENDBLK"]
    + ["0", "BLOCK", "2", "C", "0", "CIRCLE", "10", "1", "20", "1", "40", "2", "0", "ENDBLK", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    + ["0", "POLYLINE", "0", "VERTEX", "10", "1", "20", "2", "0", "SEQEND", "0", "LINE", "10", "x", "0", "ATTRIB", "1", "own", "10", "1", "20", "1", "0", "CIRCLE", "10", "3", "20", "1", "40", "2"]
    + ["0", "INSERT", "2", "B", "10", "5", "20", "5", "0", "ATTRIB", "1", "t", "10", "4", "20", "4", "0", "SEQEND", "0", "INSERT", "2", "B", "10", "7", "20", "5", "0", "TEXT", "1", "a", "10", "0", "20", "0"]
    + ["0", "INSERT", "2", "B", "10", "7", "20", "5", "0", "LINE", "0", "ATTRIB", "1", "late", "10", "1", "20", "1", "0", "CIRCLE", "10", "q", "0", "ENDSEC", "0", "EOF", ""]
)


def test_some_types_equal_all_of_them(spark):
    files = spark.createDataFrame([(1, FILE), (2, FILE.split("0\nENDSEC\n", 1)[1]), (3, ""), (4, None)], "drawing_id long, content string")
    for kinds in (dxf.TEXTS_V1, dxf.BLOCKS_V1, ("CIRCLE",), ("LINE", "POLYLINE")):
        every = dxf.entities(files).where(dxf.F.col("etype").isin(*kinds))
        assert sorted(map(repr, dxf.entities(files, kinds).collect())) == sorted(map(repr, every.collect()))
    for v1, kinds in ((dxf.texts_v1, dxf.TEXTS_V1), (dxf.blocks_v1, dxf.BLOCKS_V1)):
        some, every = (v1(dxf.expand(dxf.entities(files, k), every_instance=True)).collect() for k in (kinds, None))
        assert sorted(map(repr, some)) == sorted(map(repr, every)) and some


def test_segments_in_one_pass(spark):
    d = Drawings(spark, "/root/testdata/sf0.001")
    union = spark.sql(f"WITH {ROOMS} {BODIES['segment']}".replace("FROM lineitem", "FROM {lineitem}"), lineitem=d.lineitem)
    assert d.segment.schema.names == union.schema.names
    assert d.segment.exceptAll(union).count() == union.exceptAll(d.segment).count() == 0
    assert d.segment._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_files_are_parsed_once(spark):
    files = spark.createDataFrame([(1, FILE)], "drawing_id long, content string")
    flat = dxf.expand(dxf.entities(files), every_instance=True)
    rooms = spark.createDataFrame([(1, 1, [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}, {"x": 0.0, "y": 9.0}])], "drawing_id long, room_no long, ring array<struct<x:double,y:double>>")
    placed = blocks.blocks_in_rooms(dxf.blocks_v1(flat), rooms)
    for table in (placed, dxf.texts_v1(flat)):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.name, r.room_no) for r in placed.collect()} == {("B", 1), ("C", 1)}
    texts = sorted((r.text, r.x, r.y) for r in dxf.texts_v1(flat).collect())
    assert texts == [("a", 0.0, 0.0), ("late", 1.0, 1.0), ("own", 1.0, 1.0), ("t", 4.0, 4.0)]
