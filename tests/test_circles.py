"""The older engine's circles: chords without lists of points, and files of which only some types are read."""

import math

from roomwright.plans import catalog, more  # noqa: F401
from roomwright.sources import dxf

FILE = "\n".join(
    "0 SECTION 2 BLOCKS 0 BLOCK 2 A 0 CIRCLE 8 c 10 1 20 1 40 2 0 ENDBLK 0 ENDSEC 0 SECTION 2 ENTITIES 0 POLYLINE 8 p 70 1 0 VERTEX 10 0 20 0 0 VERTEX 10 1 20 0 0 SEQEND "
    "0 INSERT 2 a 10 5 20 0 0 ATTRIB 1 t 10 x 20 1 0 SEQEND 0 INSERT 2 A 10 x 20 0 0 INSERT 2 A 10 7 20 1 41 2 0 VERTEX 10 1 20 1 0 CIRCLE 8 d 10 0 20 0 40 1 0 CIRCLE 10 0 20 0 0 ENDSEC 0 EOF".split(" ")
)


def test_chords_of_circles_at_every_insertion(spark):
    files = spark.createDataFrame([(1, FILE)], "drawing_id long, content string")
    rows = dxf.segments_v1(dxf.expand(dxf.entities(files, ("CIRCLE",)), every_instance=True))
    got = sorted((r.seg_no, *(round(v, 9) for v in (r.sx, r.sy, r.ex, r.ey)), r.layer) for r in rows.collect())
    want = []
    for visit, (x, y, radius, layer) in {3: (6.0, 1.0, 2.0, "c"), 6: (8.0, 2.0, 2.0, "c"), 7: (0.0, 0.0, 1.0, "d")}.items():
        at = [(x + radius * math.cos(math.radians(360 * k / 96)), y + radius * math.sin(math.radians(360 * k / 96))) for k in range(97)]
        want += [(visit * 2**32 + k, *(round(v, 9) + 0.0 for v in (*at[k], *at[k + 1])), layer) for k in range(96)]
    assert [(g[0], *(v + 0.0 for v in g[1:5]), g[5]) for g in got] == sorted(want)


def test_types_that_are_not_asked_for_change_no_number_or_place():
    every = dxf.parse(FILE)
    places = [dxf.places(every, each) for each in (False, True)]
    for kind in ("CIRCLE", "INSERT", "POLYLINE", "VERTEX"):
        some = dxf.parse(FILE, frozenset((kind,)))
        found = [dxf.places(some, each, frozenset((kind,))) for each in (False, True)]
        kept = [k for k, r in enumerate(every) if r[2] == kind]
        assert [(some[k], found[0][k], found[1][k]) for k in kept] == [(every[k], places[0][k], places[1][k]) for k in kept]
        assert kept == [k for k, r in enumerate(some) if r[2] == kind]


def test_the_query_lists_no_points_and_deals_once(spark):
    plan = catalog.QUERIES["dxf_circles_v1"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange") == 1
