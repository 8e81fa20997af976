"""Rooms from pictures at the size that the engine uses."""

from collections import Counter

from roomwright.plans import catalog
from roomwright.plans.fixtures import Drawings

SF = "/root/testdata/sf0.001"


def rows_of(frame, *columns):
    return Counter(tuple(round(v, 6) for v in r) for r in frame.select(*columns).collect())


def test_pictures_show_every_strip_room(spark):
    seen = catalog.QUERIES["raster_rooms"](spark, SF).groupBy("drawing_id").count()
    cells = Drawings(spark, SF).cell.groupBy("drawing_id").count()
    assert rows_of(seen, "drawing_id", "count") == rows_of(cells, "drawing_id", "count")
