"""Rooms of files in one pass against the joins."""

import pytest
from pyspark.sql import functions as F

from roomwright.plans import engine
from roomwright.plans.fixtures import Drawings
from roomwright.sources import dxf

COLUMNS = ["drawing_id", "room_no", "ring", "area_raw", "name", "area_sqft", "perimeter", "cx", "cy", "aspect", "convexity", "compactness"]


def plain(rows):
    def of(v):
        return round(v, 7) + 0.0 if isinstance(v, float) else tuple(map(of, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(map(of, r)) for r in rows), key=repr)


@pytest.mark.parametrize("small", [14])
def test_one_pass_equals_the_joins(spark, small, monkeypatch):
    d = Drawings(spark, "/root/testdata/sf0.001")
    some = F.col("drawing_id") < 40
    slanted = d.cell.where(some & (F.col("room_no") == 1)).select("drawing_id", F.lit("A-WALL").alias("layer"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.col("x1").alias("ex"), F.col("y1").alias("ey"))
    lines = d.segment.where(some).select("drawing_id", "layer", "sx", "sy", "ex", "ey").unionByName(slanted)
    table = dxf.entities(dxf.dxf_text(lines, units=F.when(F.col("drawing_id") % 2 == 0, 5).otherwise(6)))
    want = plain(engine.vector_rooms(engine.from_dxf(table)).select(*COLUMNS).collect())
    asked = []
    joins = engine.vector_rooms
    monkeypatch.setattr(engine, "vector_rooms", lambda *a: asked.append(1) or joins(*a))
    assert plain(engine.file_rooms(table, small=small).select(*COLUMNS).collect()) == want and len(want) > 30
    assert len(asked) == 1  # for the large files only
