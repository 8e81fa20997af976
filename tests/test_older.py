"""The older engine as a fold against the joins that it stands for, on drawings with odd walls, layers, texts, doors and blocks."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomwright.operators import kernel, older
from roomwright.plans import catalog, engine
from roomwright.plans.fixtures import Drawings

SF = "/root/testdata/sf0.001"
LAYERS = ["a-wall", " Core ", "0", "", None, "WALLPAPER x", "structß", "dim"]
WORDS = ["Hall", "BEDROOM", "bath 2", "", None, "kitchen"]
BLOCKS = ["STOVE4", "bed", "WC-01", "SOFA", None, "tree", "sink unit", "dine"]
SEEN = "drawing_id long, room_no long, vision_label string, vision_confidence double"


def _drawings():
    rng = np.random.default_rng(5)
    segments, texts, doors, blocks = [], [], [], []
    for d in range(1, 31):
        w, h = float(rng.integers(4, 16)), float(rng.integers(3, 12))
        x, y = w * 0.3, h * 0.6
        lines = [(0, 0, w, 0), (w, 0, w, h), (w, h, 0, h), (0, h, 0, 0), (x, 0, x, h), (x, y, w, y), (0, 0, x, 0.004)]
        lines += [(0, 0, w / 2, 0), (w / 3, h / 4, w / 2, h / 2), (20, 0, 26, 0), (26, 0, 20, 5.0004), (20, 5, 20, 0), (3, 3, 3, 3.001)][: d % 7]
        if d % 5 == 0:
            lines += [(v, 0, v, h) for v in np.linspace(0.5, w - 0.5, 5).tolist()] + [(float("nan"), 0, 1, 1), (None, 0, 1, 1)]
        if d % 6 == 0:  # rooms about as small as the least, and one far larger than the second
            lines = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0), (0, 1, 0, 9), (0, 9, 9, 9), (9, 9, 9, 1), (9, 1, 1, 1)]
        if d % 3 == 1:  # rooms apart, too far to be merged, which share doors
            lines = [line for k in range(2 + d % 4) for a in [k * (w / 4 + 0.4)] for line in ((a, 0, a + w / 4, 0), (a + w / 4, 0, a + w / 4, h), (a + w / 4, h, a, h), (a, h, a, 0))]
        own = LAYERS[d % 8 :: 3] if d % 4 else LAYERS[d % 8 : d % 8 + 1]
        segments += [(d, own[k % len(own)] if k > 3 else own[0], *(v if v is None else float(v) for v in line)) for k, line in enumerate(lines)]
        if d % 3:
            texts += [(d, k, WORDS[(d + k) % 6], *(rng.random(2) * (w, h)).tolist()) for k in range(1, 4)]
        doors += [(d, k, px, py, [None, 0.0, 0.9][k % 3]) for k, (px, py) in enumerate([(x, h / 2), (x + 1, y), (w / 2 + 0.6, y), (0.0, 1.0)])]
        blocks += [(d, k, BLOCKS[(d * 3 + k) % 8], *(rng.random(2) * (w, h)).tolist()) for k in range(d % 5)]
    return segments, [*texts, (99, 1, "lost", 0.0, 0.0)], doors, blocks


@pytest.fixture(scope="module")
def drawn(spark):
    segments, texts, doors, blocks = _drawings()
    return engine.Drawing(
        spark.createDataFrame(segments, "drawing_id long, layer string, sx double, sy double, ex double, ey double").where("not isnan(sx) or sx is null"),
        spark.createDataFrame(texts, "drawing_id long, text_no long, text string, x double, y double"),
        spark.createDataFrame(doors, "drawing_id long, door_no long, cx double, cy double, radius double"),
        spark.createDataFrame(blocks, "drawing_id long, block_no long, name string, x double, y double"),
        scales=spark.createDataFrame([(2, 0.3048, 1.0), (3, 0.1, 5.0), (4, 1.0, None)], "drawing_id long, metres double, sqft double"),
    )


def plain(rows, digits=9):
    def of(v):
        return round(v, digits) + 0.0 if isinstance(v, float) else tuple(map(of, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(map(of, r)) for r in rows), key=repr)


def test_the_fold_equals_the_joins(spark, drawn):
    vision = spark.createDataFrame([(d, k, "Study", 0.7 + 0.01 * d) for d in range(1, 31, 2) for k in (1, 2)], SEEN)
    want = engine._v1_by_joins(drawn, vision)
    expected = {k: plain(want[k].collect()) for k in ("links", "adjacency")}
    for small in (2_000, 11):  # with 11, the drawings of more lines take the joins
        got = engine.run_pipeline_v1(drawn, vision, small)
        columns = got["rooms"].columns
        assert sorted(columns) == sorted(want["rooms"].columns)
        rows = plain(got["rooms"].collect())
        assert rows == plain(want["rooms"].select(*columns).collect())
        assert {k: plain(got[k].collect()) for k in expected} == expected
        assert len({r[0] for r in rows}) > 20 and len(rows) > 40 and len(expected["adjacency"]) > 10
    assert {"text", "rules+furniture", "rules+area", "rules"} <= {r.method for r in got["rooms"].select("method").distinct().collect()}


def test_lines_without_numbers_are_no_walls(spark, drawn):
    bad = spark.createDataFrame([(1, LAYERS[1], float("nan"), 0.0, 1.0, 1.0), (2, LAYERS[2], 0.0, 0.0, float("inf"), 1.0)], drawn.segments.schema)
    columns = ["drawing_id", "room_no", "area_raw", "ring", "name", "method"]
    want, got = (engine.run_pipeline_v1(replace(drawn, segments=s))["rooms"].select(*columns).collect() for s in (drawn.segments, drawn.segments.unionByName(bad)))
    assert plain(got) == plain(want)


def test_cycles_where_no_face_is_found(monkeypatch):
    def square(a, b):
        return [(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)]

    none = kernel.faces_many(np.zeros(0, np.int64), np.zeros((0, 4)))
    monkeypatch.setattr(older.kernel, "faces_many", lambda owner, edges: none)
    lines = np.array(square(0, 10) + square(1, 9) + square(0, 2) + square(0, 5), float)
    found = older.rooms_of(np.array([0] * 8 + [1] * 4 + [3] * 4), lines, np.full(4, 10.7639))
    assert found.owner.tolist() == [0, 1, 3] and found.number.tolist() == [1, 1, 1]
    assert found.area.tolist() == [64.0, 4.0, 25.0]  # the outer square holds the inner one's centre
    assert found.rings.ring(0) == [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]


def test_a_sheet_has_the_rows_of_the_tables(spark):
    d = Drawings(spark, SF)
    made = older.sheet(d.segment, d.text, d.door, d.block)
    rows = [(r.drawing_id, layer, *r.lines[4 * k : 4 * k + 4]) for r in d.sheet.collect() for k, layer in enumerate(r.layers)]
    assert plain(rows) == plain(d.segment.select("drawing_id", "layer", "sx", "sy", "ex", "ey").collect())
    for part in ("texts", "doors", "blocks"):
        want, got = (s.select("drawing_id", F.inline(part)) for s in (made, d.sheet))
        assert got.columns == want.columns and got.count() > 1000
        assert plain(got.collect()) == plain(want.collect())


def test_the_query_deals_rows_once_and_writes_one_table(spark):
    plan = older.floors(Drawings(spark, SF).sheet, 10.7639, 2_000, whole=True)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange " in line for line in plan.splitlines()) == 1
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert catalog.QUERIES["pipeline_v1"](spark, SF).count() > 0
    assert len(set(os.listdir(folder)) - before) == 1


def test_edges_that_come_twice_bound_the_same_faces():
    rng = np.random.default_rng(7)
    s = rng.integers(0, 9, (400, 4)).astype(float)
    owner = np.sort(rng.integers(0, 12, len(s)))
    want = kernel.faces_many(*kernel.node_many(owner, s))
    got = kernel.faces_many(*kernel.node_many(owner, s, distinct=False))
    assert len(want[0]) > 500
    assert got[0].tolist() == want[0].tolist() and got[1].to_pylist() == want[1].to_pylist() and got[2].tolist() == want[2].tolist()


@pytest.mark.parametrize("size", [50, 1 << 17])
def test_places_by_group_and_value(size):
    rng = np.random.default_rng(8)
    group, value = rng.integers(0, size, 5_000), rng.integers(0, 40, 5_000) / 7
    order = kernel.ordered(group, value, size)
    assert list(zip(group[order].tolist(), value[order].tolist())) == sorted(zip(group.tolist(), value.tolist()))
    points = np.stack([value, rng.integers(0, 3, 5_000) - 1.0], axis=1)
    number, who, at = kernel.numbered_points(group, points)
    rows = list(zip(group.tolist(), *points.T.tolist()))
    assert list(zip(who.tolist(), *at.T.tolist())) == sorted(set(rows))
    assert [sorted(set(rows))[k] for k in number.tolist()[:50]] == rows[:50]
