"""The grid cut in arrays: each pair counts in one cell, whole drawings come together again, and nothing but packed batches is dealt."""

import random

import numpy as np
import pytest

from roomwright.operators import cells, kernel, rooms
from roomwright.plans import catalog


def _lines(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [s for s in ((rng.randint(0, 30) / 2, rng.randint(0, 9) * 1.0, rng.randint(0, 30) / 2, rng.randint(0, 9) * 1.0) for _ in range(n)) if s[:2] != s[2:]]


def test_edges_of_many_cells_are_those_of_the_plain_form():
    drawings = [_lines(k, n) for k, n in enumerate((1, 9, 40, 150))] + [[(0.0, 0.0, 9.0, 0.0)] * 3 + [(4.0, -1.0, 4.0, 1.0), (9.0, 0.0, 0.0, 0.0)]]
    owner = np.repeat(np.arange(len(drawings)), [len(v) for v in drawings])
    s = np.array([v for lines in drawings for v in lines])
    kept = cells.without_repeats(owner, s)
    seg, at = cells.in_cells(owner, s)
    assert len(seg) > len(s)
    unit = (owner[seg] * 600 + at[:, 0]) * 600 + at[:, 1]
    order = np.argsort(unit, kind="stable")
    seg, at, unit = seg[order], at[order].astype(np.int64), np.unique(unit, return_inverse=True)[1][order]
    several = np.bincount(seg)[seg] > 1
    place, edges, open_, points = cells.cut_in_cells(unit, at, several, s[seg])
    who, more = cells.cut_whole(owner[seg[open_]], s[seg[open_]], points)
    got = {(o, *np.round(e, 7)) for o, e in zip(np.concatenate([owner[seg[place]], who]).tolist(), np.concatenate([edges, more]))}
    assert got == {(o, *np.round(e, 7)) for o, lines in enumerate(drawings) for e in kernel.node(lines)}


def test_repeats_go_and_others_stay():
    s = np.array([(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 0.0, 0.0), (2.0, 2.0, 2.0, 2.0), (0.0, 0.0, 1.0, 0.0)])
    assert cells.without_repeats(np.array([0, 0, 0, 0, 1]), s).tolist() == [0, 2, 4]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_faces_of_drawings_with_any_key_and_without_one(spark, kind):
    rows = [(k, *s) for k, lines in enumerate((_lines(1, 12), _lines(2, 90))) for s in lines]
    rows += [(None, 0.0, 0.0, 2.0, 0.0), (None, 2.0, 0.0, 2.0, 2.0), (None, 2.0, 2.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "drawing_id long, sx double, sy double, ex double, ey double").selectExpr(f"cast(drawing_id as {kind}) drawing_id", "sx", "sy", "ex", "ey")
    plain = lambda df: sorted((str(r[0]), [tuple(round(v, 6) for v in p) for p in r[1]], round(r[2], 6)) for r in df.select("drawing_id", "ring", "area_raw").collect())
    assert plain(cells.faces(frame, cells.plain_lines)) == plain(rooms.noded_faces(frame))


def test_the_query_deals_no_rows_of_segments(spark):
    made = catalog.QUERIES["polygonize_by_grid"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 3
