"""Merging many drawings at once against one drawing after another, in plain loops."""

import math

import numpy as np
import pyarrow as pa

from roomwright.operators import kernel, merge
from roomwright.operators.drawings import ring_array


def _slow(rings, areas, ratio=0.3, gap=0.15, reach=2.0):
    for _ in range(merge.PASSES):
        used, out, merged = set(), [], False
        for i, ring in enumerate(rings):
            if i in used:
                continue
            group = [j for j in range(i + 1, len(rings)) if j not in used and merge._belong(ring, rings[j], ratio, gap, reach)]
            used.update(group)
            merged = merged or bool(group)
            if not group:
                out.append((ring, areas[i]))
                continue
            for whole, area in kernel.union_rings([ring, *(rings[j] for j in group)]):
                hole = kernel.ring_area(whole) - area
                out.append((whole, area if hole >= 0.5 else kernel.ring_area(whole)))
        rings, areas = [list(r) for r, _ in out], [a for _, a in out]
        if not merged:
            break
    return rings, areas


def _slow_groups(rings, ratio, reach):
    left, part, out = list(enumerate(rings)), 0, {}
    while left:
        no, ring = left.pop(0)
        part += 1
        x, y = kernel.ring_centroid(ring)
        taken = [(k, r) for k, r in left if merge._shared(ring, r) / min(kernel.ring_length(ring), kernel.ring_length(r)) >= ratio and math.dist(kernel.ring_centroid(r), (x, y)) <= reach]
        left = [t for t in left if t not in taken]
        out |= {k: part for k, _ in [(no, ring), *taken]}
    return [out[k] for k in range(len(rings))]


def _plans():
    rng = np.random.default_rng(3)
    for d in range(60):
        x, h, rings = 0.0, float(rng.integers(2, 6)), []
        for _ in range(1 + d % 7):
            w = float(rng.integers(1, 6))
            rings.append([(x, 0.0), (x + w, 0.0), (x + w, h), (x, h)])
            x += w + (0.1 if rng.random() < 0.15 else 0.0)
        if d % 5 == 0:
            rings.append([(0.0, h), (2.0, h), (1.0, h + 2.0)])
        if d % 6 == 0:
            rings.append([(0.0, -1.0), (3.0, -1.0), (3.0, 0.0), (0.0, 0.0)])
        yield rings


def _table(spark, plans):
    rows = [(d, k + 1, [{"x": x, "y": y} for x, y in r], kernel.ring_area(r)) for d, rings in enumerate(plans) for k, r in enumerate(rings)]
    return spark.createDataFrame(rows, "drawing_id long, room_no long, ring array<struct<x:double,y:double>>, area_raw double")


def test_merged_rooms(spark):
    plans = list(_plans())
    got = {}
    for r in merge.merge_rooms(_table(spark, plans)).collect():
        got.setdefault(r.drawing_id, []).append((r.part, [(p.x, p.y) for p in r.ring], r.area_raw))
    for d, rings in enumerate(plans):
        slow, areas = _slow(rings, [kernel.ring_area(r) for r in rings])
        found = sorted(got[d])
        assert [p for p, _, _ in found] == list(range(1, len(slow) + 1))
        assert [r for _, r, _ in found] == [list(map(tuple, r)) for r in slow]
        assert np.allclose([a for *_, a in found], areas, atol=1e-9)


def test_groups(spark):
    plans = list(_plans())
    for ratio, reach in ((0.4, 5.0), (0.2, 6.0)):
        got = {(r.drawing_id, r.room_no): r.part for r in merge.merge_groups_v0(_table(spark, plans), ratio, reach).collect()}
        for d, rings in enumerate(plans):
            assert [got[d, k + 1] for k in range(len(rings))] == _slow_groups(rings, ratio, reach)


def test_rows_of_a_drawing_are_not_unpacked(monkeypatch):
    """20,000 rooms that do not merge are told by arrays alone."""
    monkeypatch.setattr(merge, "_belong", None)
    monkeypatch.setattr(kernel.Rings, "ring", None)
    rings = [[(9.0 * k, 0.0), (9.0 * k + 8, 0.0), (9.0 * k + 8, 3.0), (9.0 * k, 3.0)] for k in range(20_000)]
    i, j = merge._belonging(np.arange(20_000) // 4, kernel.Rings(ring_array(rings)), 0.3, 0.15, 2.0)
    assert len(i) == len(j) == 0 and pa.array(i).null_count == 0
