"""Rooms that hold other rooms' centres, against every pair of them one by one."""

import numpy as np
import pyarrow as pa

from roomwright.operators import kernel, rooms
from roomwright.operators.drawings import ring_array


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def _mixed(seed: int, n: int) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x, y, w, h = *rng.integers(0, 12, 2).tolist(), *rng.integers(1, 9, 2).tolist()
        out.append(_box(x, y, x + w, y + h) if k % 3 else [(x, y), (x + w, y), (x + w / 4, y + h / 4), (x, y + h)])
    return out


def test_holding_equals_all_pairs():
    many = [_mixed(s, 2 + s % 17) for s in range(40)]
    owner = np.repeat(np.arange(len(many)), [len(m) for m in many])
    flat = [r for m in many for r in m]
    area = np.array([abs(kernel.ring_area(r)) for r in flat])
    slow = []
    for i, r in enumerate(flat):
        near = [k for k in range(len(flat)) if k != i and owner[k] == owner[i] and area[i] > 1.1 * area[k]]
        slow.append(any(kernel.contains(r, *kernel.ring_centroid(flat[k]), eps=0.0) for k in near))
    for at_once in (5, 1 << 20):
        assert kernel.holding(owner, kernel.Rings(ring_array(flat)), area, 1.1, at_once).tolist() == slow


def test_containers_need_no_join(spark):
    rows = [(d, k, [dict(zip("xy", map(float, p))) for p in r], abs(kernel.ring_area(r)), "n") for d in range(3) for k, r in enumerate([_box(0, 0, 9, 9), _box(1, 1, 3, 3), _box(20, 0, 21, 1)])]
    table = spark.createDataFrame(rows, "drawing_id long, room_no long, ring array<struct<x:double,y:double>>, area_raw double, name string")
    found = rooms.without_containers(table)
    assert found.schema == table.schema and sorted((r.drawing_id, r.room_no, r.name) for r in found.collect()) == [(d, k, "n") for d in range(3) for k in (1, 2)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_no_rows():
    empty = kernel.Rings(pa.array([], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    assert kernel.holding(np.zeros(0, int), empty, np.zeros(0), 1.1).tolist() == []
