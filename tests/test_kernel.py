import math
import random

import numpy as np
import pytest

from roomwright.operators import kernel, raster

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOOK = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0), (0.0, 2.0)]


def border(ring):
    return [(*ring[k - 1], *ring[k]) for k in range(len(ring))]


def areas(segments):
    return sorted(round(a, 6) for _, a in kernel.faces(kernel.node(segments)))


def test_faces_ignore_dangling_and_bridging_edges():
    assert areas(border(SQUARE) + [(2, 0, 2, 4), (1, 1, 1.5, 1), (0, 0, -1, 0)]) == [8, 8]
    apart = [(x + 10, y) for x, y in SQUARE]
    assert areas(border(SQUARE) + border(apart) + [(4, 0, 10, 0)]) == [16, 16]


def test_crossings_and_overlaps_are_cut():
    assert areas(border(SQUARE) + [(-1, 2, 5, 2), (2, -1, 2, 5), (0, 2, 3, 2)]) == [4, 4, 4, 4]
    assert areas([(0, 0, 4, 4), (0, 4, 4, 0), (0, 0, 0, 4), (4, 0, 4, 4)]) == [4, 4]


def test_holes_are_subtracted():
    inner = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    assert areas(border(SQUARE) + border(inner)) == [1, 15]


def test_cycle_basis_size():
    rng = random.Random(4)
    for _ in range(30):
        points = [(float(k % 4), float(k // 4)) for k in range(12)]
        edges = {tuple(sorted(rng.sample(points, 2))) for _ in range(rng.randint(1, 20))}
        used = {p for e in edges for p in e}
        root = {p: p for p in used}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in edges:
            root[find(a)] = find(b)
        cycles = kernel.cycle_basis([(*a, *b) for a, b in edges])
        assert len(cycles) == len(edges) - len(used) + len({find(p) for p in used})
        for c in cycles:
            assert all(tuple(sorted((c[k - 1], c[k]))) in edges for k in range(len(c)))


def test_measures():
    assert kernel.ring_area(HOOK) == 12 and kernel.ring_length(HOOK) == 16
    assert kernel.ring_centroid(SQUARE) == (2, 2)
    turned = [(0, 0), (2, 2), (1, 3), (-1, 1)]
    assert kernel.rotated_sides(turned) == pytest.approx((math.sqrt(8), math.sqrt(2)))
    assert kernel.rotated_sides([(0, 0), (3, 0)])[1] == 0
    assert kernel.hull(HOOK + [(1.0, 1.0)]) == [(0, 0), (4, 0), (4, 4), (2, 4), (0, 2)]


def test_points_on_the_line_are_outside():
    assert kernel.contains(HOOK, 1, 1) and not kernel.contains(HOOK, 1, 3)
    for x, y in ((2, 3), (0, 0), (4, 2), (1, 2)):
        assert not kernel.contains(HOOK, x, y) and kernel.contains(HOOK, x, y, border=True)


def test_common_area_of_rings_that_are_not_convex():
    assert kernel.common_area(HOOK, [(1, 1), (3, 1), (3, 3), (1, 3)]) == pytest.approx(3)
    assert kernel.common_area(HOOK, SQUARE) == pytest.approx(12)
    assert kernel.common_area(SQUARE, [(5, 0), (6, 0), (6, 1)]) == 0
    assert kernel.common_area(SQUARE, [(1, 1), (9, 1), (9, 2), (1, 2)]) == 3


def test_shared_lines_gaps_and_unions():
    right = [(4.0, 1.0), (8.0, 1.0), (8.0, 9.0), (4.0, 9.0)]
    assert kernel.covered_length(SQUARE, right) == pytest.approx(3)
    assert kernel.covered_length(SQUARE, [(2, 2), (6, 2), (6, 3), (2, 3)]) == pytest.approx(5)
    assert kernel.ring_gap(SQUARE, [(7, 8), (9, 8), (9, 9)]) == 5 and kernel.ring_gap(SQUARE, right) == 0
    ((whole, area),) = kernel.union_rings([SQUARE, right])
    assert area == 48 and abs(kernel.ring_area(whole)) == 48
    assert len(kernel.union_rings([SQUARE, [(x + 9, y) for x, y in SQUARE]])) == 2


@pytest.mark.parametrize("pad", [False, True])
def test_picture_rooms_lie_in_the_rooms(pad):
    walls = border([(0, 0), (10, 0), (10, 6), (0, 6)]) + [(4, 0, 4, 6)]
    found = raster.picture_rooms(walls, 256, 2, 0.7, pad)
    assert len(found) == 2
    for room, (x0, x1) in zip(sorted(found), ((0, 4), (4, 10))):
        real = [(x0, 0), (x1, 0), (x1, 6), (x0, 6)]
        common = kernel.common_area([tuple(p) for p in room[0]], real)
        assert common == pytest.approx(room[1], rel=0.02) and common > 0.85 * kernel.ring_area(real)


def _random_rings(rng, n):
    out = []
    for _ in range(n):
        x, y, w, h = rng.randint(0, 12) / 2, rng.randint(0, 12) / 2, rng.randint(1, 6) / 2, rng.randint(1, 6) / 2
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        kind = rng.random()
        if kind < 0.3:
            ring.insert(1, (x + w / 4, y))
        elif kind < 0.5:
            ring = [(x, y), (x + w, y), (x + w / 2, y + h)]
        elif kind < 0.6:
            ring = [(x, y), (x + w, y), (x + w, y + h), (x + w / 2, y + h / 2), (x, y + h)]
        out.append(ring)
    return out


def test_pairs_of_rings_at_once():
    from roomwright.operators.drawings import plain, ring_array

    rng = random.Random(1)
    a, b = _random_rings(rng, 1500), _random_rings(rng, 1500)
    first, second = (kernel.Rings(ring_array(r)) for r in (a, b))
    assert 0.5 < first.box.mean() < 0.9
    for got, one in ((kernel.common_areas(first, second), kernel.common_area), (kernel.covered_lengths(first, second), kernel.covered_length)):
        assert max(abs(g - one(p, q)) for g, p, q in zip(got.tolist(), a, b)) < 1e-12
    column = ring_array(a + [[]])
    assert plain(column) == column.to_pylist() and plain(column[5:9]) == column[5:9].to_pylist()


def test_nodes_of_many_drawings_at_once():
    rng = random.Random(3)
    owner, lines, want = [], [], set()
    for d in range(60):
        own = [tuple(float(rng.randint(0, 9)) if rng.random() < 0.7 else rng.random() * 9 for _ in range(4)) for _ in range(rng.randint(1, 25))]
        owner += [d] * len(own)
        lines += own
        want |= {(d, *(round(v, 7) for v in e)) for e in kernel.node(own)}
    who, edges = kernel.node_many(np.array(owner), np.array(lines), pairs_at_once=50)
    assert {(d, *(round(v, 7) for v in e)) for d, e in zip(who.tolist(), edges.tolist())} == want


def test_simple_rings_and_chains():
    assert kernel.is_simple([(0, 0), (1, 0), (1, 1), (0, 1)])
    assert not kernel.is_simple([(0, 0), (1, 1), (1, 0), (0, 1)]) and not kernel.is_simple([(0, 0), (2, 0), (1, 0), (1, 1)]) and not kernel.is_simple([(0, 0), (1, 1)])
    assert kernel.chains([(0, 0, 1, 0), (1, 0, 2, 0), (2, 0, 3, 1), (5, 5, 6, 5), (6, 5, 6, 6), (5, 5, 6, 6)]) == [[(0, 0), (1, 0), (2, 0), (3, 1)], [(5, 5), (6, 5), (6, 6), (5, 5)]]


def test_areas_of_pictures_are_connected():
    def plain(free):
        out, number = np.zeros(free.shape, int), 0
        for y, x in zip(*np.nonzero(free)):
            if out[y, x]:
                continue
            number += 1
            todo = [(y, x)]
            while todo:
                v, u = todo.pop()
                if 0 <= v < free.shape[0] and 0 <= u < free.shape[1] and free[v, u] and not out[v, u]:
                    out[v, u] = number
                    todo += [(v + 1, u), (v - 1, u), (v, u + 1), (v, u - 1)]
        return out

    rng = np.random.default_rng(7)
    for share in (0.3, 0.6, 0.9):
        for _ in range(30):
            free = rng.random((rng.integers(1, 40), rng.integers(1, 40))) < share
            a, b = raster.labelled(free), plain(free)
            assert ((a > 0) == (b > 0)).all()
            pairs = set(zip(a[a > 0].tolist(), b[b > 0].tolist()))
            assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_one_drawing_of_5000_rooms(spark):
    """A grid of rooms in one drawing: neighbours, overlaps and nesting by cells, against what a grid must have."""
    from pyspark.sql import functions as F

    from roomwright.functions import shapes
    from roomwright.operators import adjacency, matching, rooms

    wide, high = 100, 50
    ids = spark.range(wide * high).select(F.lit(1).cast("long").alias("drawing_id"), (F.col("id") + 1).alias("room_no"), (F.col("id") % wide * 3.0).alias("x"), (F.floor(F.col("id") / wide) * 2.0).alias("y"))
    table = ids.select("drawing_id", "room_no", shapes.rectangle(F.col("x"), F.col("y"), F.col("x") + 3, F.col("y") + 2).alias("ring"), F.lit(6.0).alias("area_raw"))
    walls = adjacency.shared_walls(table).groupBy("length").count().collect()
    assert {(r.length, r["count"]) for r in walls} == {(2.0, (wide - 1) * high), (3.0, wide * (high - 1))}
    moved = ids.select("drawing_id", F.col("room_no").alias("no"), shapes.rectangle(F.col("x") + 1, F.col("y"), F.col("x") + 4, F.col("y") + 2).alias("ring"))
    found = matching.overlaps(table.select("drawing_id", F.col("room_no").alias("no"), "ring"), moved).groupBy(F.round("iou", 3).alias("iou")).count().collect()
    assert {(r.iou, r["count"]) for r in found} == {(0.5, wide * high), (0.2, (wide - 1) * high)}
    whole = table.unionByName(spark.range(1).select(F.lit(1).cast("long").alias("drawing_id"), F.lit(0).cast("long").alias("room_no"), shapes.rectangle(*map(F.lit, (0.0, 0.0, 3.0 * wide, 2.0 * high))).alias("ring"), F.lit(6.0 * wide * high).alias("area_raw")))
    assert [r.room_no for r in rooms.without_nested(whole).collect()] == [0]
    assert rooms.without_containers(whole).count() == wide * high
