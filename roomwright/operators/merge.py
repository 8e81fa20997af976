"""Merging fragments of rooms: the older engines' greedy passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import RING
from . import kernel
from .drawings import fold_rings, ring_array

MERGED = f"part long, ring {RING}, area_raw double"
PASSES = 3


def _shared(a, b) -> float:
    """Length of the line that two rings have in common."""
    return min(kernel.covered_length(a, b), kernel.covered_length(b, a))


def _belong(a, b, ratio: float, gap: float, reach: float) -> bool:
    """Whether two rings are one room: enough shared line, or near centres and hardly a gap.

    The shared line stands for the overlap of two thinly widened rings by their width; overlapping rings count their common
    area by that width as well.
    """
    width = 0.02
    shared = _shared(a, b) + kernel.common_area(a, b) / width
    if shared / max(min(kernel.ring_length(a), kernel.ring_length(b)), 1e-9) >= ratio:
        return True
    (ax, ay), (bx, by) = kernel.ring_centroid(a), kernel.ring_centroid(b)
    return math.hypot(ax - bx, ay - by) <= reach and kernel.ring_gap(a, b) <= gap


def _belonging(owner: np.ndarray, rings: kernel.Rings, ratio: float, gap: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rings of one owner that belong together, as _belong tells; rectangles along the axes by their sides."""
    i, j = kernel.near_pairs(owner, rings, gap if ratio > 0 else math.inf)
    a, b = rings.take(i), rings.take(j)
    size, (x, y) = rings.lengths(), rings.centres()
    w, h = kernel.common_sides(a, b)
    shared = kernel.shared_lengths(rings, i, j, both_boxes_only=True) + w * h / 0.02
    fits = shared / np.maximum(np.minimum(size[i], size[j]), 1e-9) >= ratio
    fits |= (np.hypot(x[i] - x[j], y[i] - y[j]) <= reach) & (a.gap(b) <= gap)
    for k in np.flatnonzero(~(rings.box[i] & rings.box[j])).tolist():
        fits[k] = _belong(rings.ring(i[k]), rings.ring(j[k]), ratio, gap, reach)
    return i[fits], j[fits]


def _group(n: int, pairs: dict[int, list[int]]) -> list[list[int]]:
    """Places in order, each with the later ones that it takes up: those that belong to it and are left."""
    used: set[int] = set()
    out = []
    for i in range(n):
        if i not in used:
            taken = [j for j in pairs.get(i, ()) if j not in used]
            used.update(taken)
            out.append([i, *taken])
    return out


def _by_first(i: np.ndarray, j: np.ndarray) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for p, q in zip(i.tolist(), j.tolist()):
        out.setdefault(p, []).append(q)
    return out


def _union(group: list[list]) -> list[tuple[list, float]]:
    """union_rings; rectangles of one height side by side by their corners."""
    low, high = group[0][0][1], max(y for _, y in group[0])
    spans = []
    for ring in group:
        xs = [x for x, _ in ring]
        plain = all(y in (low, high) for _, y in ring) and len({y for _, y in ring}) == 2
        corners = {(min(xs), low), (max(xs), low), (min(xs), high), (max(xs), high)}
        # counter-clockwise from the lower left: once along the bottom, once back along the top
        k = sum(y == low for _, y in ring)
        if not plain or not corners <= set(ring) or len(set(ring)) < len(ring) or xs[:k] != sorted(xs[:k]) or xs[k:] != sorted(xs[k:], reverse=True) or any(y != low for _, y in ring[:k]):
            return kernel.union_rings(group)
        spans.append((min(xs), max(xs)))
    spans.sort()
    if any(a[1] != b[0] for a, b in zip(spans, spans[1:])) or any(round(v, 9) != v for ring in group for p in ring for v in p):
        return kernel.union_rings(group)
    bottom = sorted({x for ring in group for x, y in ring if y == low})
    top = sorted({x for ring in group for x, y in ring if y == high}, reverse=True)
    return [([(x, low) for x in bottom] + [(x, high) for x in top], (spans[-1][1] - spans[0][0]) * (high - low))]


def merged_many(owner: np.ndarray, column: pa.ListArray, area: pa.Array, ratio: float = 0.3, gap: float = 0.15, reach: float = 2.0, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """merge_rooms of the numbered rooms of many drawings (ascending owners): owners, parts, rings, areas, in any order.

    Pairs are tested for many drawings at once; only drawings in which something merges are walked through room by room."""
    begin = np.searchsorted(owner, owner, "left")
    done_who, done_part, done_ring, done_area = [], [], [], []
    who, rings, areas, part = owner, kernel.Rings(column), area, np.arange(len(owner)) - begin + 1
    for turn in range(passes + 1):
        i, j = _belonging(who, rings, ratio, gap, reach) if turn < passes else (np.zeros(0, int),) * 2
        open_ = np.isin(who, who[i])
        still = pa.array(np.flatnonzero(~open_))
        done_who.append(who[~open_])
        done_part.append(part[~open_])
        done_ring.append(column.take(still))
        done_area.append(areas.take(still))
        if not open_.any():
            break
        pairs, value = _by_first(i, j), areas.to_pylist()
        new: list[tuple[int, int, list, float]] = []
        of = np.flatnonzero(open_)
        for own, a, b in _runs(who[of]):
            first, count = int(of[a]), 0
            own_pairs = {k - first: [q - first for q in pairs[k]] for k in range(first, first + b - a) if k in pairs}
            for group in _group(b - a, own_pairs):
                members = [rings.ring(first + k) for k in group]
                found = _union(members) if len(group) > 1 else [(members[0], None)]
                for whole, size in found:
                    if size is None:
                        size = value[first + group[0]]
                    elif (all_of := kernel.ring_area(whole)) - size < 0.5:
                        size = all_of
                    count += 1
                    new.append((own, count, whole, size))
        who, part = np.array([n[0] for n in new]), np.array([n[1] for n in new])
        column, areas = ring_array([n[2] for n in new]), pa.array([n[3] for n in new], pa.float64())
        rings = kernel.Rings(column)
    return np.concatenate(done_who), np.concatenate(done_part), pa.concat_arrays([c.cast(done_ring[0].type) for c in done_ring]), pa.concat_arrays([c.cast(pa.float64()) for c in done_area])


def merge_rooms(rooms: DataFrame, ratio: float = 0.3, gap: float = 0.15, reach: float = 2.0, passes: int = PASSES) -> DataFrame:
    """drawing_id, part, ring, area_raw. In each pass a room takes up all later rooms that belong to it (to the room itself, not
    to what it has taken up); passes repeat while something merges. Holes of a union under 0.5 are filled."""

    def merge(owner: np.ndarray, rows: pa.StructArray) -> tuple[np.ndarray, list]:
        who, *columns = merged_many(owner, rows.field("ring"), rows.field("area_raw"), ratio, gap, reach, passes)
        return who, columns

    return fold_rings(rooms.select("drawing_id", "room_no", "ring", "area_raw"), "room_no", merge, MERGED)


def _runs(owner: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)).tolist()
    return [(int(owner[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def merge_groups_v0(rooms: DataFrame, ratio: float = 0.4, reach: float = 5.0) -> DataFrame:
    """drawing_id, room_no, part: which rooms the oldest engine merges. The first room left takes all later ones that share so
    much of the shorter outline and have a near centre. Pairs are tested for many drawings at once."""

    def group(owner: np.ndarray, rows: pa.StructArray) -> tuple[np.ndarray, list]:
        rings = kernel.Rings(rows.field("ring"))
        i, j = kernel.near_pairs(owner, rings, 0.0 if ratio > 0 else math.inf)
        size, (x, y) = rings.lengths(), rings.centres()
        near = np.hypot(x[i] - x[j], y[i] - y[j]) <= reach
        i, j = i[near], j[near]
        fits = kernel.shared_lengths(rings, i, j) / np.minimum(size[i], size[j]) >= ratio
        i, j = i[fits], j[fits]
        head = np.arange(len(owner))
        pairs = _by_first(i, j)
        for first in sorted(pairs):
            if head[first] == first:
                for k in pairs[first]:
                    if head[k] == k:
                        head[k] = first
        own = np.cumsum(head == np.arange(len(owner)))
        start = np.searchsorted(owner, owner, "left")
        return owner, [rows.field("room_no"), own[head] - own[start] + 1]

    return fold_rings(rooms.select("drawing_id", "room_no", "ring"), "room_no", group, "room_no long, part long")


def union_areas(rooms: DataFrame, groups: DataFrame) -> DataFrame:
    """drawing_id, part, area of groups of rooms that do not overlap."""
    return rooms.join(groups, ["drawing_id", "room_no"]).groupBy("drawing_id", "part").agg(F.sum("area_raw").alias("area_raw"))
