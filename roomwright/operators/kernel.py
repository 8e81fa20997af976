"""Planar geometry on plain lists and numpy arrays, for one drawing or one pair of rings at a time."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa

Point = tuple[float, float]


def ring_area(ring) -> float:
    """Signed area."""
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def ring_length(ring) -> float:
    p = np.asarray(ring, float)
    d = np.roll(p, -1, axis=0) - p
    return float(np.hypot(d[:, 0], d[:, 1]).sum())


def ring_centroid(ring) -> Point:
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    total = cross.sum()
    if abs(total) < 1e-15:
        return float(p[:, 0].mean()), float(p[:, 1].mean())
    c = ((p + q) * cross[:, None]).sum(axis=0) / (3 * total)
    return float(c[0]), float(c[1])


class Rings:
    """A column of rings (lists of (x, y) structs) as flat arrays, with their bounding boxes and whether a ring is its box."""

    def __init__(self, column):
        ends = column.offsets.to_numpy()
        points = column.values.slice(ends[0], ends[-1] - ends[0])
        self.x, self.y = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        self.ends = ends - ends[0]
        first, size = self.ends[:-1], np.diff(self.ends)
        self.full = size > 0
        n, begin = len(size), first[self.full]
        self.low_x, self.low_y, self.high_x, self.high_y, self.area = (np.zeros(n) for _ in range(5))
        if len(begin):
            for to, of, take in ((self.low_x, self.x, np.minimum), (self.low_y, self.y, np.minimum), (self.high_x, self.x, np.maximum), (self.high_y, self.y, np.maximum)):
                to[self.full] = take.reduceat(of, begin)
            follow = np.arange(1, len(self.x) + 1)
            follow[self.ends[1:][self.full] - 1] = begin
            self.area[self.full] = np.add.reduceat(self.x * self.y[follow] - self.x[follow] * self.y, begin) / 2
        owner = np.repeat(np.arange(n), size)
        on_line = (self.x == self.low_x[owner]) | (self.x == self.high_x[owner]) | (self.y == self.low_y[owner]) | (self.y == self.high_y[owner])
        off = np.bincount(owner[~on_line], minlength=n) > 0
        self.width, self.height = self.high_x - self.low_x, self.high_y - self.low_y
        box_area = self.width * self.height
        self.box = self.full & ~off & (box_area > 0) & (np.abs(np.abs(self.area) - box_area) <= 1e-12 * box_area)

    def ring(self, k: int) -> list[Point]:
        part = slice(self.ends[k], self.ends[k + 1])
        return list(zip(self.x[part].tolist(), self.y[part].tolist()))


    def take(self, k: np.ndarray) -> Boxes:
        """The boxes of some rings."""
        return Boxes(self.low_x[k], self.low_y[k], self.high_x[k], self.high_y[k])

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """ring_centroid of every ring; of rectangles along the axes their middles."""
        x, y = (self.low_x + self.high_x) / 2, (self.low_y + self.high_y) / 2
        for k in np.flatnonzero(self.full & ~self.box).tolist():
            x[k], y[k] = ring_centroid(self.ring(k))
        return x, y

    def lengths(self) -> np.ndarray:
        """ring_length of every ring."""
        out = 2 * self.width + 2 * self.height
        for k in np.flatnonzero(self.full & ~self.box).tolist():
            out[k] = ring_length(self.ring(k))
        return out


class Boxes:
    """Bounding boxes as arrays."""

    def __init__(self, low_x: np.ndarray, low_y: np.ndarray, high_x: np.ndarray, high_y: np.ndarray):
        self.low_x, self.low_y, self.high_x, self.high_y = low_x, low_y, high_x, high_y

    def gap(self, other: Boxes) -> np.ndarray:
        dx = np.maximum(np.maximum(self.low_x - other.high_x, other.low_x - self.high_x), 0)
        dy = np.maximum(np.maximum(self.low_y - other.high_y, other.low_y - self.high_y), 0)
        return np.hypot(dx, dy)


def _covered_of_boxes(a: Boxes, b: Boxes, eps: float = 1e-9) -> np.ndarray:
    w, h = common_sides(a, b)
    out = np.zeros(len(w))
    for side in (b.low_y, b.high_y):
        out += np.where((side >= a.low_y - eps) & (side <= a.high_y + eps), w, 0.0)
    for side in (b.low_x, b.high_x):
        out += np.where((side >= a.low_x - eps) & (side <= a.high_x + eps), h, 0.0)
    return out


def near_pairs(owner: np.ndarray, rings: Rings, within: float, pairs_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rings of one owner (ascending) whose boxes are at most so far apart, in their order."""
    n = len(owner)
    count = np.searchsorted(owner, owner, "right") - np.arange(n) - 1
    total = np.cumsum(count)
    found_i, found_j, at = [], [], 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs_at_once, "right")))
        own = count[at:stop]
        i = np.repeat(np.arange(at, stop), own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
        near = rings.full[i] & rings.full[j] & (rings.take(i).gap(rings.take(j)) <= within + 1e-9)
        found_i.append(i[near])
        found_j.append(j[near])
        at = stop
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def shared_lengths(rings: Rings, i: np.ndarray, j: np.ndarray, both_boxes_only: bool = False) -> np.ndarray:
    """Length of the line that pairs of rings have in common; with both_boxes_only any value for other pairs than of boxes."""
    a, b = rings.take(i), rings.take(j)
    out = np.minimum(_covered_of_boxes(a, b), _covered_of_boxes(b, a))
    for k in [] if both_boxes_only else np.flatnonzero(~(rings.box[i] & rings.box[j])).tolist():
        p, q = rings.ring(i[k]), rings.ring(j[k])
        out[k] = min(covered_length(p, q), covered_length(q, p))
    return out


def holding(owner: np.ndarray, rings: Rings, area: np.ndarray, times: float, pairs_at_once: int = 1 << 20) -> np.ndarray:
    """Which rings hold, strictly inside, the centre of another one of their owner whose area they exceed by so many times.
    Only centres in the x range of a ring are looked at, by a sorted list of them."""
    n = len(owner)
    out = np.zeros(n, bool)
    x, y = rings.centres()
    order = np.lexsort((x, owner))
    span = []
    for bound, side in ((rings.low_x, "right"), (rings.high_x, "left")):
        # places of the bounds among the centres of the same owner
        both = np.lexsort((np.concatenate([np.full(n, 1 if side == "right" else 0), np.full(n, 0 if side == "right" else 1)]), np.concatenate([bound, x]), np.concatenate([owner, owner])))
        passed = np.cumsum(both >= n)
        place = np.empty(2 * n, np.int64)
        place[both] = passed
        span.append(place[:n])
    begin, end = span
    count = np.where(rings.full, np.maximum(end - begin, 0), 0)
    total = np.cumsum(count)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs_at_once, "right")))
        own = count[at:stop]
        a = np.repeat(np.arange(at, stop), own)
        b = order[np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own) + begin[a]]
        fits = (a != b) & rings.full[b] & (area[a] > area[b] * times) & (y[b] > rings.low_y[a]) & (y[b] < rings.high_y[a])
        a, b = a[fits], b[fits]
        sure = rings.box[a]
        out[a[sure]] = True
        for p, q in zip(a[~sure].tolist(), b[~sure].tolist()):
            if not out[p]:
                out[p] = contains(rings.ring(p), float(x[q]), float(y[q]), eps=0.0)
        at = stop
    return out


def common_sides(a: Rings, b: Rings) -> tuple[np.ndarray, np.ndarray]:
    """Widths and heights of the common boxes, at least 0."""
    w = np.minimum(a.high_x, b.high_x) - np.maximum(a.low_x, b.low_x)
    h = np.minimum(a.high_y, b.high_y) - np.maximum(a.low_y, b.low_y)
    return np.maximum(w, 0), np.maximum(h, 0)


def common_areas(a: Rings, b: Rings) -> np.ndarray:
    """common_area of pairs of rings; rectangles along the axes by their sides."""
    w, h = common_sides(a, b)
    out = np.where((w > 0) & (h > 0), w * h, 0.0)
    for k in np.flatnonzero((out > 0) & ~(a.box & b.box)).tolist():
        out[k] = common_area(a.ring(k), b.ring(k))
    return out


def covered_lengths(a: Rings, b: Rings, eps: float = 1e-9) -> np.ndarray:
    """covered_length of pairs of rings; of rectangles along the axes each side's part within the other's box."""
    out = _covered_of_boxes(a, b, eps)
    for k in np.flatnonzero(~(a.box & b.box)).tolist():
        out[k] = covered_length(a.ring(k), b.ring(k)) if a.full[k] and b.full[k] else 0.0
    return out


def contains(ring, x: float, y: float, border: bool = False, eps: float = 1e-9) -> bool:
    """Whether a point lies strictly inside, or with border also on the line."""
    odd = False
    n = len(ring)
    for k in range(n):
        (ax, ay), (bx, by) = ring[k], ring[(k + 1) % n]
        dx, dy = bx - ax, by - ay
        size = math.hypot(dx, dy)
        if size and abs(dx * (y - ay) - dy * (x - ax)) <= eps * size and -eps * size <= (x - ax) * dx + (y - ay) * dy <= size * size + eps * size:
            return border
        if (ay > y) != (by > y) and x < dx * (y - ay) / dy + ax:
            odd = not odd
    return odd


def faces(edges: list[tuple[float, float, float, float]]) -> list[tuple[list[Point], float]]:
    """(counter-clockwise ring, area without holes) of every bounded face of noded edges; dangling and bridging edges bound none.

    At the end of a half-edge the walk turns to the next outgoing half-edge clockwise from the way back, so every face lies on
    the left of its border.
    """
    live = {(a, b) if a < b else (b, a) for x0, y0, x1, y1 in edges if (a := (x0, y0)) != (b := (x1, y1))}
    while True:
        around: dict[Point, list[Point]] = defaultdict(list)
        for a, b in live:
            around[a].append(b)
            around[b].append(a)
        loose = [v for v, near in around.items() if len(near) == 1]
        while loose:
            v = loose.pop()
            if len(around[v]) != 1:
                continue
            (w,) = around[v]
            around[v].clear()
            around[w].remove(v)
            live.discard((v, w) if v < w else (w, v))
            if len(around[w]) == 1:
                loose.append(w)
        turn: dict[tuple[Point, Point], Point] = {}
        for v, near in around.items():
            near.sort(key=lambda w: math.atan2(w[1] - v[1], w[0] - v[0]))
            for k, w in enumerate(near):
                turn[w, v] = near[k - 1]
        orbit: dict[tuple[Point, Point], int] = {}
        rings: list[list[Point]] = []
        for begin in sorted(turn):
            if begin in orbit:
                continue
            ring, half = [], begin
            while half not in orbit:
                orbit[half] = len(rings)
                ring.append(half[0])
                half = (half[1], turn[half])
            rings.append(ring)
        bridges = {e for e in live if orbit[e] == orbit[e[1], e[0]]}
        if not bridges:
            break
        live -= bridges
    areas = [ring_area(r) for r in rings]
    outer = [k for k, a in enumerate(areas) if a > 1e-12]
    hull_of = [k for k, a in enumerate(areas) if a < -1e-12]
    net = {k: areas[k] for k in outer}
    if len(hull_of) > 1:  # several components: one may lie in a face of another
        points = {k: set(rings[k]) for k in outer}
        for h in hull_of:
            x, y = rings[h][0]
            around_it = [k for k in outer if (x, y) not in points[k] and areas[k] > -areas[h] and contains(rings[k], x, y)]
            if around_it:
                k = min(around_it, key=areas.__getitem__)
                net[k] += areas[h]
    return [(rings[k], net[k]) for k in outer]


def ordered(group: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Places by group (numbers below size), then by value; equal ones in any order. Small numbers are sorted by their digits."""
    order = np.argsort(value)
    own = group[order]
    return order[np.argsort(own.astype(np.uint16) if size <= 1 << 16 else own, kind="stable")]


def numbered_points(who: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense ranks of points by owner, x and y, and the owners and points by rank."""
    ranks = [np.unique(points[:, k], return_inverse=True)[1] for k in (0, 1)]
    sizes = [int(r.max(initial=-1)) + 1 for r in ranks]
    if (int(who.max(initial=0)) + 1) * sizes[0] * sizes[1] < 1 << 62:
        order = np.argsort((who * sizes[0] + ranks[0]) * sizes[1] + ranks[1])
    else:
        order = np.lexsort((points[:, 1], points[:, 0], who))
    own, at = who[order], points[order]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1]).any(axis=1)
    number = np.empty(len(who), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, own[fresh], at[fresh]


def faces_many(owner: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """faces() of the noded edges of many drawings (ascending owners): owners, rings from their smallest points on, areas. Edges
    may come more than once.

    Every edge is two half-edges. Following half-edges to the next one of their face doubles the way in each step, so the number
    of steps grows with the logarithm of the longest face only. Drawings of several components go to faces(), as one may lie in
    a face of another.
    """
    e = len(edges)
    number, vowner, points = numbered_points(np.tile(owner, 2), np.concatenate([edges[:, :2], edges[:, 2:]]))
    vx, vy = points[:, 0].copy(), points[:, 1].copy()
    a, b = np.minimum(number[:e], number[e:]), np.maximum(number[:e], number[e:])
    keys = np.sort((a * max(len(vx), 1) + b)[a != b])
    keys = keys[np.diff(keys, prepend=-1) != 0]
    a, b = np.divmod(keys, max(len(vx), 1))
    live = np.arange(len(keys))
    while True:
        while len(live):
            degree = np.bincount(a[live], minlength=len(vx)) + np.bincount(b[live], minlength=len(vx))
            loose = (degree[a[live]] == 1) | (degree[b[live]] == 1)
            if not loose.any():
                break
            live = live[~loose]
        origin, to = np.concatenate([a[live], b[live]]), np.concatenate([b[live], a[live]])
        m = len(origin)
        half = np.argsort(origin * max(len(vx), 1) + to)
        origin, to = origin[half], to[half]
        place = np.empty(m, np.int64)
        place[half] = np.arange(m)
        twin = np.empty(m, np.int64)
        twin[place] = np.concatenate([place[m // 2 :], place[: m // 2]])
        angle = np.arctan2(vy[to] - vy[origin], vx[to] - vx[origin])
        around = ordered(origin, angle, len(vx))
        if ((origin[around][1:] == origin[around][:-1]) & (angle[around][1:] == angle[around][:-1])).any():
            around = np.lexsort((angle, origin))
        at = np.empty(m, np.int64)
        at[around] = np.arange(m)
        begin = np.flatnonzero(np.diff(origin, prepend=-1))
        degree = np.diff(np.append(begin, m))
        first, last = np.repeat(begin, degree), np.repeat(begin + degree - 1, degree)
        before = around[np.where(at == first, last, at - 1)]
        follow = before[twin]
        face, jump = np.arange(m), follow
        while True:
            lower = np.minimum(face, face[jump])
            if np.array_equal(lower, face):
                break
            face, jump = lower, jump[jump]
        bridging = face == face[twin]
        if not bridging.any():
            break
        drop = np.zeros(m, bool)
        drop[np.flatnonzero(bridging)] = True
        live = live[~drop[place[: m // 2]]]
    x, y = vx[origin], vy[origin]
    steps, jump = np.ones(m, np.int64), follow.copy()
    start = face == np.arange(m)
    steps[start], jump[start] = 0, np.flatnonzero(start)
    while steps.any():
        further = steps[jump]
        if not further.any():
            break
        steps, jump = steps + further, jump[jump]
    size = np.bincount(face, minlength=m)
    order = np.argsort(face * (m + 1) + np.where(start, 0, size[face] - steps))
    begin = np.flatnonzero(np.diff(face[order], prepend=-1))
    ends = np.append(begin, m)
    px, py = x[order], y[order]
    nxt = np.arange(1, m + 1)
    nxt[ends[1:] - 1] = begin
    areas = np.add.reduceat(px * py[nxt] - px[nxt] * py, begin) / 2 if m else np.zeros(0)
    of = vowner[origin[order[begin]]] if m else np.zeros(0, np.int64)
    many = np.bincount(of[areas < -1e-12], minlength=int(owner.max(initial=-1)) + 1) > 1
    good = np.flatnonzero((areas > 1e-12) & ~many[of])
    count = np.diff(ends)[good]
    take = np.repeat(begin[good] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    rings = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count], dtype=np.int32) if len(count) else np.zeros(1, np.int32)), pa.StructArray.from_arrays([pa.array(px[take]), pa.array(py[take])], ["x", "y"]))
    of, areas = of[good], areas[good]
    if many.any():
        more = [(own, ring, area) for own in np.flatnonzero(many).tolist() for ring, area in faces(edges[np.searchsorted(owner, own, "left") : np.searchsorted(owner, own, "right")].tolist())]
        flat, own_ends = [], [0]
        for _, ring, _ in more:
            k = min(range(len(ring)), key=ring.__getitem__)
            flat += ring[k:] + ring[:k]
            own_ends.append(len(flat))
        flat = np.array(flat, float).reshape(-1, 2)
        added = pa.ListArray.from_arrays(pa.array(own_ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]))
        rings, of, areas = pa.concat_arrays([rings, added]), np.concatenate([of, [m[0] for m in more]]).astype(np.int64), np.concatenate([areas, [m[2] for m in more]])
    order = np.argsort(of, kind="stable")
    return of[order], rings.take(pa.array(order)), areas[order]


def cycle_basis(edges: list[tuple[float, float, float, float]]) -> list[list[Point]]:
    """Fundamental cycles of a breadth-first spanning forest, from the smallest point on."""
    around: dict[Point, set[Point]] = defaultdict(set)
    for x0, y0, x1, y1 in edges:
        if (x0, y0) != (x1, y1):
            around[x0, y0].add((x1, y1))
            around[x1, y1].add((x0, y0))
    parent: dict[Point, Point | None] = {}
    depth: dict[Point, int] = {}
    out = []
    for root in sorted(around):
        if root in parent:
            continue
        parent[root], depth[root] = None, 0
        queue, tree = [root], set()
        for v in queue:
            for w in sorted(around[v]):
                if w not in parent:
                    parent[w], depth[w] = v, depth[v] + 1
                    tree.add((v, w) if v < w else (w, v))
                    queue.append(w)
        for v in queue:
            for w in sorted(around[v]):
                if v < w and (v, w) not in tree:
                    left, right = [v], [w]
                    while left[-1] != right[-1]:
                        side = left if depth[left[-1]] >= depth[right[-1]] else right
                        side.append(parent[side[-1]])
                    out.append(left + right[-2::-1])
    return out


def is_simple(ring) -> bool:
    """Whether a ring's line neither touches nor crosses itself."""
    n = len(ring)
    if n < 3 or len(set(ring)) < n:
        return False
    sides = [(*ring[k], *ring[(k + 1) % n]) for k in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            met = meeting_points(sides[i], sides[j])
            near = j == i + 1 or (i == 0 and j == n - 1)
            if not near and met:
                return False
            if near and len(set(met)) > 1:  # one side runs back along the other
                return False
    return True


def chains(edges: list[tuple[float, float, float, float]]) -> list[list[Point]]:
    """Lines made of edges that are joined at every point where exactly two meet, in the order of their first points."""
    around: dict[Point, list[Point]] = defaultdict(list)
    for ax, ay, bx, by in sorted(set(edges)):
        around[ax, ay].append((bx, by))
        around[bx, by].append((ax, ay))
    used: set[frozenset] = set()
    out = []

    def walk(begin: Point, to: Point) -> list[Point]:
        line = [begin]
        while frozenset((line[-1], to)) not in used:
            used.add(frozenset((line[-1], to)))
            line.append(to)
            if len(around[to]) != 2:
                break
            to = next((p for p in around[to] if p != line[-2]), line[-2])
        return line

    points = sorted(around)
    for point in [p for p in points if len(around[p]) != 2] + points:
        for to in sorted(around[point]):
            if frozenset((point, to)) not in used:
                out.append(walk(point, to))
    return out


def hull(ring) -> list[Point]:
    """Counter-clockwise convex hull."""
    points = sorted({(float(x), float(y)) for x, y in ring})
    if len(points) < 3:
        return points

    def half(order) -> list[Point]:
        out: list[Point] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def rotated_sides(ring) -> tuple[float, float]:
    """(longer, shorter) side of the rectangle of least area around a ring, by its hull's edges."""
    h = np.array(hull(ring))
    if len(h) < 3:
        d = float(np.hypot(*np.ptp(h, axis=0))) if len(h) else 0.0
        return d, 0.0
    d = np.roll(h, -1, axis=0) - h
    d = d / np.hypot(d[:, 0], d[:, 1])[:, None]
    along, across = h @ d.T, h @ np.stack([-d[:, 1], d[:, 0]])
    a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
    k = int(np.argmin(a * b))
    return float(max(a[k], b[k])), float(min(a[k], b[k]))


def _clip(subject: list[Point], window: list[Point]) -> list[Point]:
    """A convex subject cut to a convex counter-clockwise window."""
    out = subject
    for k in range(len(window)):
        (ax, ay), (bx, by) = window[k - 1], window[k]
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        new: list[Point] = []
        for i in range(len(out)):
            p, q, s, t = out[i - 1], out[i], side[i - 1], side[i]
            if (s < 0) != (t < 0):
                u = s / (s - t)
                new.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
            if t >= 0:
                new.append(q)
        out = new
        if not out:
            return out
    return out


def common_area(a, b) -> float:
    """Area of the intersection of two simple rings: signed triangle fans, cut pair by pair."""

    def box(r):
        xs, ys = zip(*r)
        return min(xs), min(ys), max(xs), max(ys)

    def is_box(r, e) -> bool:
        return len(r) == 4 and {tuple(p) for p in r} == {(e[0], e[1]), (e[2], e[1]), (e[2], e[3]), (e[0], e[3])}

    p, q = box(a), box(b)
    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
    if w <= 0 or h <= 0:
        return 0.0
    if is_box(a, p) and is_box(b, q):
        return w * h

    def fan(r):
        for k in range(1, len(r) - 1):
            t = [tuple(r[0]), tuple(r[k]), tuple(r[k + 1])]
            s = ring_area(t)
            if s:
                yield (t if s > 0 else t[::-1]), math.copysign(1.0, s)

    total = 0.0
    second = list(fan(b))
    for t, s in fan(a):
        for u, v in second:
            cut = _clip(t, u)
            if len(cut) > 2:
                total += s * v * ring_area(cut)
    return abs(total)


def covered_length(ring, other) -> float:
    """Length of the other ring's line that lies inside or on a ring."""
    total = 0.0
    n, m = len(ring), len(other)
    for k in range(m):
        (ax, ay), (bx, by) = other[k], other[(k + 1) % m]
        dx, dy = bx - ax, by - ay
        size = math.hypot(dx, dy)
        if size < 1e-12:
            continue
        cuts = {0.0, 1.0}
        for i in range(n):
            (px, py), (qx, qy) = ring[i], ring[(i + 1) % n]
            ex, ey = qx - px, qy - py
            cross = dx * ey - dy * ex
            if abs(cross) > 1e-12:
                t, u = ((px - ax) * ey - (py - ay) * ex) / cross, ((px - ax) * dy - (py - ay) * dx) / cross
                if -1e-9 <= u <= 1 + 1e-9 and 0 < t < 1:
                    cuts.add(t)
            for x, y in ((px, py), (qx, qy)):
                if abs(dx * (y - ay) - dy * (x - ax)) <= 1e-9 * size and 0 < (t := ((x - ax) * dx + (y - ay) * dy) / (size * size)) < 1:
                    cuts.add(t)
        steps = sorted(cuts)
        for s, t in zip(steps, steps[1:]):
            mid = (s + t) / 2
            if (t - s) * size > 1e-12 and contains(ring, ax + mid * dx, ay + mid * dy, border=True):
                total += (t - s) * size
    return total


def ring_gap(a, b) -> float:
    """Distance of two rings' areas; 0 if they touch or overlap."""
    if any(contains(a, x, y, True) for x, y in b) or any(contains(b, x, y, True) for x, y in a):
        return 0.0

    def to_line(points, ring) -> float:
        p, q = np.asarray(ring, float), np.roll(np.asarray(ring, float), -1, axis=0)
        d = q - p
        norm = np.maximum((d**2).sum(axis=1), 1e-18)
        x = np.asarray(points, float)[:, None, :]
        t = np.clip(((x - p) * d).sum(axis=2) / norm, 0, 1)
        return float(np.hypot(*np.moveaxis(p + t[:, :, None] * d - x, 2, 0)).min())

    return 0.0 if common_area(a, b) > 0 else min(to_line(a, b), to_line(b, a))


def union_rings(rings: list[list[Point]]) -> list[tuple[list[Point], float]]:
    """Outer rings and areas of the union of rings: all are noded together, and faces are joined where they share an edge."""
    edges = node([(*r[k - 1], *r[k]) for r in rings for k in range(len(r))])
    cells = [(ring, area) for ring, area in faces(edges) if any(contains(r, *_inner_point(ring), border=True) for r in rings)]
    owner: dict[frozenset, int] = {}
    label = list(range(len(cells)))

    def root(k: int) -> int:
        while label[k] != k:
            k = label[k]
        return k

    half: dict[tuple[Point, Point], int] = {}
    for k, (ring, _) in enumerate(cells):
        for i in range(len(ring)):
            e = frozenset((ring[i - 1], ring[i]))
            half[ring[i - 1], ring[i]] = k
            if e in owner:
                label[max(root(owner[e]), root(k))] = min(root(owner[e]), root(k))
            owner.setdefault(e, k)
    out = []
    for k in sorted({root(k) for k in range(len(cells))}):
        border = [(*a, *b) for (a, b), c in half.items() if root(c) == k and (b, a) not in half]
        whole = max(faces(border), key=lambda f: ring_area(f[0]))[0]
        out.append((whole, sum(cells[c][1] for c in range(len(cells)) if root(c) == k)))
    return out


def _inner_point(ring: list[Point]) -> Point:
    """A point strictly inside a simple ring."""
    c = ring_centroid(ring)
    if contains(ring, *c):
        return c
    for k in range(len(ring)):
        t = [ring[k - 1], ring[k], ring[(k + 1) % len(ring)]]
        c = (sum(p[0] for p in t) / 3, sum(p[1] for p in t) / 3)
        if contains(ring, *c) and ring_area(t) > 0 and not any(contains(t, *p) for p in ring):
            return c
    return c


def node(segments: list[tuple[float, float, float, float]], digits: int = 9) -> list[tuple[float, float, float, float]]:
    """Segments cut at each other; points are rounded, edges come once and in one direction."""
    s = np.asarray(segments, float).reshape(-1, 4)
    cuts: list[set[Point]] = [{(a, b), (c, d)} for a, b, c, d in s.tolist()]
    low, high = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    for i in range(len(s) - 1):
        near = i + 1 + np.flatnonzero(((low[i + 1 :] <= high[i] + 1e-9) & (high[i + 1 :] >= low[i] - 1e-9)).all(axis=1))
        ax, ay, bx, by = s[i].tolist()
        for j in near.tolist():
            points = meeting_points((ax, ay, bx, by), tuple(s[j].tolist()))
            cuts[i].update(points)
            cuts[j].update(points)
    out = set()
    for (ax, ay, bx, by), points in zip(s.tolist(), cuts):
        order = sorted({(round(x, digits) + 0.0, round(y, digits) + 0.0) for x, y in points}, key=lambda p: ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay), p))
        out.update((*min(p, q), *max(p, q)) for p, q in zip(order, order[1:]) if p != q)
    return sorted(out)


def reaching(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For spans sorted by (owner, begin): the place after the last span of the same owner that begins at a span's end or before;
    a few later ones may be counted in, as owners and places go into one number."""
    if not len(owner):
        return np.zeros(0, np.int64)
    least = begin.min()
    span = max(begin.max(), end.max()) - least + 1.0
    key = owner * span + (begin - least)
    slack = 1e-12 * (abs(float(key[-1])) + span) + 1e-9
    found = np.searchsorted(np.maximum.accumulate(key), owner * span + (end - least) + slack, "right")
    place = np.arange(len(owner))
    return np.maximum(np.minimum(found, np.searchsorted(owner, owner, "right")), place + 1)


def node_many(owner: np.ndarray, s: np.ndarray, digits: int = 9, pairs_at_once: int = 1 << 20, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """node() for the segments (x0, y0, x1, y1) of many drawings at once, sorted by owner: owners and edges, sorted likewise; if
    not distinct, sorted by owner only and as often as segments run there."""
    seg, edges = cut_edges(s, *cut_points(owner, s, pairs_at_once), digits)
    who = owner[seg]
    if not distinct:
        return who, edges
    order = np.lexsort((edges[:, 3], edges[:, 2], edges[:, 1], edges[:, 0], who))
    edges, who = edges[order], who[order]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (edges[1:] != edges[:-1]).any(axis=1)
    return who[fresh], edges[fresh]


def cut_points(owner: np.ndarray, s: np.ndarray, pairs_at_once: int = 1 << 20, counts: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments by place (sorted by owner), x and y of their ends and of all points where they meet others of their owner. counts
    tells which pairs are to be compared, by places; without it all."""
    n = len(s)
    low, high = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    by_x = np.lexsort((low[:, 0], owner))
    count = reaching(owner[by_x], low[by_x, 0], high[by_x, 0] + 1e-9) - np.arange(n) - 1
    total = np.cumsum(count)
    seg, px, py = [np.arange(n), np.arange(n)], [s[:, 0], s[:, 2]], [s[:, 1], s[:, 3]]
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs_at_once, "right")))
        own = count[at:stop]
        i = np.repeat(np.arange(at, stop), own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
        i, j = by_x[i], by_x[j]
        near = ((low[j] <= high[i] + 1e-9) & (high[j] >= low[i] - 1e-9)).all(axis=1)
        if counts is not None:
            near &= counts(i, j)
        i, j = np.minimum(i[near], j[near]), np.maximum(i[near], j[near])
        which, x, y = _meetings(s[i], s[j])
        for k in (i, j):
            seg.append(k[which])
            px.append(x)
            py.append(y)
        at = stop
    return np.concatenate(seg), np.concatenate(px), np.concatenate(py)


def cut_edges(s: np.ndarray, seg: np.ndarray, x: np.ndarray, y: np.ndarray, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Segments by place, ascending, and their edges between the points on them (a before b)."""
    x, y = np.round(x, digits) + 0.0, np.round(y, digits) + 0.0
    t = (x - s[seg, 0]) * (s[seg, 2] - s[seg, 0]) + (y - s[seg, 1]) * (s[seg, 3] - s[seg, 1])
    order = ordered(seg, t, len(s))
    moved = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    follows = (seg[order][1:] == seg[order][:-1]) & moved
    if (follows & (t[order][1:] == t[order][:-1])).any():
        order = np.lexsort((y, x, t, seg))
        follows = (seg[order][1:] == seg[order][:-1]) & ((x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]))
    seg, x, y = seg[order], x[order], y[order]
    a, b = np.flatnonzero(follows), np.flatnonzero(follows) + 1
    first = (x[a] < x[b]) | ((x[a] == x[b]) & (y[a] < y[b]))
    a, b = np.where(first, a, b), np.where(first, b, a)
    return seg[a], np.stack([x[a], y[a], x[b], y[b]], axis=1)


def _meetings(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """meeting_points of pairs of segments: number of the pair, x, y of each point."""
    which, xs, ys = [], [], []
    touched = np.zeros(len(a), bool)
    for s, t in ((a, b), (b, a)):
        dx, dy = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
        size = np.hypot(dx, dy)
        for x, y in ((t[:, 0], t[:, 1]), (t[:, 2], t[:, 3])):
            along = (x - s[:, 0]) * dx + (y - s[:, 1]) * dy
            on = (np.abs(dx * (y - s[:, 1]) - dy * (x - s[:, 0])) <= eps * size) & (along >= -eps * size) & (along <= size * (size + eps))
            which.append(np.flatnonzero(on))
            xs.append(x[on])
            ys.append(y[on])
            touched |= on
    dx, dy, ex, ey = a[:, 2] - a[:, 0], a[:, 3] - a[:, 1], b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    cross = dx * ey - dy * ex
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((b[:, 0] - a[:, 0]) * ey - (b[:, 1] - a[:, 1]) * ex) / cross
        u = ((b[:, 0] - a[:, 0]) * dy - (b[:, 1] - a[:, 1]) * dx) / cross
        proper = ~touched & (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    which.append(np.flatnonzero(proper))
    xs.append((a[:, 0] + t * dx)[proper])
    ys.append((a[:, 1] + t * dy)[proper])
    return np.concatenate(which), np.concatenate(xs), np.concatenate(ys)


def meeting_points(a: tuple[float, float, float, float], b: tuple[float, float, float, float], eps: float = 1e-9) -> list[Point]:
    """Points where two segments meet: ends of one on the other, and a proper crossing."""

    def on(s, x, y) -> bool:
        dx, dy = s[2] - s[0], s[3] - s[1]
        size = math.hypot(dx, dy)
        return abs(dx * (y - s[1]) - dy * (x - s[0])) <= eps * size and -eps * size <= (x - s[0]) * dx + (y - s[1]) * dy <= size * (size + eps)

    found = [(x, y) for s, t in ((a, b), (b, a)) for x, y in ((t[0], t[1]), (t[2], t[3])) if on(s, x, y)]
    if not found:
        dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
        cross = dx * ey - dy * ex
        if cross:
            t = ((b[0] - a[0]) * ey - (b[1] - a[1]) * ex) / cross
            u = ((b[0] - a[0]) * dy - (b[1] - a[1]) * dx) / cross
            if 0 < t < 1 and 0 < u < 1:
                found.append((a[0] + t * dx, a[1] + t * dy))
    return found
