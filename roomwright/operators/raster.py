"""Rooms from pictures: walls are drawn into a small image, thickened, and the enclosed areas traced.

Like the picture library this stands in for, but not pixel by pixel: compare counts and overlaps, not corners. The outside is
what the fill from pixel (0, 0) reaches; if a wall covers that pixel, the fill takes the walls instead (pad=True adds a
free border and avoids that).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import RING
from . import kernel
from .drawings import ring_array, stream_arrays
from .floors import ranks
from .walls import bridges

ROOM = f"raster_no long, ring {RING}, area_raw double"


def draw(segments: np.ndarray, width: int, height: int, stroke: int) -> np.ndarray:
    """Walls (x0, y0, x1, y1 in pixels) as a boolean image, each `stroke` pixels wide."""
    image = np.zeros((height, width), bool)
    for x0, y0, x1, y1 in segments.tolist():
        n = math.ceil(max(abs(x1 - x0), abs(y1 - y0))) + 1
        xs, ys = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        for i in range(stroke):
            for j in range(stroke):
                image[np.clip(ys - j, 0, height - 1), np.clip(xs - i, 0, width - 1)] = True
    return image


def dilated(image: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(image, 1)
        rows = p[:-2] | p[1:-1] | p[2:]
        image = rows[:, :-2] | rows[:, 1:-1] | rows[:, 2:]
    return image


def closed(image: np.ndarray, times: int = 2) -> np.ndarray:
    return ~dilated(~dilated(np.pad(image, times + 1), times), times)[times + 1 : -times - 1, times + 1 : -times - 1]


def labelled(free: np.ndarray) -> np.ndarray:
    """Numbers of 4-connected areas, from 1; 0 elsewhere. Runs of each row are joined with those of the row above."""
    height, width = free.shape
    flat = np.zeros((height, width + 1), np.int8)
    flat[:, :width] = free
    step = np.diff(flat.ravel(), prepend=0)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    parent = np.arange(len(begin))
    above_from, above_to = np.searchsorted(end, begin - width - 1, "right"), np.searchsorted(begin, end - width - 1, "left")
    count = np.maximum(above_to - above_from, 0)
    low = np.repeat(np.arange(len(begin)), count)
    high = np.arange(len(low)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(above_from, count)
    while len(low):  # the smaller number of each pair of touching runs spreads until all agree
        a, b = parent[low], parent[high]
        differ = a != b
        if not differ.any():
            break
        low, high, a, b = low[differ], high[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jump := parent[parent], parent):
            parent = jump
    out = np.zeros(height * (width + 1), np.int64)
    out[begin] = parent + 1
    out[end] -= parent + 1
    return np.cumsum(out).reshape(height, width + 1)[:, :width]


def outline(area: np.ndarray) -> list[tuple[int, int]]:
    """Pixels of an area's outer border in order (x, y), by following its boundary from the first pixel on."""
    height, width = area.shape
    y0, x0 = divmod(int(np.argmax(area)), width)
    steps = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    x, y, back = x0, y0, 4
    out = [(x, y)]
    for _ in range(4 * area.size):
        for turn in range(1, 9):
            k = (back + turn) % 8
            u, v = x + steps[k][0], y + steps[k][1]
            if 0 <= u < width and 0 <= v < height and area[v, u]:
                x, y, back = u, v, (k + 4) % 8 if k % 2 == 0 else (k + 4) % 8
                break
        else:
            return out
        if (x, y) == (x0, y0) and len(out) > 1:
            return out
        out.append((x, y))
    return out


def simplified(points: list[tuple[int, int]], slack: float) -> list[tuple[int, int]]:
    """A closed line with fewer points, none further than slack from the old line."""
    if len(points) < 4:
        return points
    p = np.array(points, float)
    far = int(np.hypot(*(p - p[0]).T).argmax())
    keep = {0, far}
    todo = [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        start, end = p[a], p[b % len(p)]
        d = end - start
        size = math.hypot(*d)
        own = p[a + 1 : b]
        off = np.abs(d[0] * (own[:, 1] - start[1]) - d[1] * (own[:, 0] - start[0])) / size if size else np.hypot(*(own - start).T)
        k = int(off.argmax())
        if off[k] > slack:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[k] for k in sorted(keep)]


def picture_rooms(segments: list[tuple[float, float, float, float]], longest: int, stroke: int, least: float, pad: bool) -> list[tuple[list[tuple[float, float]], float]]:
    """(ring, area) of one drawing's rooms in drawing units."""
    s = np.asarray(segments, float).reshape(-1, 4)
    x0, y0 = s[:, [0, 2]].min(), s[:, [1, 3]].min()
    w, h = max(s[:, [0, 2]].max() - x0, 1e-9), max(s[:, [1, 3]].max() - y0, 1e-9)
    scale = longest / max(w, h)
    width, height = max(math.ceil(w * scale), 4), max(math.ceil(h * scale), 4)
    px = np.empty_like(s)
    px[:, [0, 2]] = np.clip(np.trunc((s[:, [0, 2]] - x0) / w * (width - 1)), 0, width - 1)
    px[:, [1, 3]] = np.clip(np.trunc(height - 1 - (s[:, [1, 3]] - y0) / h * (height - 1)), 0, height - 1)
    walls = closed(dilated(draw(px, width, height, stroke)))
    free = ~(np.pad(walls, 1) if pad else walls)
    areas = labelled(free)
    if free[0, 0]:
        areas[areas == areas[0, 0]] = 0
    if pad:
        areas = areas[1:-1, 1:-1]
    out = []
    for k in np.unique(areas[areas > 0]):
        ys, xs = np.nonzero(areas == k)
        mask = areas[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] == k
        out += _traced_room(mask, int(xs.min()), int(ys.min()), (x0, y0, w, h), width, height, stroke, least)
    return out


def _traced_room(mask: np.ndarray, left: int, top: int, box: tuple[float, float, float, float], width: int, height: int, stroke: int, least: float) -> list[tuple[list[tuple[float, float]], float]]:
    """The (ring, area) of an area of a picture in drawing units, or nothing if it is no room. box: the picture's x, y, width, height."""
    x0, y0, w, h = box
    border = outline(mask)
    if len(border) < 3 or abs(kernel.ring_area(border)) < max(16.0, (3 * stroke) ** 2):
        return []
    ring = simplified(border, 0.01 * kernel.ring_length(border))
    if len(ring) < 3:
        return []
    real = [(x0 + (x + left) / max(width - 1, 1) * w, y0 + (1 - (y + top) / max(height - 1, 1)) * h) for x, y in ring]
    area, around = kernel.ring_area(real), kernel.ring_length(real)
    if area < 0:
        real, area = real[::-1], -area
    rx, ry = zip(*real)
    sides = max(max(rx) - min(rx), 1e-9), max(max(ry) - min(ry), 1e-9)
    return [(real, area)] if area >= least and 4 * math.pi * area / (around * around) >= 0.08 and max(sides) / min(sides) <= 8 else []


def _stacked(owner: np.ndarray, rects: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rectangles of pixels (left, top, right, bottom); those of the same columns that touch or overlap become one."""
    order = np.lexsort((rects[:, 1], rects[:, 2], rects[:, 0], owner))
    owner, rects = owner[order], rects[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (rects[1:, 0] != rects[:-1, 0]) | (rects[1:, 2] != rects[:-1, 2])
    span = int(rects[:, 3].max(initial=0)) + 3
    reach = np.maximum.accumulate(np.cumsum(new) * span + rects[:, 3]) - np.cumsum(new) * span
    new[1:] |= rects[1:, 1] > reach[:-1] + 1
    first = np.flatnonzero(new)
    out = rects[first]
    if len(first):
        out[:, 3] = np.maximum.reduceat(rects[:, 3], first)
    return owner[first], out


def _axis(owner: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[drawing, place]: the pixels, ascending, at which something may change along an axis when walls (low to high) are closed;
    the last ones repeat."""
    n = len(size)
    own = np.concatenate([np.tile(owner, 4), np.tile(np.arange(n), 4)])
    at = np.concatenate([low - 2, low, high + 1, high + 3, np.full(n, -3), np.zeros(n, np.int64), size, size + 3])
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
    own, at = own[fresh], at[fresh]
    count = np.bincount(own, minlength=n)
    out = np.repeat((size + 3)[:, None], count.max(), axis=1)
    out[own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)] = at
    return out


def _places(axis: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of pixels on their drawings' axes."""
    span = int(axis[:, -1].max()) + 8
    flat = (axis + 4 + np.arange(len(axis))[:, None] * span).ravel()
    return np.searchsorted(flat, at + 4 + owner * span) - owner * axis.shape[1]


def _grown(free: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Free cells [drawing, cell, line] grown by two pixels along the middle dimension, whose cells begin at the axis's pixels."""
    n, m = axis.shape
    who = np.repeat(np.arange(n), m - 1)
    span = int(axis[:, -1].max()) + 8
    flat = (axis + 4 + np.arange(n)[:, None] * span).ravel()
    begin, end = axis[:, :-1].ravel() + 4 + who * span, axis[:, 1:].ravel() + 4 + who * span
    low = np.maximum(np.searchsorted(flat, end - 2, "left") - who * m - 1, 0).reshape(n, m - 1)
    high = np.minimum(np.searchsorted(flat, begin + 2, "right") - who * m, m - 1).reshape(n, m - 1)
    total = np.zeros((n, m, free.shape[2]), np.int32)
    np.cumsum(free, axis=1, out=total[:, 1:])
    row = np.arange(n)[:, None]
    return total[row, np.maximum(high, low)] > total[row, low]


def _rooms_of_cells(owner: np.ndarray, rects: np.ndarray, xs: np.ndarray, ys: np.ndarray, box: np.ndarray, size: np.ndarray, stroke: int, least: np.ndarray, pad: bool) -> tuple[np.ndarray, list, np.ndarray]:
    """Owners, rings and areas of the rooms of drawings whose walls are rectangles of pixels, dilated already: the same closing,
    labelling and tracing as of pixels, on cells between the pixels at which something changes."""
    n, gx, gy = len(size), xs.shape[1] - 1, ys.shape[1] - 1
    delta = np.zeros((n, gy + 1, gx + 1), np.int32)
    i0, i1, j0, j1 = _places(xs, owner, rects[:, 0] - 2), _places(xs, owner, rects[:, 2] + 3), _places(ys, owner, rects[:, 1] - 2), _places(ys, owner, rects[:, 3] + 3)
    for j, i, v in ((j0, i0, 1), (j0, i1, -1), (j1, i0, -1), (j1, i1, 1)):
        np.add.at(delta, (owner, j, i), v)
    open_ = (delta.cumsum(axis=1).cumsum(axis=2) == 0)[:, :gy, :gx]
    open_ &= (np.diff(ys) > 0)[:, :, None] & (np.diff(xs) > 0)[:, None, :]
    free = _grown(open_, ys)
    free = _grown(free.transpose(0, 2, 1), xs).transpose(0, 2, 1)
    wide, tall = np.diff(xs), np.diff(ys)
    in_x, in_y = (xs[:, :-1] >= 0) & (xs[:, :-1] < size[:, :1]), (ys[:, :-1] >= 0) & (ys[:, :-1] < size[:, 1:])
    inside = in_x[:, None, :] & in_y[:, :, None]
    free = (free | ~inside) if pad else (free & inside)
    tower = np.zeros((n, gy + 1, gx), bool)
    tower[:, :gy] = free
    areas = labelled(tower.reshape(n * (gy + 1), gx)).reshape(n, gy + 1, gx)[:, :gy]
    corner = areas[:, 0, 0] if pad else areas[np.arange(n), np.argmax(in_y, axis=1), np.argmax(in_x, axis=1)]
    areas = np.where(inside & (areas != corner[:, None, None]), areas, 0)
    d, j, i = np.nonzero(areas)
    label = areas[d, j, i]
    names, first, which = np.unique(label, return_index=True, return_inverse=True)
    k = len(names)
    who = d[first]
    least_i, most_i, least_j, most_j = np.full(k, gx), np.full(k, -1), np.full(k, gy), np.full(k, -1)
    for to, of, take in ((least_i, i, np.minimum), (most_i, i, np.maximum), (least_j, j, np.minimum), (most_j, j, np.maximum)):
        take.at(to, which, of)
    pixels = np.bincount(which, weights=wide[d, i] * tall[d, j], minlength=k)
    left, right, top, bottom = xs[who, least_i], xs[who, most_i + 1] - 1, ys[who, least_j], ys[who, most_j + 1] - 1
    a, b = right - left, bottom - top
    straight = pixels == (a + 1) * (b + 1)
    x0, y0, w, h = box[who].T
    width, height = np.maximum(size[who] - 1, 1).T
    large = a * b >= max(16.0, (3 * stroke) ** 2)
    large &= a * b / np.maximum(np.hypot(a, b), 1e-9) > 0.01 * (2 * (a + b))
    px, py = (np.stack(v) for v in ((left, left + a, left + a, left), (top, top, top + b, top + b)))
    px, py = x0 + px / width * w, y0 + (1 - py / height) * h
    nx, ny = np.roll(px, -1, axis=0), np.roll(py, -1, axis=0)
    t, g = px * ny - nx * py, np.hypot(nx - px, ny - py)
    area, around = (t[0] + t[1] + t[2] + t[3]) / 2, g[0] + g[1] + g[2] + g[3]
    turned = area < 0
    px, py, area = np.where(turned, px[::-1], px), np.where(turned, py[::-1], py), np.abs(area)
    long, short = (f(np.maximum(np.ptp(px, axis=0), 1e-9), np.maximum(np.ptp(py, axis=0), 1e-9)) for f in (np.maximum, np.minimum))
    with np.errstate(divide="ignore", invalid="ignore"):
        good = straight & large & (area >= least[who]) & (4 * math.pi * area / (around * around) >= 0.08) & (long / short <= 8)
    good = np.flatnonzero(good)
    rings = [np.stack([px[:, good], py[:, good]], axis=2).transpose(1, 0, 2)]
    places, values, found = [good], [area[good]], list(rings[0])
    for c in np.flatnonzero(~straight).tolist():
        part = areas[who[c], least_j[c] : most_j[c] + 1, least_i[c] : most_i[c] + 1] == names[c]
        mask = part.repeat(tall[who[c], least_j[c] : most_j[c] + 1], axis=0).repeat(wide[who[c], least_i[c] : most_i[c] + 1], axis=1)
        for ring, value in _traced_room(mask, int(left[c]), int(top[c]), tuple(box[who[c]].tolist()), *size[who[c]].tolist(), stroke, float(least[who[c]])):
            places.append(np.array([c]))
            values.append(np.array([value]))
            found.append(np.array(ring))
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return who[place[order]], [found[o] for o in order.tolist()], np.concatenate(values)[order]


def picture_rooms_many(owner: np.ndarray, s: np.ndarray, longest: int, stroke: int, least: np.ndarray, pad: bool, cells_at_once: int = 1 << 20) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """picture_rooms of many drawings (ascending owners): owners, rings, areas. Pictures without slanted walls are not painted:
    their walls are rectangles of pixels, and only the lines at which these begin and end matter. Others are painted one by one."""
    names, first = np.unique(owner, return_index=True)
    which = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(owner))))
    bad = np.logical_or.reduceat(~np.isfinite(s).all(axis=1), first)
    low, high = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    with np.errstate(invalid="ignore"):
        span = np.maximum(high - low, 1e-9)
        size = np.maximum(np.ceil(span * (longest / span.max(axis=1))[:, None]), 4)
        size = np.where(bad[:, None], 4, size).astype(np.int64)
        own = size[which]
        px = np.clip(np.trunc((s[:, ::2] - low[which, :1]) / span[which, :1] * (own[:, :1] - 1)), 0, own[:, :1] - 1)
        py = np.clip(np.trunc(own[:, 1:] - 1 - (s[:, 1::2] - low[which, 1:]) / span[which, 1:] * (own[:, 1:] - 1)), 0, own[:, 1:] - 1)
    slanted = bad | np.logical_or.reduceat((px[:, 0] != px[:, 1]) & (py[:, 0] != py[:, 1]), first)
    flat = np.flatnonzero(~slanted[which])
    px, py, lines, own = px[flat].astype(np.int64), py[flat].astype(np.int64), which[flat], own[flat]
    # drawn with the stroke and dilated by one pixel, within the picture
    ends = [np.maximum(np.maximum(v.min(axis=1) - stroke + 1, 0) - 1, 0) for v in (px, py)] + [np.minimum(v.max(axis=1) + 1, own[:, k] - 1) for k, v in enumerate((px, py))]
    lines, rects = _stacked(lines, np.stack(ends, axis=1).reshape(-1, 4))
    lines, rects = _stacked(lines, rects[:, [1, 0, 3, 2]])
    rects = rects[:, [1, 0, 3, 2]]
    walls = np.bincount(lines, minlength=len(names))
    painted = slanted | (walls > longest // 16)
    box = np.concatenate([low, span], axis=1)
    whos, rings, areas = [], [], []
    todo = np.flatnonzero(~painted)
    todo = todo[np.argsort(walls[todo], kind="stable")]
    at = 0
    begin = np.searchsorted(lines, np.arange(len(names) + 1))
    while at < len(todo):
        stop = at + 1
        while stop < len(todo) and (stop - at + 1) * (4 * walls[todo[stop]] + 4) ** 2 <= cells_at_once and stop - at < 4096:
            stop += 1
        mine = np.sort(todo[at:stop])
        take = np.repeat(begin[mine] - (np.cumsum(walls[mine]) - walls[mine]), walls[mine]) + np.arange(walls[mine].sum())
        who, r = np.repeat(np.arange(len(mine)), walls[mine]), rects[take]
        xs, ys = _axis(who, r[:, 0], r[:, 2], size[mine, 0]), _axis(who, r[:, 1], r[:, 3], size[mine, 1])
        found, ring, area = _rooms_of_cells(who, r, xs, ys, box[mine], size[mine], stroke, least[names[mine]], pad)
        whos.append(names[mine][found])
        rings += ring
        areas.append(area)
        at = stop
    for k in np.flatnonzero(painted).tolist():
        part = slice(first[k], first[k + 1] if k + 1 < len(first) else len(owner))
        for ring, area in picture_rooms(s[part], longest, stroke, float(least[names[k]]), pad):
            whos.append(np.array([names[k]]))
            rings.append(np.array(ring))
            areas.append(np.array([area]))
    if not rings:
        return np.zeros(0, np.int64), ring_array([]), np.zeros(0)
    who = np.concatenate(whos)
    order = np.argsort(who, kind="stable")
    points = np.concatenate(rings)
    offsets = np.cumsum([0, *map(len, rings)], dtype=np.int32)
    column = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
    return who[order], column.take(pa.array(order)), np.concatenate(areas)[order]


def raster_rooms(segments: DataFrame, longest: int = 1024, stroke: int = 2, least_sqft: float = 8.0, sqft: Column | float = 10.7639, pad: bool = False, bridged: Column | float | None = None) -> DataFrame:
    """drawing_id, raster_no, ring, area_raw from all segments of each drawing. sqft: a number, or a column of segments; bridged
    likewise: metres per unit, if door gaps are to be closed first, as noding.with_bridges does."""
    of_rows = {}
    least, metres = least_sqft / max(sqft, 1e-9) if isinstance(sqft, (int, float)) else None, bridged
    if least is None:
        of_rows["least"] = F.lit(least_sqft) / F.greatest(sqft, F.lit(1e-9))
    if metres is not None and not isinstance(metres, (int, float)):
        of_rows["metres"] = metres

    def trace(owner: np.ndarray, columns: dict) -> tuple:
        if not len(owner):
            return owner, [], [], []
        s = np.stack([columns[c] for c in ("sx", "sy", "ex", "ey")], axis=1)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        n = int(owner[-1]) + 1
        smallest, scale = np.zeros(n), np.zeros(n)
        smallest[owner[first]] = np.maximum.reduceat(columns["least"], first) if "least" in columns else least
        if bridged is not None:
            scale[owner[first]] = np.maximum.reduceat(columns["metres"], first) if "metres" in columns else metres
            more, gaps = bridges(owner, s, scale)
            owner, s = np.concatenate([owner, more]), np.concatenate([s, gaps])
            order = np.argsort(owner, kind="stable")
            owner, s = owner[order], s[order]
        who, rings, areas = picture_rooms_many(owner, s, longest, stroke, smallest, pad)
        return who, ranks(who) + 1, rings, areas

    columns = [F.col(c).cast("double").alias(c) for c in ("sx", "sy", "ex", "ey")]
    rows = segments.select("drawing_id", *columns, *[v.cast("double").alias(c) for c, v in of_rows.items()])
    return stream_arrays(rows, trace, ROOM)
