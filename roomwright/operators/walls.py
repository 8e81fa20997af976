"""From segments to rooms in arrays of many drawings: wall layers, bridges, cut and traced walls, and the filters that leave rooms.

The same rooms as layers, noding and rooms give with joins. Segments are compared along x only where their extents meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.shapes import RING
from . import kernel
from .drawings import ring_array, stream_arrays
from .floors import FLOOR, Part, Rooms, block_part, couples, fold_many, furnished, ranks, text_part


def _any(text: str, words) -> bool:
    return any(w in text for w in words)


def kept_layers(owner: np.ndarray, codes: np.ndarray, values: list, words: tuple[str, ...], noise: tuple[str, ...]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct layer names, those of values by place, and the layers that hold walls: owners and places of names. values: with
    None at the end."""
    names = [(v or "0").strip(" ").upper() for v in values]
    distinct = sorted(set(names))
    of = {v: k for k, v in enumerate(distinct)}
    name = np.array([of[v] for v in names])
    pairs, count = np.unique(owner * len(distinct) + name[codes], return_counts=True)
    o, l = pairs // len(distinct), pairs % len(distinct)
    word, loud = (np.array([_any(v, of_kind) for v in distinct]) for of_kind in (words, noise))
    n = int(owner.max(initial=-1)) + 1
    hinted = np.bincount(o, weights=word[l], minlength=n) > 0
    order = np.lexsort((l, -count, o))
    o, l = o[order], l[order]
    kept = np.where(hinted[o], word[l], (ranks(o) < 5) & ~loud[l])
    return distinct, name, o[kept], l[kept]


def wall_mask(owner: np.ndarray, codes: np.ndarray, values: list) -> np.ndarray:
    """Which segments lie on wall layers, as layers.wall_segments of layers.wall_layers tells. codes: places in values, -1 for null."""
    values = [*values, None]
    n = int(owner.max(initial=-1)) + 1
    distinct, _, o, l = kept_layers(owner, codes, values, K.WALL_LAYER_HINTS, K.NOISE_LAYERS)
    listed = np.bincount(o, minlength=n) > 0

    upper = [(v or "").upper() for v in values]
    codes = np.where(codes < 0, len(values) - 1, codes)
    own, back = np.unique(owner * len(values) + codes, return_inverse=True)
    o2, c2 = own // len(values), own % len(values)
    text = np.array(sorted(set(upper)), object)
    text_of = np.searchsorted(text, np.array(upper, object))[c2]
    low, high = np.full(n, len(text)), np.full(n, -1)
    np.minimum.at(low, o2, text_of)
    np.maximum.at(high, o2, text_of)
    graph_noise, graph_word = (np.array([_any(v, words) for v in upper]) for words in (K.GRAPH_NOISE, K.GRAPH_WALL_HINTS))
    out = np.where(listed[o2], ~graph_noise[c2] & graph_word[c2], (low == high)[o2] | ~graph_noise[c2])
    open_ = np.flatnonzero(listed[o2] & ~graph_noise[c2] & ~graph_word[c2])
    if len(open_):
        walls: dict[int, list[str]] = {}
        for a, b in zip(o.tolist(), l.tolist()):
            walls.setdefault(a, []).append(distinct[b])
        out[open_] = [_any(upper[c], walls[a]) for a, c in zip(o2[open_].tolist(), c2[open_].tolist())]
    return out[back]


def bridges(owner: np.ndarray, s: np.ndarray, metres: np.ndarray, least_m: float = 0.7, most_m: float = 1.1, pairs_at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Owners and segments over the gaps that noding.gap_bridges closes. metres: metres per unit, by owner."""
    _, who, p = kernel.numbered_points(np.tile(owner, 2), np.concatenate([s[:, :2], s[:, 2:]]))
    alike, own, _ = kernel.numbered_points(who, np.round(p, 6))
    if len(own) < len(who):  # of points that are equal when rounded the first
        first = np.sort(np.unique(alike, return_index=True)[1])
        who, p = who[first], p[first]
    m = np.maximum(metres[who], 1e-12)
    near, far = least_m / m, most_m / m
    end = kernel.reaching(who, p[:, 0], p[:, 0] + far)
    count = end - np.arange(len(who)) - 1
    total = np.cumsum(count)
    out_owner, out, at = [who[:0]], [np.zeros((0, 4))], 0
    while at < len(who):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + pairs_at_once, "right")))
        own = count[at:stop]
        i = np.repeat(np.arange(at, stop), own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
        gap = np.hypot(p[j, 0] - p[i, 0], p[j, 1] - p[i, 1])
        wide = (gap >= near[i]) & (gap <= far[i]) & (gap > 0.01)
        i, j = i[wide], j[wide]
        out_owner.append(who[i])
        out.append(np.concatenate([p[i], p[j]], axis=1))
        at = stop
    return np.concatenate(out_owner), np.concatenate(out)


def _ring_keys(column: pa.ListArray, points: int = 3) -> list[np.ndarray]:
    """Sort keys of rings, most significant first: so many first points, then their sizes. Three tell faces of one graph apart."""
    begin = column.offsets.to_numpy()
    size = np.diff(begin)
    x, y = (column.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    out = []
    for k in range(points):
        at = np.minimum(begin[:-1] + np.minimum(k, np.maximum(size - 1, 0)), max(len(x) - 1, 0))
        out += [x[at], y[at]] if len(x) else []
    return [*out, size]


def _added_cycles(owner: np.ndarray, column: pa.ListArray, area: np.ndarray, line_owner: np.ndarray, lines: np.ndarray, n: int) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """As rooms.with_cycle_fallback with the edges of noding.graph_edges of four digits."""
    few = np.bincount(owner, minlength=n) < 2
    mine = np.flatnonzero(few[line_owner])
    if not len(mine):
        return owner, column, area
    ends, who = np.round(lines[mine], 4) + 0.0, line_owner[mine]
    swap = (ends[:, 0] > ends[:, 2]) | ((ends[:, 0] == ends[:, 2]) & (ends[:, 1] > ends[:, 3]))
    ends[swap] = ends[swap][:, [2, 3, 0, 1]]
    known: dict[int, set] = {}
    for k in np.flatnonzero(few[owner]).tolist():
        known.setdefault(int(owner[k]), set()).add(tuple((p["x"], p["y"]) for p in column[k].as_py()))
    new_who, new_rings, new_area = [], [], []
    cuts = np.flatnonzero(np.diff(who, prepend=-1, append=-1)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        own = int(who[a])
        edges = sorted({e for e in map(tuple, ends[a:b].tolist()) if e[:2] != e[2:]})
        for ring in kernel.cycle_basis(edges):
            if len(ring) > 2 and (size := kernel.ring_area(ring)) and kernel.is_simple(ring):
                ring = ring if size > 0 else ring[::-1]
                k = min(range(len(ring)), key=ring.__getitem__)
                ring = ring[k:] + ring[:k]
                if tuple(ring) not in known.get(own, ()):
                    new_who.append(own)
                    new_rings.append(ring)
                    new_area.append(abs(size))
    if not new_who:
        return owner, column, area
    return np.concatenate([owner, new_who]), pa.concat_arrays([column, ring_array(new_rings)]), np.concatenate([area, new_area])


def _nested(owner: np.ndarray, rings: kernel.Rings, area: np.ndarray, times: float = 1.05) -> np.ndarray:
    """Rooms within a room more than so many times as large."""
    out = np.zeros(len(owner), bool)
    for a, b in couples(owner, owner):
        e = 1e-9
        p, q = rings.take(a), rings.take(b)
        fits = (area[b] > area[a] * times) & (p.low_x >= q.low_x - e) & (p.high_x <= q.high_x + e) & (p.low_y >= q.low_y - e) & (p.high_y <= q.high_y + e) & rings.full[a]
        a, b = a[fits], b[fits]
        sure = rings.box[b]
        out[a[sure]] = True
        for i, j in zip(a[~sure].tolist(), b[~sure].tolist()):
            if not out[i]:
                own, around = rings.ring(i), rings.ring(j)
                middles = [((ax + bx) / 2, (ay + by) / 2) for (ax, ay), (bx, by) in zip(own, own[1:] + own[:1])]
                out[i] = all(kernel.contains(around, x, y, border=True) for x, y in own + middles)
    return out


def outer_rooms(owner: np.ndarray, area: np.ndarray, times: float) -> np.ndarray:
    """The largest rooms of drawings, if so many times as large as the second, as rooms.without_outer tells. Ascending areas."""
    last = np.flatnonzero(np.diff(owner, append=-1))
    second = np.where((last > 0) & (owner[np.maximum(last - 1, 0)] == owner[last]), area[np.maximum(last - 1, 0)], np.inf)
    out = np.zeros(len(owner), bool)
    out[last[area[last] > second * times]] = True
    return out


def rooms_of(owner: np.ndarray, s: np.ndarray, metres: np.ndarray, sqft: np.ndarray, least_sqft: float = 8.0) -> Rooms:
    """Rooms of wall segments (ascending owners), numbered by area. metres, sqft: factors by owner."""
    n = len(metres)
    with np.errstate(invalid="ignore"):
        long = np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]) > 1e-6
    owner, s = owner[long], s[long]
    more_owner, more = bridges(owner, s, metres)
    all_owner, all_s = np.concatenate([owner, more_owner]), np.concatenate([s, more])
    order = np.argsort(all_owner, kind="stable")
    who, column, area = kernel.faces_many(*kernel.node_many(all_owner[order], all_s[order]))
    who, column, area = _added_cycles(who, column, area, owner, s, n)

    def ordered(keep: np.ndarray) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
        return who[keep], column.take(pa.array(keep)), area[keep]

    who, column, area = ordered(np.flatnonzero(area >= least_sqft / np.maximum(sqft[who], 1e-9)))
    who, column, area = ordered(np.lexsort((*_ring_keys(column)[::-1], area, who)))
    who, column, area = ordered(np.flatnonzero(~outer_rooms(who, area, 1.5)))
    nested = _nested(who, kernel.Rings(column), area)
    if nested.any():
        who, column, area = ordered(np.flatnonzero(~nested))
    made = Rooms(who, ranks(who) + 1, column, area, sqft[who])
    thin = (made.compactness < 0.10) & (made.sqft < 35.0)
    if thin.any():
        who, column, area = ordered(np.flatnonzero(~thin))
        made = Rooms(who, ranks(who) + 1, column, area, sqft[who])
    return made


def streamed_rooms(segments: DataFrame, least_sqft: float, small: int, whole: bool = False) -> DataFrame:
    """drawing_id, room_no, ring, area_raw, sqft of the rooms of segments (with metres and sqft), in one pass. A drawing of more
    than `small` segments gives one row without room_no only. whole: as for stream_arrays."""
    numbers = ("sx", "sy", "ex", "ey", "metres", "sqft")

    def step(owner: np.ndarray, columns: dict) -> tuple:
        n = int(owner[-1]) + 1
        large = np.bincount(owner, minlength=n) > small
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        mine = np.flatnonzero(~large[owner])
        codes, values = columns["layer"]
        mine = mine[wall_mask(owner[mine], codes[mine], values)] if len(mine) else mine
        s = np.stack([columns[c] for c in numbers[:4]], axis=1)
        made = rooms_of(owner[mine], s[mine], columns["metres"][first], columns["sqft"][first], least_sqft)
        more = np.flatnonzero(large)
        number = pa.concat_arrays([pa.array(made.number, pa.int64()), pa.nulls(len(more), pa.int64())])
        ring = pa.concat_arrays([made.column, ring_array([[]] * len(more))]) if len(more) else made.column
        who = np.concatenate([made.owner, more])
        return who, number, ring, pa.concat_arrays([pa.array(made.area), pa.nulls(len(more), pa.float64())]), pa.array(columns["sqft"][first][who])

    rows = segments.select("drawing_id", "layer", *[F.col(c).cast("double").alias(c) for c in numbers])
    return stream_arrays(rows, step, f"room_no long, ring {RING}, area_raw double, sqft double", whole=whole)


#: Columns of a door that a payload names.
DOOR = {"door_no": "long", "x": "double", "y": "double", "radius": "double", "width_m": "double", "source": "string", "layer": "string"}


def drawn_floors(segments: DataFrame, texts: DataFrame, doors: DataFrame, blocks: DataFrame, scales: DataFrame | None, metres: float, sqft: float, least_sqft: float, small: int) -> DataFrame:
    """drawing_id, rooms, links, edges as of floors.floors, doors (as DOOR) and large of drawings with any part. Drawings of more
    than `small` segments are marked large and get no rooms here. scales: drawing_id, metres, sqft; else the given factors."""
    numbers = ("sx", "sy", "ex", "ey")
    swings = doors.withColumns({c: F.lit(None).cast("double") for c in ("width_m", "radius_m") if c not in doors.columns})
    swings = swings.withColumns({"x": F.col("cx").cast("double"), "y": F.col("cy").cast("double"), "radius": F.coalesce(F.col("radius").cast("double"), F.lit(0.0)), "width_m": F.coalesce(F.col("width_m").cast("double"), F.col("radius_m").cast("double"))})
    parts = {
        "segments": segments.select("drawing_id", *[F.col(c).cast("double").alias(c) for c in numbers], "layer"),
        "texts": text_part(texts), "doors": swings.select("drawing_id", *[F.col(c).cast(k).alias(c) for c, k in DOOR.items()]), "blocks": block_part(blocks),
    }
    if scales is not None:
        parts["scales"] = scales.select("drawing_id", F.col("metres").cast("double").alias("metres"), F.col("sqft").cast("double").alias("sqft"))

    def step(lists: dict[str, pa.Array], n: int) -> dict[str, pa.Array]:
        found = Part(lists["segments"], ())
        count = np.bincount(found.owner, minlength=n)
        large = count > small
        mine = np.flatnonzero(~large[found.owner])
        coded = found.rows.field("layer").dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        mine = mine[wall_mask(found.owner[mine], codes[mine], coded.dictionary.to_pylist())] if len(mine) else mine
        s = np.stack([found.numbers(c) for c in numbers], axis=1).reshape(-1, 4)
        m, f = np.full(n, metres), np.full(n, sqft)
        if "scales" in lists:
            own = Part(lists["scales"], ())
            for to, name in ((m, "metres"), (f, "sqft")):
                value = own.numbers(name).astype(float)
                to[own.owner[~np.isnan(value)]] = value[~np.isnan(value)]
        made = rooms_of(found.owner[mine], s[mine], m, f, least_sqft)
        out = furnished(made, n, Part(lists["texts"], ("text_no",)), Part(lists["doors"], ("door_no",)), Part(lists["blocks"], ("block_no",)))
        return out | {"doors": lists["doors"], "large": pa.array(large), "drawn": pa.array(count > 0)}

    doors_kind = "array<struct<" + ", ".join(f"{c}:{k}" for c, k in DOOR.items()) + ">>"
    return fold_many(parts, step, f"{FLOOR}, doors {doors_kind}, large boolean, drawn boolean", "full")
