"""Whole floors in one fold: doors, blocks, texts, shared walls and the classification of many drawings' rooms at once.

The same results as doors, blocks, texts, adjacency and classify give one after the other, without their joins: a drawing's parts
are packed once and everything that follows happens in arrays that hold many drawings. Rectangles along the axes are measured in
closed form, other outlines one by one. Labels are looked up once per distinct text of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import constants as K
from ..functions.shapes import RING
from . import kernel

#: Drawings that one call of the array functions takes.
AT_ONCE = 2_000
PAIRS_AT_ONCE = 1 << 20
def _colons(fields: str) -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in fields.split(", "))


ROOM = (
    f"room_no long, ring {RING}, area_raw double, area_sqft double, perimeter double, cx double, cy double, aspect double, convexity double, compactness double, door_count long, "
    "furniture array<string>, block_room_hint string, block_confidence double, original_label string, name string, confidence double, method string, neighbours array<long>, adjacent array<string>"
)
LINK, EDGE = "door_no long, room_no long", "i long, j long, source string, length double"
FLOOR = f"rooms array<struct<{_colons(ROOM)}>>, links array<struct<{_colons(LINK)}>>, edges array<struct<{_colons(EDGE)}>>"
VOCABULARY = ("", *K.ROOM_TYPES, *sorted({r for r, _ in K.BLOCK_HINTS.values()} - set(K.ROOM_TYPES)))
CODE = {name: k for k, name in enumerate(VOCABULARY)}
#: [candidate, neighbour]: whether the neighbour is common next to the candidate.
NEXT = np.array([[n in K.NEXT_TO.get(c, ()) for n in VOCABULARY] for c in VOCABULARY])
METHODS = np.array(["cad_label", "rules", "rules+blocks"], object)
TEXT_LABEL = 0.90


# ---- labels of distinct texts ---------------------------------------------------------------------------------------------

def title_case(text: str) -> str:
    """As functions.text.title_case."""
    out, before = [], " "
    for ch in text.lower():
        out.append(ch.upper() if ch.isalpha() and not before.isalpha() else ch)
        before = ch
    return "".join(out)


def room_label(raw: str) -> str:
    """As functions.text.room_label."""
    upper = raw.upper().strip(" ")
    known = K.LABELS.get(upper) or next((v for k, v in K.LABELS.items() if k in upper), None)
    if known is not None:
        return known
    title = title_case(raw).strip(" ")
    return next((t for t in sorted(K.ROOM_TYPES) if title in t or t in title), title)


_RANKED = sorted(K.BLOCK_HINTS.items(), key=lambda kv: -kv[1][1])


def block_hint(name: str | None) -> tuple[str, str, float]:
    """As functions.text.block_hint: type, room, confidence."""
    upper = (name or "").upper()
    return next(((w, room, c) for w, (room, c) in _RANKED if w in upper), ("GENERIC", "", 0.0))


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """Codes (-1 for null) and the distinct values."""
    found = column.dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


# ---- parts of many drawings -----------------------------------------------------------------------------------------------

def couples(one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in two ascending lists of owners that have the same owner, in chunks, by the first place."""
    begin, end = np.searchsorted(other, one, "left"), np.searchsorted(other, one, "right")
    count = end - begin
    total = np.cumsum(count)
    at = 0
    while at < len(one):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        own = count[at:stop]
        i = np.repeat(np.arange(at, stop), own)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + begin[i]
        at = stop


def _joined(found: list[tuple[np.ndarray, ...]], kinds: tuple = (np.int64, np.int64)) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.zeros(0, k) for k in kinds)


def ranks(owner: np.ndarray) -> np.ndarray:
    """Place of every row among those of its owner (ascending), from 0."""
    return np.arange(len(owner)) - np.searchsorted(owner, owner, "left")


def inside(rings: kernel.Rings, k: np.ndarray, x: np.ndarray, y: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """Whether points lie strictly inside rings."""
    b = rings.take(k)
    out = (x > b.low_x) & (x < b.high_x) & (y > b.low_y) & (y < b.high_y)
    for p in np.flatnonzero(out & ~rings.box[k]).tolist():
        out[p] = kernel.contains(rings.ring(k[p]), float(x[p]), float(y[p]), eps=eps)
    return out & rings.full[k]


def to_line(rings: kernel.Rings, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of points from the rings' lines."""
    b = rings.take(k)
    dx, dy = np.maximum(np.maximum(b.low_x - x, x - b.high_x), 0), np.maximum(np.maximum(b.low_y - y, y - b.high_y), 0)
    within = np.minimum(np.minimum(x - b.low_x, b.high_x - x), np.minimum(y - b.low_y, b.high_y - y))
    out = np.where((dx == 0) & (dy == 0), within, np.hypot(dx, dy))
    for p in np.flatnonzero(~rings.box[k]).tolist():
        a = np.array(rings.ring(k[p]), float).reshape(-1, 2)
        d = np.roll(a, -1, axis=0) - a
        norm = (d * d).sum(axis=1)
        t = np.where(norm > 0, np.clip(((x[p] - a[:, 0]) * d[:, 0] + (y[p] - a[:, 1]) * d[:, 1]) / np.where(norm > 0, norm, 1.0), 0.0, 1.0), 0.0)
        out[p] = np.hypot(a[:, 0] + t * d[:, 0] - x[p], a[:, 1] + t * d[:, 1] - y[p]).min() if len(a) else np.inf
    return out


class Rooms:
    """Rooms of many drawings: owner (ascending), number (ascending in a drawing), rings, and what is known of their shape."""

    def __init__(self, owner: np.ndarray, number: np.ndarray, column: pa.Array, area: np.ndarray, sqft: np.ndarray | float = 10.7639):
        self.owner, self.number, self.column, self.area = owner, number, column, area
        self.rings = r = kernel.Rings(column)
        self.sqft = area * sqft
        long, short = np.maximum(r.width, r.height), np.minimum(r.width, r.height)
        full = r.width * r.height
        for k in np.flatnonzero(~r.box).tolist():
            ring = r.ring(k)
            long[k], short[k] = kernel.rotated_sides(ring)
            hull = kernel.hull(ring)
            full[k] = kernel.ring_area(hull) if len(hull) > 2 else 0.0
        self.aspect = long / np.maximum(short, 1e-9)
        self.convexity = np.where(full < 1e-9, 1.0, np.minimum(1.0, area / np.maximum(full, 1e-9)))
        self.perimeter = r.lengths()
        with np.errstate(divide="ignore", invalid="ignore"):
            self.compactness = np.where(self.perimeter < 1e-9, 1.0, np.minimum(1.0, 4 * np.pi * area / (self.perimeter * self.perimeter)))
        self.cx, self.cy = r.centres()


def door_links(rooms: Rooms, owner: np.ndarray, x: np.ndarray, y: np.ndarray, reach: np.ndarray, inside_counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a door and a room, as doors.door_rooms tells; by door, then by room."""
    found = []
    for d, r in couples(owner, rooms.owner):
        b = rooms.rings.take(r)
        near = (x[d] >= b.low_x - reach[d]) & (x[d] <= b.high_x + reach[d]) & (y[d] >= b.low_y - reach[d]) & (y[d] <= b.high_y + reach[d]) & rooms.rings.full[r]
        d, r = d[near], r[near]
        fits = to_line(rooms.rings, r, x[d], y[d]) <= reach[d]
        if inside_counts:
            fits |= inside(rooms.rings, r, x[d], y[d])
        found.append((d[fits], r[fits]))
    return _joined(found)


def first_rooms(rooms: Rooms, owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For every point the place of its drawing's lowest room that strictly holds it, or -1."""
    out = np.full(len(owner), -1)
    for p, r in couples(owner, rooms.owner):
        fits = np.flatnonzero(inside(rooms.rings, r, x[p], y[p]))[::-1]
        out[p[fits]] = r[fits]  # the lowest is written last
    return out


def chosen_texts(rooms: Rooms, owner: np.ndarray, x: np.ndarray, y: np.ndarray, most: float = 5.0) -> np.ndarray:
    """For every room the place of the text that texts.assign_texts gives it, or -1. The k-th rooms of all drawings choose at
    the same time. Texts are in the order of their numbers."""
    found = []
    for r, t in couples(rooms.owner, owner):
        cost = np.hypot(x[t] - rooms.cx[r], y[t] - rooms.cy[r])
        held = inside(rooms.rings, r, x[t], y[t], eps=1e-9)
        cost[held] = -1.0
        near = cost <= most
        found.append((r[near], t[near], cost[near]))
    r, t, cost = _joined(found, (np.int64, np.int64, float))
    out, used = np.full(len(rooms.owner), -1), np.zeros(len(owner), bool)
    turn = ranks(rooms.owner)[r]
    order = np.argsort(turn, kind="stable")
    r, t, cost, turn = r[order], t[order], cost[order], turn[order]
    cuts = np.flatnonzero(np.diff(turn, prepend=-1, append=-1))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        free = np.flatnonzero(~used[t[a:b]]) + a
        if len(free):
            own = r[free]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            size = np.diff(np.append(begin, len(own)))
            best = np.flatnonzero(cost[free] == np.repeat(np.minimum.reduceat(cost[free], begin), size))
            best = best[np.diff(own[best], prepend=-1) != 0]
            out[own[best]] = t[free[best]]
            used[t[free[best]]] = True
    return out


def wall_edges(rooms: Rooms, least: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of rooms that adjacency.shared_walls finds, and their lengths."""
    i, j = kernel.near_pairs(rooms.owner, rooms.rings, -1e-9)
    a, b, r = rooms.rings.take(i), rooms.rings.take(j), rooms.rings
    length = kernel._covered_of_boxes(a, b)
    for k in np.flatnonzero(~(r.box[i] & r.box[j])).tolist():
        length[k] = kernel.covered_length(r.ring(i[k]), r.ring(j[k]))
    long = length >= least
    return i[long], j[long], length[long]


def _geometry(rooms: Rooms) -> tuple[np.ndarray, np.ndarray]:
    """Codes and confidences of scoring.geometry_score."""
    size = rooms.sqft
    cases = [((rooms.aspect >= 3.5) & (size >= 40.0), "Corridor", 0.78), ((rooms.compactness < 0.45) & (size > 80), "Hall", 0.55), *((size < most, label, c) for most, label, c in K.AREA_RULES)]
    conditions = [c for c, _, _ in cases]
    return np.select(conditions, [CODE[label] for _, label, _ in cases], CODE[K.OPEN_AREA[0]]), np.select(conditions, [c for _, _, c in cases], K.OPEN_AREA[1])


def classified(rooms: Rooms, names: np.ndarray, said: np.ndarray, block: tuple[np.ndarray, np.ndarray], one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As classify.classify_rooms: codes of the labels (-1: that of the text), confidences, and numbers of the methods.

    names: codes of the rooms' names, -1 for names beside the vocabulary. said: code of the text's label, -1 beside the
    vocabulary, -2 without. block: codes and confidences. one, other: places of neighbours, both ways, distinct.
    """
    geo, block_ = _geometry(rooms), block
    label, sure, method = np.zeros(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names), np.int64)
    now = np.where(names < 0, 0, names)
    told = said > -2
    turn = ranks(rooms.owner)
    order = np.argsort(turn[one], kind="stable")
    one, other = one[order], other[order]
    starts = np.searchsorted(turn[one], np.arange(turn.max(initial=-1) + 2))
    by_turn = np.argsort(turn, kind="stable")
    begin = np.searchsorted(turn[by_turn], np.arange(turn.max(initial=-1) + 2))
    place = np.zeros(len(names), np.int64)
    for k in range(len(begin) - 1):
        r = by_turn[begin[k] : begin[k + 1]]
        place[r] = np.arange(len(r))
        p, q = one[starts[k] : starts[k + 1]], other[starts[k] : starts[k + 1]]
        candidate = np.where(block_[0][r] > 0, block_[0][r], geo[0][r])
        around = now[q]
        mine = candidate[place[p]]
        hits = np.bincount(place[p], weights=NEXT[mine, around] & (around > 0), minlength=len(r))
        hosts = np.bincount(place[p], weights=NEXT[around, mine] & (around > 0), minlength=len(r)) > 0
        near = np.where(hits > 0, np.minimum(0.85, 0.4 + 0.15 * hits), np.where(hosts, 0.5, 0.0))
        labels = [geo[0][r], block_[0][r], np.where(near > 0, candidate, 0)]
        votes = [np.where((c > 0) & (s > 0), s * w, 0.0) for c, s, w in zip(labels, (geo[1][r], block_[1][r], near), K.WEIGHTS)]
        weights = K.WEIGHTS[0] + np.where(block_[1][r] > 0, K.WEIGHTS[1], 0.0) + np.where(near > 0, K.WEIGHTS[2], 0.0)
        best, most = labels[0], np.full(len(r), -1.0)
        for c, v in zip(labels, votes):
            total = np.zeros(len(r))
            for d, w in zip(labels, votes):
                total = total + np.where(d == c, w, 0.0)
            better = (v > 0) & (total > most)
            best, most = np.where(better, c, best), np.where(better, total, most)
        by_text = told[r]
        label[r] = np.where(by_text, said[r], best)
        sure[r] = np.where(by_text, TEXT_LABEL, np.minimum(1.0, most / weights))
        method[r] = np.where(by_text, 0, np.where((block_[0][r] > 0) & (block_[1][r] > 0), 2, 1))
        now[r] = np.maximum(label[r], 0)
    return label, sure, method


def _lists(owner: np.ndarray, n: int, values: pa.Array, null_if_empty: bool = False) -> pa.Array:
    """Values, sorted by owner, as one list per owner 0 to n - 1."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    if null_if_empty:
        empty = np.append(np.diff(ends) == 0, False)
        return pa.ListArray.from_arrays(pa.array(ends, mask=empty), values)
    return pa.ListArray.from_arrays(pa.array(ends), values)


class Part:
    """One part of many drawings: owner, and columns as arrays, sorted by some columns. of: the owners of the lists (ascending),
    if they are not the drawings themselves."""

    def __init__(self, column: pa.ListArray, order: tuple[str, ...], of: np.ndarray | None = None):
        ends = column.offsets.to_numpy()
        size = np.diff(ends)
        if column.null_count:
            size = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)
        self.rows = column.flatten()
        self.owner = np.repeat(np.arange(len(column)) if of is None else of, size)
        if not order:
            return
        keys = [self.numbers(c) for c in order]
        sorting = np.lexsort((*keys[::-1], self.owner))
        if len(sorting) and (np.diff(sorting) != 1).any():
            self.rows = self.rows.take(pa.array(sorting))

    def numbers(self, name: str) -> np.ndarray:
        return self.rows.field(name).to_numpy(zero_copy_only=False)


def furnished(rooms: Rooms, n: int, texts: Part, doors: Part, blocks: Part, by_doors: bool = True, snap: float = 1.5) -> dict[str, pa.Array]:
    """rooms, links and edges of n drawings as lists of structs."""
    count = len(rooms.owner)
    radius = np.nan_to_num(doors.numbers("radius").astype(float), nan=0.0)
    door, at = door_links(rooms, doors.owner, doors.numbers("x"), doors.numbers("y"), radius + snap)
    door_count = np.bincount(at, minlength=count)

    held = first_rooms(rooms, blocks.owner, blocks.numbers("x"), blocks.numbers("y"))
    codes, values = _coded(blocks.rows.field("name"))
    hints = [block_hint(v) for v in [*values, None]]
    kinds, hint_room, hint_sure = (np.array([h[k] for h in hints], kind) for k, kind in ((0, object), (1, object), (2, float)))
    hint_code = np.array([CODE[v] for v in hint_room], np.int64)
    known = np.flatnonzero((held >= 0) & (hint_sure[codes] > 0) & (hint_code[codes] > 0))
    known = known[np.argsort(held[known], kind="stable")]
    where, what = held[known], codes[known]
    # votes: sums by room and hinted type, the type suggested first on ties
    key = where * len(VOCABULARY) + hint_code[what]
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.diff(key[order], prepend=-1))
    votes = np.add.reduceat(hint_sure[what][order], begin) if len(begin) else np.zeros(0)
    vote_room, vote_code, first = where[order][begin], hint_code[what][order][begin], order[begin]
    best = np.lexsort((first, -votes, vote_room))
    best = best[np.diff(vote_room[best], prepend=-1) != 0]
    hint, hint_votes = np.zeros(count, np.int64), np.zeros(count)
    hint[vote_room[best]], hint_votes[vote_room[best]] = vote_code[best], np.minimum(1.0, votes[best])
    # furniture: the hint, replaced by the first of the most confident kinds if that is more confident
    sure = np.where(kinds[what] == "LAUNDRY", -1.0, hint_sure[what])
    top = np.lexsort((np.arange(len(what)), -sure, where))
    top = top[np.diff(where[top], prepend=-1) != 0]
    block, block_sure = hint.copy(), hint_votes.copy()
    more = top[sure[top] > block_sure[where[top]]]
    block[where[more]], block_sure[where[more]] = hint_code[what[more]], sure[more]

    text = chosen_texts(rooms, texts.owner, texts.numbers("x"), texts.numbers("y"))
    text_code, text_values = _coded(texts.rows.field("text"))
    own_text = np.where(text >= 0, np.append(text_code, -1)[text], -1)
    plain = [f"Room {k}" for k in range(int(rooms.number.max(initial=0)) + 1)] if rooms.number.max(initial=0) <= 10 * AT_ONCE else None
    spoken = np.array([*text_values, None], object)
    original = spoken[own_text]
    numbered = np.array(plain, object)[rooms.number] if plain is not None else np.array([f"Room {k}" for k in rooms.number.tolist()], object)
    names = np.where(own_text >= 0, original, numbered)
    trimmed = [v.strip(" ") for v in text_values]
    labels = np.array([room_label(v) if v else None for v in trimmed] + [None], object)
    said_codes = np.array([CODE.get(v, -1) if v is not None else -2 for v in labels], np.int64)
    name_codes = np.array([CODE.get(v, -1) for v in text_values] + [-1], np.int64)

    i, j, length = wall_edges(rooms)
    source = np.zeros(len(i), np.int64)
    if by_doors:
        pairs = [(at[p], at[q]) for p, q in couples(door, door)]
        a, b = _joined([(p[p < q], q[p < q]) for p, q in pairs])
        linked = np.unique(a * max(count, 1) + b)
        a, b = linked // max(count, 1), linked % max(count, 1)
        fresh = ~np.isin(i * max(count, 1) + j, linked)
        i, j, length, source = np.concatenate([a, i[fresh]]), np.concatenate([b, j[fresh]]), np.concatenate([np.full(len(a), np.nan), length[fresh]]), np.concatenate([np.ones(len(a), np.int64), source[fresh]])
    one, other, wall = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(source == 0, 2)
    order = np.lexsort((other, wall, one))
    one, other = one[order], other[order]

    label, sure, method = classified(rooms, name_codes[own_text], said_codes[own_text], (block, block_sure), one, other)
    final = np.where(said_codes[own_text] > -2, labels[own_text], np.array(VOCABULARY, object)[label])
    furniture = _lists(where, count, pa.array(kinds[what], pa.string()), null_if_empty=True)
    numbers = rooms.number
    room = pa.StructArray.from_arrays(
        [
            pa.array(numbers), rooms.column, *map(pa.array, (rooms.area, rooms.sqft, rooms.perimeter, rooms.cx, rooms.cy, rooms.aspect, rooms.convexity, rooms.compactness, door_count)), furniture,
            pa.array(np.where(hint > 0, np.array(VOCABULARY, object)[hint], None), pa.string()), pa.array(hint_votes, mask=hint == 0), pa.array(original, pa.string()), pa.array(final, pa.string()), pa.array(sure),
            pa.array(METHODS[method], pa.string()), _lists(one, count, pa.array(numbers[other]), True), _lists(one, count, pa.array(names[other], pa.string()), True),
        ],
        [f.split(" ")[0] for f in ROOM.split(", ")],
    )
    link = pa.StructArray.from_arrays([pa.array(doors.numbers("door_no")[door]), pa.array(numbers[at])], ["door_no", "room_no"])
    order = np.argsort(rooms.owner[i], kind="stable")
    edge = pa.StructArray.from_arrays([pa.array(numbers[i[order]]), pa.array(numbers[j[order]]), pa.array(np.where(source[order] == 1, "door", "shared_wall"), pa.string()), pa.array(length[order], mask=np.isnan(length[order]))], ["i", "j", "source", "length"])
    return {"rooms": _lists(rooms.owner, n, room), "links": _lists(doors.owner[door], n, link), "edges": _lists(rooms.owner[i[order]], n, edge)}


# ---- tables ---------------------------------------------------------------------------------------------------------------

def packed(parts: dict[str, DataFrame], how: str) -> DataFrame:
    """(drawing_id, one list of structs per part) of the drawings that the first part has, or with "full" any part. Rows of a
    list are in any order."""
    out = None
    for name, rows in parts.items():
        rest = [c for c in rows.columns if c != "drawing_id"]
        own = rows.groupBy("drawing_id").agg(F.collect_list(F.struct(*rest)).alias(name))
        out = own if out is None else out.join(own, "drawing_id", how)
    return out


def fold_many(parts: dict[str, DataFrame], step, schema: str, how: str = "left") -> DataFrame:
    """step takes the lists of up to AT_ONCE drawings by part, and returns the columns of schema, one row per drawing."""
    rows, names = packed(parts, how), list(parts)
    whole = StructType([rows.schema["drawing_id"], *StructType.fromDDL(schema)])
    shape = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = step({name: part.column(name) for name in names}, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("drawing_id"), *(found[f.name].cast(f.type) for f in list(shape)[1:])], schema=shape)

    return rows.mapInArrow(run, whole)


def text_part(texts: DataFrame) -> DataFrame:
    return texts.where("text is not null").select("drawing_id", "text_no", "text", "x", "y")


def door_part(doors: DataFrame) -> DataFrame:
    return doors.select("drawing_id", "door_no", F.col("cx").alias("x"), F.col("cy").alias("y"), F.coalesce(F.col("radius").cast("double"), F.lit(0.0)).alias("radius"))


def block_part(blocks: DataFrame) -> DataFrame:
    return blocks.select("drawing_id", "block_no", "name", "x", "y")


def floors(rooms: DataFrame, texts: DataFrame, doors: DataFrame, blocks: DataFrame, by_doors: bool = True) -> DataFrame:
    """drawing_id, rooms, links, edges of rooms (drawing_id, room_no, ring, area_raw) that have no names of their own.
    by_doors: whether rooms that share a door are neighbours too. A drawing must fit a task."""

    def step(parts: dict[str, pa.Array], n: int) -> dict[str, pa.Array]:
        found = Part(parts["rooms"], ("room_no",))
        made = Rooms(found.owner, found.numbers("room_no"), found.rows.field("ring"), found.numbers("area_raw"))
        return furnished(made, n, Part(parts["texts"], ("text_no",)), Part(parts["doors"], ("door_no",)), Part(parts["blocks"], ("block_no",)), by_doors)

    parts = {"rooms": rooms.select("drawing_id", "room_no", "ring", "area_raw"), "texts": text_part(texts), "doors": door_part(doors), "blocks": block_part(blocks)}
    return fold_many(parts, step, FLOOR)


def room_rows(found: DataFrame) -> DataFrame:
    return found.select("drawing_id", F.inline("rooms"))
