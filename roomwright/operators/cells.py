"""The grid cut of noding.node_edges in arrays, for drawings of any size: segments are dealt by drawing and cell, cut in each cell at
those they share it with, and their edges are dealt by drawing and traced.

What is dealt are compressed batches of many segments, one row per target, not a row per segment; so every drawing can take the way
that spreads a giant one over tasks, and nothing is written besides the two exchanges.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import constants as K
from ..functions.shapes import RING
from . import kernel
from .drawings import stream_arrays
from .spatial import MOST_CELLS, PER_CELL
from .walls import bridges

#: Segments or edges that are cut or traced at once, about.
AT_ONCE = 200_000
#: Targets of packed batches, at least: what one of them gets is held at once.
TARGETS = 512
_CELL, _ENDS, _AT = ("cx", "cy", "lx", "ly"), ("sx", "sy", "ex", "ey"), ("x", "y")
_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


def _pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_PACKED) as to:
        to.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpack(packed: list) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(v).read_all() for v in packed])


def _packed_by(target: np.ndarray, keys: pa.Array, columns: dict[str, np.ndarray]) -> dict[int, bytes]:
    """Rows (keys and columns) as one compressed batch per target."""
    order = np.argsort(target.astype(np.uint16) if target.max(initial=0) < 1 << 16 else target, kind="stable")
    rows = pa.RecordBatch.from_arrays([keys.take(pa.array(order)), *(pa.array(v[order]) for v in columns.values())], ["key", *columns])
    target = target[order]
    cuts = np.flatnonzero(np.diff(target, prepend=-1, append=-1)).tolist()
    return {int(target[a]): _pack(rows.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])}


def _hashed(keys: pa.Array) -> np.ndarray:
    """A number per key that is the same in every task."""
    coded = keys.dictionary_encode(null_encoding="encode")
    values = coded.dictionary.to_pylist()
    mixed = [((v if isinstance(v, int) else zlib.crc32(repr(v).encode())) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 33 for v in values]
    return np.array(mixed, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _numbers(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], axis=1)


def _codes(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Each row's key as a place in the distinct keys, and these."""
    coded = table.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def without_repeats(owner: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Places of segments, without those that are found to be equal to others of their owner (equal ones that are missed do no
    harm), and without those of no length."""
    long = (s[:, 0] != s[:, 2]) | (s[:, 1] != s[:, 3])
    mixed = owner.astype(np.uint64)
    for k in range(4):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (s[:, k] + 0.0).view(np.uint64)
    order = np.argsort(mixed)
    again = np.flatnonzero(mixed[order][1:] == mixed[order][:-1])
    p, q = order[again], order[again + 1]
    same = (owner[p] == owner[q]) & (s[p] == s[q]).all(axis=1)
    long[q[same]] = False
    return np.flatnonzero(long)


def in_cells(owner: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (ascending owners) by place, once for each cell of the owner's grid that their boxes touch, and the cells with the
    lowest ones of the segment (cx, cy, lx, ly)."""
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(begin, len(owner)))
    low, high = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros((0, 4), np.int32)
    least, most = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
    grid = np.clip(np.floor(np.sqrt(count / PER_CELL)), 1, MOST_CELLS)
    step = np.maximum((most - least).max(axis=1), 1e-9) / grid
    least, step, last = (np.repeat(v, count, axis=0) for v in (least, step, grid - 1))
    first, final = (np.clip(np.floor((v - least) / step[:, None]), 0, last[:, None]).astype(np.int64) for v in (low - 1e-9, high + 1e-9))
    wide = final - first + 1
    total = wide[:, 0] * wide[:, 1]
    seg = np.repeat(np.arange(len(s)), total)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(total) - total, total)
    cell = np.stack([first[seg, 0] + k % wide[seg, 0], first[seg, 1] + k // wide[seg, 0]], axis=1)
    return seg, np.concatenate([cell, first[seg]], axis=1).astype(np.int32)


def cut_in_cells(owner: np.ndarray, cells: np.ndarray, several: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of cells (ascending owners, one for each cell) cut at each other. Of those that lie in this cell only: places and
    edges; of those in several cells: places and points on them, which are whole once all cells are together. A pair counts in the
    cell of the larger low corner only, which both have."""

    def once(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (cells[i, :2] == np.maximum(cells[i, 2:], cells[j, 2:])).all(axis=1)

    seg, x, y = kernel.cut_points(owner, s, counts=once)
    open_ = several[seg]
    home = (cells[:, :2] == cells[:, 2:]).all(axis=1)
    mine = open_ & ((np.arange(len(seg)) >= 2 * len(s)) | home[seg])  # ends come first, and from one cell only
    place, edges = kernel.cut_edges(s, seg[~open_], x[~open_], y[~open_])
    return place, edges, seg[mine], np.stack([x[mine], y[mine]], axis=1)


def cut_whole(owner: np.ndarray, s: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and edges of segments of which each row has one point; segments of an owner with equal ends are one."""
    begin, end = (kernel.numbered_points(owner, s[:, k : k + 2])[0] for k in (0, 2))
    _, first, seg = np.unique(begin * len(s) + end, return_index=True, return_inverse=True)
    place, edges = kernel.cut_edges(s[first], seg, points[:, 0], points[:, 1])
    return owner[first][place], edges


def faces(rows: DataFrame, lines_of: Callable[[np.ndarray, dict], tuple[np.ndarray, np.ndarray]], whole: bool = False) -> DataFrame:
    """drawing_id, ring, area_raw, x0, y0, x1, y1 (the ring's box) of the faces of all drawings. lines_of takes rows as they stream
    by (see stream_arrays, also for whole) and gives owners, ascending, and segments."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    targets = max(TARGETS, 2 * parts)
    key = rows.schema["drawing_id"].dataType.simpleString()

    def deal(owner: np.ndarray, columns: dict) -> tuple:
        keys = columns.pop("_key").flatten().take(pa.array(np.flatnonzero(np.diff(owner, prepend=-1))))
        who, s = lines_of(owner, columns)
        kept = without_repeats(who, s)
        who, s = who[kept], s[kept]
        seg, cells = in_cells(who, s)
        several = np.bincount(seg, minlength=len(s))[seg] > 1
        target = (_hashed(keys)[who[seg]] + 7 * cells[:, 0] + 31 * cells[:, 1]) % targets
        columns = dict(zip(_CELL, cells.T)) | {"several": several} | dict(zip(_ENDS, s[seg].T))
        out = _packed_by(target, keys.take(pa.array(who[seg])), columns)
        return np.zeros(len(out), np.int64), pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            code, keys = _codes(table)
            cells = _numbers(table, _CELL).astype(np.int64)
            unit = (code * MOST_CELLS + cells[:, 0]) * MOST_CELLS + cells[:, 1]
            order = np.argsort(unit, kind="stable")
            owner = np.cumsum(np.diff(unit[order], prepend=-1) != 0) - 1
            code, s = code[order], _numbers(table, _ENDS)[order]
            place, edges, seg, points = cut_in_cells(owner, cells[order], table.column("several").to_numpy()[order], s)
            home = _hashed(keys) % targets
            made = [_packed_by(home[code[at]], keys.take(pa.array(code[at])), columns) for at, columns in ((place, dict(zip(_ENDS, edges.T))), (seg, dict(zip(_ENDS, s[seg].T)) | dict(zip(_AT, points.T))))]
            to = sorted({*made[0], *made[1]})
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(pa.array([m.get(t) for t in to], pa.binary()) for m in made)], ["target", "edges", "cuts"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, cuts in _targets(batches):
            tables = [_unpack(v) for v in (edges, cuts) if v]
            code, keys = _codes(pa.concat_tables([t.select(["key"]) for t in tables]))
            held = len(code) - (tables[-1].num_rows if cuts else 0)
            # a few drawings at a time: ranges of codes, and the rows of each range
            size = np.cumsum(np.bincount(code))
            bounds = np.unique(np.append(np.searchsorted(size, np.arange(0, size[-1], AT_ONCE), "right"), len(size)))
            orders = [np.argsort(v, kind="stable") for v in (code[:held], code[held:])]
            limits = [np.searchsorted(v[o], bounds) for v, o in zip((code[:held], code[held:]), orders)]
            for k in range(len(bounds) - 1):
                at, own = (o[limit[k] : limit[k + 1]] for o, limit in zip(orders, limits))
                owner, lines = code[:held][at], _numbers(tables[0].take(pa.array(at)), _ENDS) if edges else np.zeros((0, 4))
                if len(own):
                    part = tables[-1].take(pa.array(own))
                    more, s = cut_whole(code[held:][own], _numbers(part, _ENDS), _numbers(part, _AT))
                    owner, lines = np.concatenate([owner, more]), np.concatenate([lines, s])
                order = np.argsort(owner, kind="stable")
                who, rings, area = kernel.faces_many(owner[order] - bounds[k], lines[order])
                box = kernel.Rings(rings)
                values = [rings, *map(pa.array, (area, box.low_x, box.low_y, box.high_x, box.high_y))]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(who + bounds[k])), *(v.cast(f.type) for v, f in zip(values, list(shape)[1:]))], schema=shape)

    kind = StructType.fromDDL(f"drawing_id {key}, ring {RING}, area_raw double, x0 double, y0 double, x1 double, y1 double")
    shape = to_arrow_schema(kind)
    dealt = stream_arrays(rows.withColumn("_key", F.array("drawing_id")), deal, "target int, packed binary", rows_at_once=100_000, whole=whole)
    pieces = dealt.select("target", "packed").repartition(parts, "target").mapInArrow(cut, "target int, edges binary, cuts binary")
    return pieces.repartition(parts, "target").sortWithinPartitions("target").mapInArrow(trace, kind)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of packed batches, so many together."""
    held, count = [], 0
    for batch in batches:
        for v in batch.column("packed"):
            held.append(pa.ipc.open_stream(v.as_buffer()).read_all())
            count += held[-1].num_rows
            if count >= AT_ONCE:
                yield pa.concat_tables(held)
                held, count = [], 0
    if held:
        yield pa.concat_tables(held)


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Packed edges and cuts of one target after the other."""
    now, edges, cuts = None, [], []
    for batch in batches:
        for target, e, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if target != now and (edges or cuts):
                yield edges, cuts
                edges, cuts = [], []
            now = target
            edges += [e.as_buffer()] if e.is_valid else []
            cuts += [c.as_buffer()] if c.is_valid else []
    if edges or cuts:
        yield edges, cuts


def plain_lines(owner: np.ndarray, columns: dict) -> tuple[np.ndarray, np.ndarray]:
    """For rows of segments (sx, sy, ex, ey)."""
    return owner, np.stack([columns[c] for c in _ENDS], axis=1)


def unlisted_walls(owner: np.ndarray, codes: np.ndarray, values: list) -> np.ndarray:
    """Which segments layers.wall_segments keeps of drawings without wall layers. codes: places in values, -1 for null."""
    upper = [(v or "").upper() for v in [*values, None]]
    codes = np.where(codes < 0, len(values), codes)
    names, text = np.unique(np.array(upper, object), return_inverse=True)
    n = int(owner.max(initial=-1)) + 1
    low, high = np.full(n, len(names)), np.full(n, -1)
    np.minimum.at(low, owner, text[codes])
    np.maximum.at(high, owner, text[codes])
    noise = np.array([any(w in v for w in K.GRAPH_NOISE) for v in upper])
    return (low == high)[owner] | ~noise[codes]


def bridged_walls(owner: np.ndarray, columns: dict) -> tuple[np.ndarray, np.ndarray]:
    """For rows with lists of layers and lines, as of older.SHEET, in metres: wall segments as layers.wall_segments keeps them without
    wall layers, without dust, and with bridges over door gaps."""
    layers = columns["layers"]
    who = np.repeat(owner, np.diff(layers.offsets.to_numpy()))
    coded = layers.flatten().dictionary_encode()
    s = columns["lines"].flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    kept = unlisted_walls(who, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist())
    kept &= np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]) > 1e-6
    who, s = who[kept], s[kept]
    more_who, more = bridges(who, s, np.ones(int(owner[-1]) + 1))
    who, s = np.concatenate([who, more_who]), np.concatenate([s, more])
    order = np.argsort(who, kind="stable")
    return who[order], s[order]
