"""Per-drawing Python folds: a drawing's rows are packed into one row by the engine, and whole batches of drawings go to Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def plain(column: pa.Array) -> list:
    """An array's values as lists, dicts and scalars, converted child by child and not value by value."""
    kind = column.type
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, values)) for values in zip(*map(plain, column.flatten()))]
    elif pa.types.is_list(kind):
        ends = column.offsets.to_numpy()
        inner = plain(column.values.slice(ends[0], ends[-1] - ends[0]))
        ends = (ends - ends[0]).tolist()
        rows = [inner[a:b] for a, b in zip(ends, ends[1:])]
    else:
        return column.to_pylist()
    if column.null_count:
        rows = [r if ok else None for r, ok in zip(rows, column.is_valid().to_pylist())]
    return rows


def plain_rows(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch as dicts."""
    return [dict(zip(batch.schema.names, values)) for values in zip(*map(plain, batch.columns))]


def pack(rows: DataFrame, name: str, key: str = "drawing_id") -> DataFrame:
    """(key, name): the other columns as an array of structs, in the order of the columns. One drawing must fit a task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def fold(main: tuple[str, DataFrame], others: dict[str, DataFrame], step: Callable[[dict], Iterable[tuple]], schema: str, key: str = "drawing_id") -> DataFrame:
    """Applies step to each drawing of the main part: a dict with the key and, by name, a list of dicts per part (empty where
    a drawing has none). step yields rows of the schema without the key."""
    packed = pack(main[1], main[0], key)
    for name, rows in others.items():
        packed = packed.join(pack(rows, name, key), key, "left")
    names = list(others)
    kind = packed.schema[key].dataType.simpleString()
    shape = to_arrow_schema(StructType.fromDDL(f"{key} {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for row in plain_rows(batch.slice(at, 500)):
                    for name in names:
                        row[name] = row[name] or []
                    out += [(row[key], *values) for values in step(row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    return packed.mapInArrow(run, StructType.fromDDL(f"{key} {kind}, {schema}"))


def ring_array(rings: list[list[tuple[float, float]]]) -> pa.Array:
    """Lists of (x, y) as an array of rings."""
    ends = np.cumsum([0, *map(len, rings)], dtype=np.int32)
    flat = np.array([p for ring in rings for p in ring], float).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]))


def fold_arrays(rows: DataFrame, step: Callable[[np.ndarray, dict[str, np.ndarray]], tuple[list, ...]], schema: str, key: str = "drawing_id", at_once: int = 500) -> DataFrame:
    """Like fold, of one part with numbers only, many drawings per call: step takes each row's drawing (a number, ascending) and
    the columns, and returns the drawings of its result rows and their columns (lists, or arrays of rings)."""
    packed = pack(rows, "rows", key)
    kind = packed.schema[key].dataType.simpleString()
    shape = to_arrow_schema(StructType.fromDDL(f"{key} {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                column = part.column("rows")
                ends = column.offsets.to_numpy()
                flat = column.values.slice(ends[0], ends[-1] - ends[0])
                columns = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
                owner, *values = step(np.repeat(np.arange(part.num_rows), np.diff(ends)), columns)
                if len(owner):
                    values = [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, list(shape)[1:])]
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(owner, pa.int64())), *values], schema=shape)

    return packed.mapInArrow(run, StructType.fromDDL(f"{key} {kind}, {schema}"))


def stream_arrays(rows: DataFrame, step: Callable[[np.ndarray, dict[str, np.ndarray]], tuple[list, ...]], schema: str, key: str = "drawing_id", rows_at_once: int = 40_000, whole: bool = False) -> DataFrame:
    """Like fold_arrays, but rows come as they are, sorted by drawing and in any order within one, and are packed nowhere: the
    window deals and sorts them where they are not dealt yet, and Python waits for a drawing's last row. Of texts, step gets
    places in their distinct values (-1: null) and these values. whole: a drawing's rows are known to follow each other in one
    partition, as those of a parsed file do; they are not dealt then. Lists stay Arrow lists, one per row."""
    names = [c for c in rows.columns if c != key]
    # only for the window's distribution; the count itself is not read
    dealt = rows if whole else rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))).select(key, *names, "_n")
    kind = rows.schema[key].dataType.simpleString()
    shape = to_arrow_schema(StructType.fromDDL(f"{key} {kind}, {schema}"))

    def of(column: pa.ChunkedArray) -> np.ndarray | pa.Array | tuple[np.ndarray, list]:
        if pa.types.is_list(column.type):
            return column.combine_chunks()
        if not pa.types.is_string(column.type):
            return column.to_numpy()
        coded = column.combine_chunks().dictionary_encode()
        return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()

    def done(parts: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """The result of all whole drawings, and the rows that wait."""
        table = pa.Table.from_batches(parts)
        ids = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = ids.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(codes, prepend=-1))
        end = table.num_rows if last else int(cuts[-1])
        if not end:
            return None, parts
        columns = {c: of(table.column(c).slice(0, end)) for c in names}
        owner, *values = step(np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(codes))))[:end], columns)
        out = None
        if len(owner):
            values = [v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, list(shape)[1:])]
            out = pa.RecordBatch.from_arrays([table.column(key).combine_chunks().take(pa.array(cuts[owner])), *values], schema=shape)
        return out, table.slice(end).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count, enough = [], 0, rows_at_once
        for batch in batches:
            parts.append(batch)
            count += batch.num_rows
            if count >= enough:
                out, parts = done(parts, False)
                count = sum(p.num_rows for p in parts)
                enough = max(rows_at_once, 2 * count)
                if out is not None:
                    yield out
        if count:
            out, _ = done(parts, True)
            if out is not None:
                yield out

    return dealt.mapInArrow(run, StructType.fromDDL(f"{key} {kind}, {schema}"))


def map_columns(rows: DataFrame, work: Callable[[pa.RecordBatch], list], schema: str, keep: list[str]) -> DataFrame:
    """Adds the columns of schema to the columns `keep`; work makes them of a whole batch, as arrays."""
    whole = StructType([*(rows.schema[c] for c in keep), *StructType.fromDDL(schema)])
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = [pa.array(c, f.type) for c, f in zip(work(batch), shape)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *shape.names])

    return rows.mapInArrow(run, whole)


def fold_rings(rows: DataFrame, order: str, step: Callable[[np.ndarray, pa.StructArray], tuple[np.ndarray, list]], schema: str, key: str = "drawing_id") -> DataFrame:
    """Like fold_arrays, of columns of any kind: step takes each row's drawing (a number, ascending) and the other columns as
    structs, by `order` (distinct in a drawing), and returns the drawings of its result rows and their columns."""
    rest = [order, *(c for c in rows.columns if c not in (key, order))]
    packed = rows.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    kind = packed.schema[key].dataType.simpleString()
    shape = to_arrow_schema(StructType.fromDDL(f"{key} {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("rows")
            ends = column.offsets.to_numpy()
            flat = column.values.slice(ends[0], ends[-1] - ends[0])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            if not len(flat):
                continue
            sorting = np.lexsort((flat.field(order).to_numpy(zero_copy_only=False), owner))
            who, values = step(owner, flat.take(pa.array(sorting)))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(who)), *((v if isinstance(v, pa.Array) else pa.array(v)).cast(f.type) for v, f in zip(values, list(shape)[1:]))], schema=shape)

    return packed.mapInArrow(run, StructType.fromDDL(f"{key} {kind}, {schema}"))


def pick_rows(rows: DataFrame, choose: Callable[[np.ndarray, pa.StructArray], np.ndarray], key: str = "drawing_id") -> DataFrame:
    """The rows for which choose holds, many drawings per call: it takes each row's drawing (a number, ascending) and the other
    columns as structs, and returns a mask. Rows come back as they are, without a join."""
    rest = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    shape = to_arrow_schema(StructType([rows.schema[c] for c in [key, *rest]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("rows")
            ends = column.offsets.to_numpy()
            flat = column.values.slice(ends[0], ends[-1] - ends[0])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            kept = np.flatnonzero(choose(owner, flat)) if len(flat) else []
            if len(kept):
                out = flat.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner[kept])), *(c.cast(f.type) for c, f in zip(out.flatten(), list(shape)[1:]))], schema=shape)

    return packed.mapInArrow(run, StructType([rows.schema[c] for c in [key, *rest]])).select(*rows.columns)
