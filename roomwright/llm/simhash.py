"""SimHash near-duplicate classes with bit-sliced comparison of fingerprints.

A fingerprint bit is 1 if more than half of the text's word shingles have it set in their XXH64. Fingerprints at most
`radius` bits apart are linked, and documents connected by links form one class.

Candidates: the 64 bits are cut into radius + 2 bands, and two fingerprints within the radius agree in two bands at least.
Each distinct fingerprint is dealt to the buckets of its pairs of bands: ten of 25 or 26 bits for a radius of 3, so that a
bucket of unrelated fingerprints holds one in 33 million of them. Radii over `MOST_PAIRED` take radius + 1 bands, one at a
time. Inside a bucket fingerprints lie in blocks of 64, stored
vertically: one machine word per bit position. A fingerprint is compared with a whole block at once, bit plane by bit
plane; the 64 distances are kept in carry-save counters (two words for radii of 0 to 3, three up to 7, and so on, one for
overflow), two planes per full adder, and a block is abandoned as soon as every lane has overflown. More bands are narrower:
from a radius of about 8 on, buckets hold so many fingerprints that the work nears that of comparing all pairs. The links of a task are contracted to a spanning
forest before they leave it, so no group emits its pairs.

Buckets over `CHUNK` fingerprints are cut into chunks, and every pair of chunks is a task of its own, so no bucket is
gathered whole and none is capped.

Defined results: a null text is empty; texts without a word have fingerprint 0 and are linked like others; classes are
made of fingerprints, so a repeated id belongs to the class of each of its texts, and null ids are classed like others (a
class with null ids only has a null id); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize
from .components import connected_components

CHUNK = 32_768
#: Bands are two bits wide then.
MOST_RADIUS = 31
#: Up to this radius buckets are made of pairs of bands.
MOST_PAIRED = 7
#: Rows of buckets that are compared in one go, and (fingerprint, block) comparisons in one go.
ROWS_AT_ONCE, TASKS_AT_ONCE = 400_000, 1 << 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, width: int) -> list[bytes]:
    """Lower-cased (A-Z) shingles of `width` words, repeats included; shorter texts give their whole sequence."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash as an unsigned integer; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], stop[:-1] + 1])
        digest, last = xxhash.xxh64_intdigest, width - 1
        hashes = [digest(whole[a:b], seed) for a, b in zip(start[: len(words) - last].tolist(), stop[last:].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, key: Column | None = None) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long. key: a string of the row that comes along as column key."""
    more = [] if key is None else [key.cast("string").alias("key")]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *more)

    names = ["key"] * len(more)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found.view(np.int64)), *map(batch.column, names)], ["_id", "fp", *names])

    return map_texts(rows, work, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long" + ", key string" * len(more)).withColumnRenamed("_id", id_col)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """[blocks, 64]: word k of a block holds bit k of its 64 fingerprints, lane by lane; missing lanes are 0."""
    blocks = -(-len(prints) // 64)
    full = np.zeros(blocks * 64, np.uint64)
    full[: len(prints)] = prints
    bits = np.unpackbits(full.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(blocks, 64, 8).copy().view(np.uint64)[:, :, 0]


def near_lanes(prints: np.ndarray, planes: np.ndarray, row: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For comparisons of fingerprint row[t] with block[t], restricted to the lanes in lanes[t]: which comparisons have a lane
    within the radius (0 to MOST_RADIUS), and those lanes' bits."""
    own = np.arange(len(row))
    digits = [np.zeros(len(row), np.uint64) for _ in range(max(2, radius.bit_length()))]
    over = ~lanes
    wanted = prints[row]
    for k in range(0, 64, 2):
        x = planes[block, k] ^ ((wanted >> np.uint64(k)) & np.uint64(1)) * ONES
        y = planes[block, k + 1] ^ ((wanted >> np.uint64(k + 1)) & np.uint64(1)) * ONES
        half = x ^ y
        carry = (x & y) | (digits[0] & half)
        digits[0] ^= half
        for c in digits[1:]:
            more = c & carry
            c ^= carry
            carry = more
        over |= carry
        if k % 8 == 6:
            alive = over != ONES
            if not alive.all():
                own, row, block, wanted, over, *digits = (z[alive] for z in (own, row, block, wanted, over, *digits))
                if not len(own):
                    break
    near = np.full(len(over), ONES)
    for k, c in enumerate(digits):
        near = near | ~c if radius >> k & 1 else near & ~c
    near &= ~over
    some = near != 0
    return own[some], near[some]


def forest(prints: np.ndarray, bucket_end: np.ndarray, radius: int) -> np.ndarray:
    """label[i]: the smallest row connected with row i by links inside buckets. Rows are sorted by bucket; bucket_end[i] is the
    row after the last of i's bucket."""
    n = len(prints)
    label = np.arange(n)
    planes = bit_planes(prints)
    first = (np.arange(n) + 1) // 64
    count = np.where(bucket_end - np.arange(n) > 1, (bucket_end - 1) // 64 - first + 1, 0)
    todo = np.flatnonzero(count)
    ends = np.cumsum(count[todo])
    at = 0
    while at < len(todo):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TASKS_AT_ONCE, "right")))
        rows = todo[at:upto]
        at = upto
        row = np.repeat(rows, count[rows])
        block = np.arange(len(row)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows]) + first[row]
        low = np.maximum(row + 1 - block * 64, 0).astype(np.uint64)
        high = np.minimum(bucket_end[row] - block * 64, 64).astype(np.uint64)
        lanes = (ONES << low) & (ONES >> (np.uint64(64) - high))
        which, near = near_lanes(prints, planes, row, block, lanes, radius)
        for part in range(0, len(which), 20_000):
            bits = np.unpackbits(near[part : part + 20_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, lane = np.nonzero(bits)
            t = which[part : part + 20_000][t]
            _join(label, row[t], block[t] * 64 + lane)
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i]; afterwards label holds the smallest row of each class again."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jump := label[label], label):
            label[:] = jump


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp, node) sorted by bucket -> edges (a, b) of spanning forests, whole buckets at a time."""

    def solve(bucket: np.ndarray, prints: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(bucket)) + 1
        ends = np.concatenate([edge, [len(bucket)]])
        bucket_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        label = forest(prints.view(np.uint64), bucket_end, radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp", "node")))
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            bucket, prints, node = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            if cut:
                yield solve(bucket[:cut], prints[:cut], node[:cut])
            held, rows = [(bucket[cut:], prints[cut:], node[cut:])], len(bucket) - cut
    if rows:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def bucket_keys(fp: Column, radius: int) -> Column:
    """array<long>: the buckets of a fingerprint. Fingerprints at most radius bits apart share one at least."""
    pairs = 2 if radius <= MOST_PAIRED else 1
    bands = radius + pairs
    edges = [64 * k // bands for k in range(bands + 1)]
    spans = [*zip(edges, edges[1:])]
    chosen = [*itertools.combinations(spans, pairs)]

    def key(parts: tuple[tuple[int, int], ...]) -> Column:
        out = F.lit(0).cast("long")
        for lo, hi in parts:
            out = F.shiftleft(out, hi - lo).bitwiseOR(F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - hi + lo))
        return out

    return F.array(*[key(parts) * len(chosen) + k for k, parts in enumerate(chosen)])


def near_links(nodes: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """nodes (fp, node), fp distinct -> edges (a, b) between nodes; they connect exactly the nodes that links connect."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radii are 0 to {MOST_RADIUS}")
    dealt = nodes.select("fp", "node", F.explode(bucket_keys(F.col("fp"), radius)).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / chunk))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.least(k, F.col("mine")) * F.col("parts") + F.greatest(k, F.col("mine")))
    rows = (
        dealt.join(sizes, "key")
        .withColumn("mine", mine)
        .select("fp", "node", "key", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(cells)).alias("cell"))
        .select(F.xxhash64("key", "cell").alias("bucket"), "fp", "node")
    )
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, seed: int = 42, key: Column | None = None) -> DataFrame:
    """One row per input row: id, fp (64 bits as a signed long), component_id (smallest id of its class). Ids are integers.
    With key, also key and class_fp (smallest fingerprint of the class), which tell rows and classes apart where ids don't."""
    more = [] if key is None else ["key"]
    prints = materialize(fingerprints(docs, id_col, text_col, width, seed, key).select(F.col(f"`{id_col}`").cast("long").alias("_id"), "fp", *more), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-nodes")
    classes = connected_components(near_links(nodes.select("fp", F.col("fp").alias("node")), radius))
    placed = nodes.join(classes, nodes.fp == classes.node, "left").select("fp", "least", "component")
    alone = placed.where("component is null").select("fp", F.col("fp").alias("class_fp"), F.col("least").alias("component_id"))
    linked = placed.where("component is not null")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = alone.unionByName(linked.join(least, "component").select("fp", F.col("component").alias("class_fp"), "component_id"))
    return prints.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", *[c for c in ("key", "class_fp") if more])
