"""Approximate nearest neighbours by inner product: low-dimensional stable projections, indexed by kd-trees.

Vectors get one more coordinate that brings all to the same length, so that a larger inner product means a smaller distance.
`AXES` Gaussian projections keep distances up to a chi-square factor: for vectors at distance d the squared projected
distance over d squared has a chi-square distribution with AXES degrees of freedom. A search takes the points in the order
of their projected distance, in kd-tree leaves, verifies each leaf's points on the original vectors, and stops when the
next leaf is so far that a point closer than the k-th one found so far would be projected that far with a probability
under 1 - `CONFIDENCE`.

Distribution: a kd-tree over a bounded sample of projections (`SAMPLE_ROWS`, chosen by a hash of the id) cuts the
projected space into cells; every row is indexed in its cell, and cells with many rows are cut further by a hash of the
vector, so that a shard holds about `SHARD_ROWS`. A query first searches one shard of its own cell, which bounds its
distances, and then only those other shards whose bounding boxes the stopping test does not exclude. Queries go to shards
in blocks; each task holds one shard and one block.

Equal vectors score equally against everything, so of each group of equal vectors only the k + 1 smallest ids can be in a
result; the others ask, but are left out of the shards, by a group limit that acts before the shuffle, so that a vector with
very many copies gathers in no task. Of different vectors that tie with the k-th score, those with the smaller ids stay.

Defined results: vectors that are null, all zero, or have null or non-finite components take no part, nor do vectors of
another length than most or rows without id; a row is never its own neighbour (rows are told apart by id); equal scores go
to the smaller id; with fewer than k candidates all are returned; repeated rows count once; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

AXES, SEED, CONFIDENCE = 8, 11, 0.95
SAMPLE_ROWS, SHARD_ROWS, LEAF_ROWS = 20_000, 16_384, 128
#: Queries of a block that goes to a shard, queries that a shard searches at a time, and leaves of one verification step.
BLOCK_QUERIES, QUERIES_AT_ONCE, LEAVES_AT_ONCE = 32_768, 512, 8
MOST_CELLS = 4_096
FOUND = "query_id long, vec_id long, score double"


def chi_square_bound(confidence: float, freedom: int = AXES) -> float:
    """The value that a chi-square variable of even freedom stays under with the given probability."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))
        low, high = (x, high) if 1 - tail < confidence else (low, x)
    return high


@dataclass
class Space:
    """Projection of vectors of one length, brought to a common norm."""

    size: int
    norm: float

    def __post_init__(self) -> None:
        self.matrix = np.random.default_rng(SEED).standard_normal((self.size + 1, AXES))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix[:-1]

    def squared_distance(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distance of a query from a point with that inner product."""
        return np.maximum((queries**2).sum(axis=1) + self.norm**2 - 2 * score, 0)


@dataclass
class Cuts:
    """A kd-tree's inner nodes: axis (or -1 - cell at a leaf), value, and children."""

    axis: list[int]
    value: list[float]
    below: list[int]
    above: list[int]

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Cuts:
        out = cls([], [], [], [])
        count = 0

        def add(rows: np.ndarray, share: int) -> int:
            nonlocal count
            node = len(out.axis)
            for column, x in ((out.axis, -1), (out.value, 0.0), (out.below, -1), (out.above, -1)):
                column.append(x)
            own = points[rows]
            spread = np.ptp(own, axis=0) if len(rows) else np.zeros(AXES)
            if share > 1 and spread.max() > 0:
                axis = int(spread.argmax())
                value = float(np.median(own[:, axis]))
                low = own[:, axis] <= value
                if not low.all():
                    out.axis[node], out.value[node] = axis, value
                    out.below[node] = add(rows[low], share // 2)
                    out.above[node] = add(rows[~low], share - share // 2)
                    return node
            out.axis[node] = -1 - count
            count += 1
            return node

        add(np.arange(len(points)), cells)
        return out

    def cell(self, points: np.ndarray) -> np.ndarray:
        axis, value, below, above = (np.array(x) for x in (self.axis, self.value, self.below, self.above))
        node = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(axis[node] >= 0)):
            here = node[inner]
            low = points[inner, axis[here]] <= value[here]
            node[inner] = np.where(low, below[here], above[here])
        return -1 - axis[node]


def leaves_of(points: np.ndarray, rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Row numbers of a kd-tree's leaves of at most `rows` points."""
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            out.append(own)
            continue
        axis = int(np.ptp(points[own], axis=0).argmax())
        half = np.argpartition(points[own, axis], len(own) // 2)
        todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[points, boxes]: squared distances of points from boxes."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p = points[:, k : k + 1]
        out += np.maximum(np.maximum(low[:, k] - p, p - high[:, k]), 0) ** 2
    return out


class Shard:
    """The searchable index of some rows. Rows of `vectors` are in the order of their smallest ids."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, same = np.unique(vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.space, self.k, self.verified, self.asked = space, k, 0, 0
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, same = first[order], place[same.ravel()]
        self.vectors = vectors[first]
        by = np.argsort(same, kind="stable")
        begins = np.searchsorted(same[by], np.arange(len(first)))
        self.ids = [np.unique(ids[by[a:b]])[: k + 1] for a, b in zip(begins, [*begins[1:], len(by)])]
        points = space.points(self.vectors)
        self.leaves = leaves_of(points)
        self.low = np.array([points[leaf].min(axis=0) for leaf in self.leaves])
        self.high = np.array([points[leaf].max(axis=0) for leaf in self.leaves])

    def search(self, ids: np.ndarray, queries: np.ndarray, known: np.ndarray, bound: float) -> list[tuple[int, int, float]]:
        """(query id, id, score) of the best k of each query; known: squared distances within which k are known already."""
        out: list[tuple[int, int, float]] = []
        for at in range(0, len(ids), QUERIES_AT_ONCE):
            part = slice(at, at + QUERIES_AT_ONCE)
            best, score = self._verify(queries[part], known[part], bound)
            for q, rows, scores in zip(range(at, at + len(best)), best, score):
                out += self._named(int(ids[q]), queries[q], rows[scores > -np.inf])
        return out

    def _verify(self, queries: np.ndarray, known: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        n, keep = len(queries), self.k + 1
        far = box_distance(self.space.queries(queries), self.low, self.high)
        order = np.argsort(far, axis=1)
        best, score = np.zeros((n, keep), np.int64), np.full((n, keep), -np.inf)
        active = np.arange(n)
        noise = 1e-12 * np.linalg.norm(queries, axis=1) * max(1.0, self.space.norm)
        self.asked += n * len(self.leaves)
        for wave in range(0, len(self.leaves), LEAVES_AT_ONCE):
            kth = self.space.squared_distance(queries[active], np.where(np.isfinite(score[active, -1]), score[active, -1], -1e200))
            limit = bound * np.minimum(kth, known[active])
            active = active[far[active, order[active, wave]] <= limit]
            if not len(active):
                break
            mine = order[active, wave : wave + LEAVES_AT_ONCE]
            self.verified += mine.size
            found_rows, found_score = [best[active]], [score[active]]
            width = max(len(leaf) for leaf in self.leaves)
            rows = np.zeros((len(active), mine.shape[1] * width), np.int64)
            value = np.full(rows.shape, -np.inf)
            for leaf in np.unique(mine):
                q, slot = np.nonzero(mine == leaf)
                own = self.leaves[leaf]
                to = slot[:, None] * width + np.arange(len(own))
                rows[q[:, None], to] = own
                value[q[:, None], to] = queries[active[q]] @ self.vectors[own].T
            found_rows.append(rows)
            found_score.append(value)
            rows, value = np.concatenate(found_rows, axis=1), np.concatenate(found_score, axis=1)
            top = np.argpartition(-value, keep - 1, axis=1)[:, :keep]
            least = np.take_along_axis(value, top, axis=1).min(axis=1) - noise[active]
            for q in np.flatnonzero(((value >= least[:, None]).sum(axis=1) > keep) & (least > -np.inf)):
                near = np.flatnonzero(value[q] >= least[q])  # ties with the last: settled by exact score and smallest id
                exact = (self.vectors[rows[q, near]] * queries[active[q]]).sum(axis=1)
                top[q] = near[np.lexsort((rows[q, near], -exact))[:keep]]
            value = np.take_along_axis(value, top, axis=1)
            sort = np.argsort(-value, axis=1, kind="stable")
            score[active] = np.take_along_axis(value, sort, axis=1)
            best[active] = np.take_along_axis(np.take_along_axis(rows, top, axis=1), sort, axis=1)
        return best, score

    def _named(self, own: int, query: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, float]]:
        """The best k ids among the rows' groups. The scores are summed alike for every row, so that equal vectors tie exactly."""
        exact = (self.vectors[rows] * query).sum(axis=1)
        found = [(-s, int(i)) for s, r in zip(exact.tolist(), rows) for i in self.ids[r] if i != own]
        return [(own, i, -s) for s, i in sorted(found)[: self.k]]


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, Space | None]:
    """(id, v): usable vectors as arrays of doubles, and their space (None if there are none)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
    most = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    if not most:
        return rows, None
    return rows.where(F.size("v") == most[0].size), Space(most[0].size, most[0].norm)


def nearest_neighbours(table: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row for which the condition `queries` on the
    column id holds (a function of that column), among all other rows."""
    spark = table.sparkSession
    rows, space = valid_vectors(table, id_col, vec_col)
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = rows.count()
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) / 1e6
    sample = rows.where(chance < min(1.0, SAMPLE_ROWS / total)).select("v").collect()
    cells = min(MOST_CELLS, max(1, -(-total // SHARD_ROWS)))
    cuts = Cuts.fit(space.points(np.array([r.v for r in sample], float).reshape(-1, space.size)), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, space.size)
            points = space.points(vectors)
            packed = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cuts.cell(points)), packed, pa.array(list(points), pa.list_(pa.float64()))], ["id", "cell", "v", "p"])

    placed = "id long, cell long, v binary, p array<double>"
    same_vector = W.partitionBy("cell", "v").orderBy("id")
    every_row = rows.mapInArrow(place, placed).dropDuplicates(["id", "v"])
    index = materialize(every_row.withColumn("n", F.row_number().over(same_vector)).where(F.col("n") <= k + 1).drop("n"), "ann-index")
    #: One row per cell: its size and its bounding box.
    box = [F.min(F.get("p", F.lit(a))).alias(f"low{a}") for a in range(AXES)] + [F.max(F.get("p", F.lit(a))).alias(f"high{a}") for a in range(AXES)]
    stats = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *box).orderBy("cell").collect()
    parts = {r.cell: -(-r.n // SHARD_ROWS) for r in stats}
    low = np.array([[r[f"low{a}"] for a in range(AXES)] for r in stats])
    high = np.array([[r[f"high{a}"] for a in range(AXES)] for r in stats])
    names = [r.cell for r in stats]
    part_of = F.create_map(*[F.lit(x) for c, n in parts.items() for x in (c, n)])
    in_part = F.pmod(F.xxhash64("v", F.lit(3)), F.element_at(part_of, F.col("cell")))
    shards = index.select(F.struct("cell", in_part.alias("part")).alias("shard"), "id", "v")
    asked = materialize(rows.where(queries(F.col("id"))).mapInArrow(place, placed).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("s")).select("id", "s.v", "s.cell"), "ann-queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(blocks))
    bound = chi_square_bound(confidence)

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            shard = Shard(space, right.column("id").to_numpy(), _matrix(right.column("v"), space.size), k)
            out = shard.search(left.column("id").to_numpy(), _matrix(left.column("v"), space.size), left.column("known").to_numpy(), bound)
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    def found(routed: DataFrame) -> DataFrame:
        """routed: shard, id, v, known -> each shard's best."""
        points = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))) if blocks > 1 else shards.withColumn("block", F.lit(0).cast("long"))
        asking = routed.withColumn("block", block)
        return asking.groupBy("shard", "block").cogroup(points.groupBy("shard", "block")).applyInArrow(search, FOUND)

    home = F.struct("cell", F.pmod(F.xxhash64("id"), F.element_at(part_of, F.col("cell"))).alias("part"))
    first = materialize(found(asked.select(home.alias("shard"), "id", "v", F.lit(float("inf")).alias("known"))), "ann-first")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    rest = asked.withColumn("home", home).join(kth.withColumnRenamed("query_id", "id"), "id", "left")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors = _matrix(part.column("v"), space.size)
                full = np.array([(n or 0) >= k for n in part.column("n").to_pylist()], bool)
                least = np.array([x if x is not None else 0.0 for x in part.column("least").to_pylist()], float)
                known = np.where(full, space.squared_distance(vectors, least), np.inf)
                near = box_distance(space.queries(vectors), low, high) <= bound * known[:, None]
                own = part.column("home").to_pylist()
                to = [(q, names[c], p) for q, c in zip(*np.nonzero(near)) for p in range(parts[names[c]]) if (names[c], p) != (own[q]["cell"], own[q]["part"])]
                if to:
                    take = pa.array([q for q, _, _ in to], pa.int64())
                    shard = pa.StructArray.from_arrays([pa.array([c for _, c, _ in to], pa.int64()), pa.array([p for _, _, p in to], pa.int64())], ["cell", "part"])
                    yield pa.RecordBatch.from_arrays([shard, part.column("id").take(take), part.column("v").take(take), pa.array(known[[q for q, _, _ in to]])], ["shard", "id", "v", "known"])

    routed = rest.select("id", "v", "home", "n", "least").mapInArrow(route, "shard struct<cell:long,part:long>, id long, v binary, known double")
    every = first.unionByName(found(routed)).distinct()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
