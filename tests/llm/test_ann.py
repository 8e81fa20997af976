import numpy as np
import pytest

from roomwright.llm import ann
from roomwright.llm.registry import QUERIES


def brute_force(ids, vectors, queries, k):
    out = {}
    for q in queries:
        row = vectors[ids.index(q)]
        scores = [(-float((v * row).sum()), i) for i, v in zip(ids, vectors) if i != q]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, best in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:]))
        hits += len({r.vec_id for r in mine} & {i for i, _ in best})
        total += len(best)
    return hits / max(1, total)


def test_chi_square_bound():
    assert ann.chi_square_bound(0.95) == pytest.approx(15.507, abs=0.01)


def test_shards_cells_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 150), ("LEAF_ROWS", 16), ("BLOCK_QUERIES", 20), ("LEAVES_AT_ONCE", 2)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24)) * 3
    vectors = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * rng.uniform(0.2, 1.5, (900, 1))
    vectors[100:400] = vectors[100]  # one vector holds a third of the rows
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(table, lambda i: i % 20 == 0, k=20).collect()
    want = brute_force(list(range(900)), vectors, list(range(0, 900, 20)), 20)
    assert recall(got, want) > 0.95
    copies = {r.vec_id for r in got if r.query_id == 200}
    assert copies == {i for i, _ in want[200]}


def test_odd_rows(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (9, [2.0, 1.0]), (9, [2.0, 1.0]), (11, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 1.0]), (40, None), (60, [])]
    table = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, id string, score double")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(table, lambda i: i % 20 == 0, k=3).collect())
    assert got == [(0, 1, 9, 2.0), (0, 2, 10, 1.0), (0, 3, 11, 1.0), (20, 1, 9, 1.5), (20, 2, 0, 0.5), (20, 3, 10, 0.5)]
    assert ann.nearest_neighbours(table.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest_neighbours(table.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute_force(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    got = QUERIES["op1_ann_search"](spark, f"/root/testdata/{sf}").collect()
    found = recall(got, want)
    print("recall", found)
    assert found >= 0.9
    exact = {(q, i): s for q, best in want.items() for i, s in best}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_ties_between_different_vectors_go_to_the_smaller_ids(spark, monkeypatch):
    """400 different vectors have one inner product with the query, more than a wave of leaves verifies at once."""
    rng = np.random.default_rng(3)
    for leaves, rows in ((8, 128), (2, 16), (64, 16)):
        monkeypatch.setattr(ann, "LEAVES_AT_ONCE", leaves)
        monkeypatch.setattr(ann, "LEAF_ROWS", rows)
        vectors = np.concatenate([[[1.0, 0, 0, 0, 0]], np.hstack([np.ones((400, 1)), rng.normal(size=(400, 4)).round(2)]), np.hstack([np.full((200, 1), 0.5), rng.normal(size=(200, 4))])])
        vectors[100:130] = vectors[100]  # copies tie with the others as well
        ids = [0, *(rng.permutation(600) + 1).tolist()]
        space = ann.Space(5, float(np.linalg.norm(vectors, axis=1).max()))
        shard = ann.Shard(space, np.array(ids), vectors, 20)
        got = shard.search(np.array([0]), vectors[:1], np.array([np.inf]), 1e9)
        want = brute_force(ids, vectors, [0], 20)[0]
        assert [(i, s) for _, i, s in got] == want and {s for _, s in want} == {1.0}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(table, lambda i: i == 0, k=20, confidence=0.999999).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for i, _ in want]


def test_copies_beyond_k_still_ask(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 200, 2)] + [(1, [3.0, 1.0]), (1, [3.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.query_id: [] for r in ann.nearest_neighbours(table, lambda i: i % 20 == 0, k=3).collect()}
    assert set(got) == set(range(0, 200, 20))  # all vectors here tie
    for r in ann.nearest_neighbours(table, lambda i: i % 20 == 0, k=3).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(v == [i for i in (0, 1, 2, 4) if i != q][:3] for q, v in got.items())


def test_stopping_test_prunes_clustered_vectors():
    """The share of leaves that a shard verifies, at the recall that the confidence promises."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(64, 64))
    vectors = centres[rng.integers(0, 64, 8000)] + 0.15 * rng.normal(size=(8000, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids = np.arange(8000)
    shard = ann.Shard(ann.Space(64, 1.0), ids, vectors, 20)
    asked = ids[ids % 20 == 0]
    got = {}
    for q, i, _ in shard.search(asked, vectors[asked], np.full(len(asked), np.inf), ann.chi_square_bound(ann.CONFIDENCE)):
        got.setdefault(q, set()).add(i)
    want = brute_force(ids.tolist(), vectors, asked[:100].tolist(), 20)
    found = sum(len(got[q] & {i for i, _ in best}) for q, best in want.items()) / 2000
    print("share of leaves verified", shard.verified / shard.asked, "recall", found)
    assert found > 0.95 and shard.verified < 0.5 * shard.asked
