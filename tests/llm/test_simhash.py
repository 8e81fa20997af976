import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roomwright.llm import simhash
from roomwright.llm.components import connected_components
from roomwright.llm.registry import QUERIES


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_classes(prints):
    """prints: {id: fingerprint} -> {id: smallest id reachable}, by comparing all pairs."""
    ids = sorted(prints)
    arr = np.array([prints[i] for i in ids], np.uint64)
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


@pytest.mark.parametrize("text", ["", " \n", "One", "A b", "A b C", "a b c d A B C", "É É x y z\x0bw", "w " * 3000, "long" * 40000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def random_prints(rng, n):
    found = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(found) < n:
        x = rng.choice(found)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        found.append(x)
    return list(dict.fromkeys(found))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_forest_is_brute_force(radius):
    prints = np.array(random_prints(random.Random(radius), 700), np.uint64)
    ends = np.repeat([150, 151, 420, len(prints)], [150, 1, 269, len(prints) - 420])
    label = simhash.forest(prints, ends, radius)
    want = list(range(len(prints)))
    begin = 0
    for end in [150, 151, 420, len(prints)]:
        for _ in range(60):
            for i in range(begin, end):
                near = begin + np.flatnonzero(np.bitwise_count(prints[begin:end] ^ prints[i]) <= radius)
                want[i] = min(want[j] for j in near)
        begin = end
    assert label.tolist() == want


@pytest.mark.parametrize("radius", [4, 7, 11, 15, 31])
def test_wide_radii_link_all_near_pairs(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for x in prints[:150]:
        for bit in rng.sample(range(64), rng.choice([radius, radius + 1])):
            x ^= 1 << bit
        prints.append(x)
    arr = np.array(prints, np.uint64)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(prints)], "fp long, node long")
    found = {r.node: r.component for r in connected_components(simhash.near_links(nodes, radius=radius)).collect()}
    label = np.arange(len(arr))
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= radius
    while not np.array_equal(least := np.where(near, label[None, :], len(arr)).min(axis=1), label):
        label = least
    assert [found.get(k, k) for k in range(len(prints))] == label.tolist()


@pytest.mark.parametrize("chunk", [40, simhash.CHUNK])
def test_links_connect_what_brute_force_connects(spark, chunk):
    rng = random.Random(11)
    prints = random_prints(rng, 600)
    prints += [prints[0] & ~0xFFFF | k for k in range(300)]  # a bucket over the small chunk size
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(prints)], "fp long, node long")
    found = {r.node: r.component for r in connected_components(simhash.near_links(nodes, chunk=chunk)).collect()}
    assert {k: found.get(k, k) for k in range(len(prints))} == plain_classes(dict(enumerate(prints)))


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, None, None), (8, "", None), (7, "  \n", None), (None, "alone here now then", "x"), (1, "w " * 9000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_classes(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 7), (8, 7), (7, 7), (None, None), (1, 1)], key=str)
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    prints = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    classes = plain_classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_dedup"](spark, sf).collect()}
    assert got == {i: (f"{p:016x}", classes[i]) for i, p in prints.items()}


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 7, 8])
def test_near_fingerprints_share_a_bucket(spark, radius):
    rng = random.Random(radius)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), radius):
            y ^= 1 << bit
        pairs.append([v - (1 << 64) if v >> 63 else v for v in (x, y)])
    table = spark.createDataFrame(pairs, "x long, y long")
    shared = table.where(F.arrays_overlap(simhash.bucket_keys(F.col("x"), radius), simhash.bucket_keys(F.col("y"), radius)))
    assert shared.count() == 200
    keys = table.select(F.explode(simhash.bucket_keys(F.col("x"), radius)).alias("k")).groupBy("k").count()
    assert radius > 3 or keys.where("count > 1").count() == 0  # wide keys: unrelated fingerprints meet in none
