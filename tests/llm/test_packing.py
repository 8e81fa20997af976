import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from roomwright.llm import packing
from roomwright.llm.registry import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    own = Tokenizer.from_file(PATH)
    return [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_stretches_equal_whole_texts():
    rng = random.Random(5)
    letters = list("abC dDé \n\t'sT129.,;Σσ日🙂 ́\x1c\x85İ") + ["<|endoftext|>", "the ", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "x" * 3000]
    own = packing.StretchTokenizer(PATH)
    ids, sizes = own.flat(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library_ids(texts)


def test_hilbert_key_visits_every_cell_by_unit_steps():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def check_pieces(pieces, texts, length, end_id):
    """pieces: rows; texts: {id: text}. Everything the contract says about pieces."""
    ids = dict(zip(texts, [x + [end_id] for x in library_ids([t or "" for t in texts.values()])]))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        at = 0
        for p in own:
            part = np.array(ids[i][at : at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[i]), zlib.crc32(part)) and p.length > 0
            at += p.length
        assert at == len(ids[i])
    sizes = []
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        ends = list(itertools.accumulate(p.length for p in own))
        assert [p.offset for p in own] == [0, *ends[:-1]] and ends[-1] <= length
        sizes.append(ends[-1])
    assert sum(s < length for s in sizes) <= 1


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    texts = {1: "a few words", 2: None, 3: "", 4: "long text " * 700, 5: "a few words", 6: "\x1c odd"}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, ids string, n int")
    got = packing.pack(docs, PATH, length=64).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(got, texts, 64, 2)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = packing.pack(docs.where("doc_id = 1").unionAll(docs.where("doc_id = 1")).withColumn("doc_id", F.lit(None).cast("long")), PATH)
    assert twice.count() == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_pieces(QUERIES["op10_packing"](spark, sf).collect(), texts, 4096, 2)


def test_neighbours_share_words(spark):
    """Documents of one vocabulary lie together on the curve: far fewer changes of kind along it than by chance."""
    rng = random.Random(1)
    words = {k: [f"{k}{a}" for a in "bcdfghklmnprst"] for k in "aeou"}
    texts = [(i, " ".join(rng.choices(words["aeou"[i % 4]], k=60))) for i in range(200)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, length=1 << 20).orderBy("offset").collect()
    kinds = [r.doc_id % 4 for r in rows]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) < 60
