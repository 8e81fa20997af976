import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roomwright.llm.bpe import Codec, bpe_decode, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n\nb  \n", "\n", "don't stop, it's 12345 o'clock!!", "x<|endoftext|>y", "<|endoftext|>",
    " <|endoftext|> <|endoftext|>", "Éréier enqueeau de, les là", "日本語 テキスト", "a b c　d", "\x1c\x1d a\x1fb", "\x85x\x85", "é́ ‍",
    "x" * 5000, "ab" * 700 + " " + "é" * 900, "tab\tsep\t\tx", "🙂🙂 🙂", "word " * 300,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode(text)
    assert list(memoryview(packed).cast("I")) == ids, text[:80]
    assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_equals_the_library(library):
    codec = Codec(PATH)
    for text in TEXTS:
        same(codec, library, text)
    rng = random.Random(7)
    letters = list("ab cdeé \n\t'sTt1290.,;-_#日🙂 ́\x1c") + ["<|endoftext|>", "the ", "  "]
    for _ in range(2000):
        same(codec, library, "".join(rng.choices(letters, k=rng.randint(0, 40))))


def test_scan_and_heap_merge_alike():
    codec = Codec(PATH)
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choices(b"aabehinort ", k=rng.randint(2, 120)))
        assert codec._merge_scan(data) == codec._merge_heap(data)


def test_rows(spark, library):
    rows = [(k, t, "x", k) for k, t in enumerate(TEXTS)] + [(None, "again", "x", 1), (1, "again", "x", 1), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    got = bpe_encode(docs, PATH, decode=True)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = sorted((str(i), len(e := library.encode(t or "", add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in got.collect()) == want
    back = bpe_decode(got.select("doc_id", "ids"), PATH)
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == sorted((a, c) for a, _, c in want)
    assert bpe_encode(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    from roomwright.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op6_bpe_codec"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids, skip_special_tokens=False)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
