"""Packing token sequences along a Hilbert curve.

Every document's token ids are hashed into a vector (square roots of bucket counts, unit length), projected to `AXES`
coordinates by a seeded Gaussian matrix, and given its place on a Hilbert curve through that cube. Documents are put in the
order of that place (ties by id) by a range partitioning of ids and counts only; a running sum gives each document its
position in the one long stream of tokens, which is cut every `length` tokens. So neighbours on the curve share
sequences, only the very last sequence is short, and no step needs more than one document's ids at a time.

Texts are split at ASCII white space and the distinct stretches are encoded by the tokenizers library: the vocabulary's
pretokenizer drops white space and never matches across it, so a text's ids are those of its stretches in order.

Defined results: a null text is empty and has the end id only; a text of any length is cut into as many pieces as it
needs; repeated rows are packed as often as they occur; null ids come first among ties; an empty table gives no pieces;
extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import materialize, text_batches

BUCKETS, AXES, BITS, SEED = 512, 4, 15, 77
CACHE_WORDS = 200_000
#: Bytes of text that are split together: more than elsewhere, as each batch looks its distinct stretches up once.
SPLIT_BYTES = 8 << 20


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of coordinates (integers below 2**bits) on the Hilbert curve, after Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(axes):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | (x[k] >> b & 1)
    return key


def curve_places(counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed bucket counts [documents, BUCKETS]."""
    vectors = np.sqrt(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    matrix = np.random.default_rng(SEED).standard_normal((BUCKETS, AXES))
    cells = np.clip((vectors @ matrix / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells, BITS)


class StretchTokenizer:
    """Ids of texts by the tokenizers library, with the ids of recent stretches and words kept.

    Most stretches are letters and then perhaps marks. The vocabulary's pretokenizer cuts such a stretch between the two and
    lower-cases it, so its ids are those of the lower-case letters and of the marks, each by the library's merging model;
    any other stretch goes through the whole library.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.size = self.own.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.model = self.own.model.tokenize
        self.bytes = {b: c for c, b in byte_letters().items()}
        self.seen: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.simple = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)\Z")
        self.bucket = ((np.arange(self.size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % BUCKETS

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of each text's ids.

        Arrow cuts the texts at ASCII white space, where the pretokenizer cuts too, and numbers the distinct stretches.
        """
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        packed = self._packed(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        ids, begins = np.frombuffer(b"".join(packed), self.kind), np.cumsum(sizes) - sizes
        taken = sizes[which]
        ends = np.cumsum(taken)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[which] - (ends - taken), taken)
        text_ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        stops = np.concatenate([[0], ends])[text_ends]
        return ids[at], np.diff(stops, prepend=0)

    def forget(self) -> None:
        self.seen, self.words = {}, {}

    def _packed(self, stretches: list[str]) -> list[bytes]:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        seen, match, word, other = self.seen, self.simple.match, self._word, []
        for x in stretches:
            if x not in seen:
                if m := match(x):
                    seen[x] = word(m[1].lower()) + word(m[2]) if m[2] else word(m[1].lower())
                else:
                    other.append(x)
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            found = self.own.encode_batch_fast(part, add_special_tokens=False)
            seen.update(zip(part, (np.array(e.ids, self.kind).tobytes() for e in found)))
        return list(map(seen.__getitem__, stretches))

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            raw = word if word.isascii() else "".join(map(self.bytes.__getitem__, word.encode()))
            ids = self.words[word] = array(self.code, [t.id for t in self.model(raw)]).tobytes()
        return ids


_tokenizers: dict[str, StretchTokenizer] = {}


def tokenizer(path: str) -> StretchTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = StretchTokenizer(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, place, n, ids): ids packed in 16 bits each where the vocabulary allows it, else in 32."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in text_batches(batches, size=SPLIT_BYTES):
            ids, sizes = own.flat(batch.column("text"))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            text = np.repeat(np.arange(batch.num_rows), sizes)
            counts = np.bincount(text * BUCKETS + own.bucket[ids], minlength=batch.num_rows * BUCKETS).reshape(-1, BUCKETS)
            stops = np.concatenate([[0], np.cumsum(sizes)]) * own.kind.itemsize
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(ids.astype(own.kind))])
            columns = [batch.column("row"), batch.column("id"), pa.array(curve_places(counts)), pa.array(sizes, pa.int64()), packed]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "place", "n", "ids"])
        own.forget()  # a worker that waits for the next task, perhaps of another stage, holds no tables

    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, place long, n long, ids binary")


def stream_positions(sizes: DataFrame) -> DataFrame:
    """(row, at): where each row of (row, id, place, n) begins in the stream ordered by place, id and row.

    Rows are range-partitioned; the driver sees one sum per partition, and running sums stay inside partitions.
    """
    spark = sizes.sparkSession
    ordered = materialize(sizes.repartitionByRange("place", "id", "row").withColumn("part", F.spark_partition_id()), "packing-order")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    begins, total = [], 0
    for r in sums:
        begins.append((r.part, total))
        total += r.n
    offsets = spark.createDataFrame(begins, "part int, begin long")
    own = W.partitionBy("part").orderBy("place", "id", "row")
    running = F.sum("n").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    return ordered.withColumn("inside", running).join(F.broadcast(offsets), "part").select("row", (F.col("begin") + F.col("inside")).alias("at"))


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id column, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    vocabulary: path of the vocabulary file on every worker. end_id closes every document. Sequences are numbered along the
    curve; all are full but the last.
    """
    table = materialize(tokenized(docs, vocabulary, end_id, id_col, text_col), "packing-ids")
    placed = table.select("row", "id", "ids", "n").join(stream_positions(table.select("row", "id", "place", "n")), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "ids"):
            source, start, size, ids, sequence, offset, whole = [], [], [], [], [], [], []
            for k, (packed, n, at) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), batch.column("at").to_pylist())):
                values = np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype("<u4")
                a = 0
                while a < n:
                    b = min(n, a + length - (at + a) % length)
                    source.append(k)
                    start.append(a)
                    size.append(b - a)
                    ids.append(values[a:b].tobytes())
                    sequence.append((at + a) // length)
                    offset.append((at + a) % length)
                    whole.append(n)
                    a = b
            own = batch.column("id").take(pa.array(source, pa.int64()))
            columns = [own, *(pa.array(x, pa.int64()) for x in (start, size)), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (whole, sequence, offset))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = table.schema["id"].dataType.simpleString()
    out = placed.mapInArrow(run, f"_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
