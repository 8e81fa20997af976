"""Byte-level BPE encoding and decoding, with a contiguous rank array per short word.

A word (a match of the pretokenizer's pattern) is held as a contiguous list of the parts between its boundaries and a list
with the merge rank of each adjacent pair of parts. The smallest rank is searched, its boundary deleted, and the two neighbouring ranks
refreshed, until no pair can merge. Scanning is quadratic in the word's length, so words over `LONG_WORD` bytes take
their minimum from a heap instead; the merges and the result are the same.

Results of words and of whole stretches between single spaces are remembered in two tables per Python worker, emptied
when they reach `CACHE_WORDS` entries between two texts or about `CACHE_BYTES` inside one; words and stretches over
`LONG_WORD` characters are not remembered.

Defined results: a null text counts as empty and gives no ids; texts of any length are encoded whole; the strings of
special tokens become their ids, as in the vocabulary file's own library; rows are independent of each other, so ties,
repeated rows, null ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

CACHE_WORDS, CACHE_BYTES = 400_000, 80 << 20
LONG_WORD = 200

#: Unicode's White_Space, which the vocabulary's pattern means by \s.
SPACE = "\\t-\\r " + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The alternatives of the pretokenizer that the vocabulary was made with.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Memo(dict):
    """A dict that computes what it lacks."""

    def __init__(self, compute):
        self.compute, self.held = compute, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= LONG_WORD:
            self.held += len(key) + len(value) + 200  # the two objects themselves
            if self.held > CACHE_BYTES:
                self.clear()
            self[key] = value
        return value

    def clear(self):
        super().clear()
        self.held = 0


class Codec:
    """Encodes texts into packed ids (little-endian unsigned 32-bit integers) and decodes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        #: Rank of a pair of adjacent parts, by the ids of both in one integer, and the id that each rank makes.
        self.rank = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.token = [b""] * size
        for b, i in self.ids.items():
            self.token[i] = b
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.words = regex.compile(PATTERN)
        #: A space after which the next stretch does not begin with a visible character: such texts are matched whole.
        self.unsafe = re.compile(r" (?:\s|\Z)")
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.by_word = _Memo(self._word)
        self.by_stretch = _Memo(lambda stretch: self._matched(" " + stretch))

    def _word(self, word: str) -> bytes:
        data = word.encode()
        parts = self._merge_heap(data) if len(data) > LONG_WORD else self._merge_scan(data)
        return array("I", parts).tobytes()

    def _merge_scan(self, data: bytes) -> list[int]:
        """Ids of the parts, by repeated scans for the smallest rank. parts[k] lies between boundaries k and k + 1, and ranks[k] is
        the rank of joining it with its right neighbour; deleting parts[k + 1] deletes the boundary between them."""
        none = len(self.made)
        find, made, single = self.rank.get, self.made, self.single
        parts = [single[b] for b in data]
        ranks = [find(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            k = ranks.index(least)
            joined = parts[k] = made[least]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = find(joined << 32 | parts[k + 1], none)
            if k:
                ranks[k - 1] = find(parts[k - 1] << 32 | joined, none)
        return parts

    def _merge_heap(self, data: bytes) -> list[int]:
        """The same ids for a long word: ranks in a heap, parts in a linked list."""
        n = len(data)
        parts = [self.single[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.rank.get
        heap = [(r, k) for k in range(n - 1) if (r := find(parts[k] << 32 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k]
            if parts[k] < 0 or right >= n or find(parts[k] << 32 | parts[right]) != r:
                continue  # one of the two has changed since
            parts[k], parts[right] = self.made[r], -1
            after[k] = stop = after[right]
            if stop < n:
                before[stop] = k
                if (r := find(parts[k] << 32 | parts[stop])) is not None:
                    heapq.heappush(heap, (r, k))
            if (left := before[k]) >= 0 and (r := find(parts[left] << 32 | parts[k])) is not None:
                heapq.heappush(heap, (r, left))
        return [p for p in parts if p >= 0]

    def _matched(self, text: str) -> bytes:
        return b"".join(map(self.by_word.__getitem__, self.words.findall(text)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. Between single spaces, each followed by a visible character, no match of the
        pattern crosses a space's left side, so the stretches can be encoded one by one."""
        if self.unsafe.search(text):
            return self._matched(text)
        first, *rest = text.split(" ")
        return self._matched(first) + b"".join(map(self.by_stretch.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if len(self.by_word) > CACHE_WORDS:
            self.by_word.clear()
        if len(self.by_stretch) > CACHE_WORDS:
            self.by_stretch.clear()
        if not self.split or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.split.split(text))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Per row: the id column, n_tokens, ids (packed little-endian unsigned 32-bit integers) and, with decode, decoded: the text
    that those ids give back. vocabulary: path of the vocabulary file on every worker."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        ids = [own.encode(text) for text in batch.column("text").to_pylist()]
        columns = [batch.column("_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        names = ["_id", "n_tokens", "ids"]
        if decode:
            columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["_id"].dataType.simpleString()
    out = map_texts(rows, work, f"_id {kind}, n_tokens long, ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("_id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col, the text of the packed ids in ids_col (null ids give null)."""
    out = F.col(f"`{ids_col}`").alias("ids")
    rest = [F.col(f"`{c}`") for c in encoded.columns if c != out_col]
    rows = encoded.select(F.struct(*rest).alias("_row"), out)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        texts = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "_decoded"])

    out = map_texts(rows, work, f"_row {rows.schema['_row'].dataType.simpleString()}, _decoded string", "ids")
    return out.select("_row.*", F.col("_decoded").alias(out_col))
