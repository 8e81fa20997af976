"""Language identification with hyperdimensional profiles.

Every letter has a random vector of `DIM` signs, drawn from a generator seeded by its code point. A trigram of letters
(runs of anything else count as one separator) is the product of the three vectors, the first rotated twice and the second
once, so that order counts; a text's vector is the sum of its trigrams' vectors over the whole text, and a language's
prototype is the sum of the vectors of its labelled texts. A text gets the language of the prototype with the largest
cosine. The cosine of few trigrams says little, so the score is the cosine (at least 0) averaged with `PRIOR` trigrams' worth
of 1/2: near the cosine for whole texts, near 1/2 for a word.

Memory: trigrams are taken in pieces of `CHARS_AT_ONCE` positions and multiplied out in blocks of `GRAMS_AT_ONCE` distinct
ones, so neither a very long text nor an alphabet of thousands of letters makes a large table.

Prototypes are fitted on a bounded sample: about `per_lang` labelled texts of each language, chosen by a hash of the id.
The number of languages must fit the driver (each takes DIM numbers there); the texts are never gathered.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if nothing is labelled; equal
cosines go to the alphabetically first language; rows are independent, so repeated rows, null ids and extra columns change
nothing; empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import text_batches

DIM, SEED = 1024, 20_240
PER_LANG = 2_000
#: Trigrams that the score of an unknown text is worth.
PRIOR = 10
#: Characters and texts that one numpy step takes together (a longer text is taken alone, whole).
CHARS_AT_ONCE, TEXTS_AT_ONCE, GRAMS_AT_ONCE = 1 << 18, 128, 1 << 13


class Letters:
    """Numbers the letters that a worker meets and holds their vectors; number 0 is the separator."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.number = np.full(0x110000, -1, np.int32)
        self.known: dict[str, int] = {}
        self._table = np.empty((64, dim), np.int8)
        self._add("")

    @property
    def vectors(self) -> np.ndarray:
        return self._table[: len(self.known)]

    def _add(self, letter: str) -> int:
        if letter not in self.known:
            rng = np.random.default_rng([SEED, *map(ord, letter)])
            if len(self.known) == len(self._table):
                self._table = np.concatenate([self._table, np.empty_like(self._table)])
            self._table[len(self.known)] = rng.integers(0, 2, self.dim) * 2 - 1
            self.known[letter] = len(self.known)
        return self.known[letter]

    def numbers(self, points: np.ndarray) -> np.ndarray:
        found = self.number[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]).tolist():
                c = chr(p)
                self.number[p] = self._add(c.lower()[0]) if c.isalpha() else 0
            found = self.number[points]
        return found


def text_vectors(texts: list[str], letters: Letters) -> np.ndarray:
    """[len(texts), dim]: each text's bundle of trigram vectors; zero for a text without letters."""
    return text_bundles(texts, letters)[0]


def text_bundles(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """The bundles of trigram vectors, and the numbers of trigrams."""
    out, grams = np.zeros((len(texts), letters.dim), np.float32), np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and stop - at < TEXTS_AT_ONCE and (stop == at or chars + len(texts[stop]) < CHARS_AT_ONCE):
            chars += len(texts[stop])
            stop += 1
        _add_vectors(texts[at:stop], letters, out[at:stop], grams[at:stop])
        at = stop
    return out, grams


def _add_vectors(texts: list[str], letters: Letters, out: np.ndarray, grams: np.ndarray) -> None:
    framed = [f"\n{t if unicodedata.is_normalized('NFC', t) else unicodedata.normalize('NFC', t)}\n" for t in texts]
    number = letters.numbers(np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in framed])
    kept = number > 0
    kept[1:] |= number[:-1] > 0
    kept[np.cumsum([0, *map(len, framed[:-1])])] = True
    number, text = number[kept], text[kept]
    for at in range(0, len(number) - 2, CHARS_AT_ONCE):
        piece = slice(at, at + CHARS_AT_ONCE + 2)
        _add_grams(number[piece].astype(np.int64), text[piece], letters, out, grams)


def _add_grams(number: np.ndarray, text: np.ndarray, letters: Letters, out: np.ndarray, grams: np.ndarray) -> None:
    inside = text[2:] == text[:-2]
    size = len(letters.known)
    code = ((number[:-2] * size + number[1:-1]) * size + number[2:])[inside]
    text = text[:-2][inside].astype(np.int64)
    grams += np.bincount(text, minlength=len(grams))
    if size**3 <= 1 << 20:
        here = np.zeros(size**3, bool)
        here[code] = True
        distinct = np.flatnonzero(here)
        which = (np.cumsum(here) - 1)[code]
    else:
        distinct, which = np.unique(code, return_inverse=True)
    if len(distinct) > GRAMS_AT_ONCE:
        order = np.argsort(which, kind="stable")
        which, text = which[order], text[order]
    v = letters.vectors
    for low in range(0, len(distinct), GRAMS_AT_ONCE):
        own = distinct[low : low + GRAMS_AT_ONCE]
        a, b = (0, len(which)) if len(distinct) <= GRAMS_AT_ONCE else np.searchsorted(which, [low, low + len(own)])
        counts = np.bincount(text[a:b] * len(own) + which[a:b] - low, minlength=len(out) * len(own)).reshape(len(out), len(own))
        bound = np.roll(v[own // size**2], 2, axis=1) * np.roll(v[own // size % size], 1, axis=1) * v[own % size]
        out += counts.astype(np.float32) @ bound.astype(np.float32)


@dataclass(frozen=True)
class Profiles:
    """Prototypes of the learned languages, in alphabetical order, as unit rows."""

    languages: list[str]
    prototypes: np.ndarray

    def classify(self, texts: list[str | None], letters: Letters) -> tuple[list[str], list[float]]:
        vectors, grams = text_bundles([t or "" for t in texts], letters)
        size = np.linalg.norm(vectors, axis=1)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        cosine = (vectors @ self.prototypes.T.astype(np.float32)).astype(float) / np.maximum(size, 1e-9)[:, None]
        best = cosine.argmax(axis=1)
        names = [self.languages[b] if any(c.isalpha() for c in (t or "")) else "und" for b, t in zip(best, texts)]
        sure = (np.clip(cosine.max(axis=1), 0, 1) * grams + PRIOR / 2) / (grams + PRIOR)
        return names, [0.0 if n == "und" else float(x) for n, x in zip(names, sure)]


_letters: Letters | None = None


def _worker_letters() -> Letters:
    global _letters
    if _letters is None:
        _letters = Letters()
    return _letters


def fit_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Profiles:
    """Prototypes from about per_lang texts of every non-null language of `labelled`."""
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles([], np.zeros((0, DIM)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_lang / n))])
    chance = F.pmod(F.xxhash64(F.coalesce("_id", F.lit("")), F.lit(7)), F.lit(1_000_000)) / 1e6
    sample = rows.where(chance < F.element_at(share, F.col("lang"))).select("text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_batches(batches):
            names = np.array(batch.column("lang").to_pylist(), object)
            vectors = text_vectors(batch.column("text").to_pylist(), _worker_letters())
            for name in set(names.tolist()):
                sums[name] = sums.get(name, 0) + vectors[names == name].astype(np.float64).sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(bundle, "lang string, v binary").collect():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(bytes(r.v))
    languages = [k for k in sorted(total) if np.linalg.norm(total[k])]
    return Profiles(languages, np.array([total[k] / np.linalg.norm(total[k]) for k in languages]).reshape(-1, DIM))


def predict_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None) -> DataFrame:
    """Per row: the id column, lang_pred, score; and `extra`, a struct, as column extra."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"), (F.lit(None).cast("struct<x:int>") if extra is None else extra).alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            names, scores = profiles.classify(batch.column("text").to_pylist(), _worker_letters())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), batch.column("extra")], ["_id", "lang_pred", "score", "extra"])

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType().add("_id", kinds["_id"]).add("lang_pred", "string").add("score", "double").add("extra", kinds["extra"])
    out = rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    return out.drop("extra") if extra is None else out
