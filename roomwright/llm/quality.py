"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed words and thresholds t1 < t2 < ... are fitted to grades 0, 1, 2, ...:
P(grade >= k) = 1 / (1 + exp(tk - score)), where score is the sum of the weights of a text's distinct features. The weights
are shared by all thresholds, so the model orders texts on one scale; it gives the expected grade and the probability of
reaching a grade.

Features of a white-space-separated stretch: its letters and digits in lower case, their first 5 and 7, the marks around
them, and whether it repeats its predecessor. All stretches of a text count, once per distinct feature. Fitting takes a bounded sample
of labelled texts: the ids with grades of the smallest hashes, at most `SAMPLE_ROWS` of them and of their texts, and at most
`SAMPLE_FEATURES` features in all (but one text at least); only hashed features go to the driver. An L1 penalty leaves weights on few features, so that long
texts do not gather noise.

Defined results: a null or empty text has no features and score 0; a label row without grade is left out; documents without
a label are scored like others; of labelled rows that agree in id, text and grade one counts, different grades of an id count
each; when scoring, rows are independent, so repeated rows, null ids
and extra columns change nothing; without labels every probability is 1/2; empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_batches

BUCKETS = 1 << 18
SAMPLE_ROWS, SAMPLE_FEATURES = 8_000, 20_000_000
L1, ROUNDS, LEAST_TEXTS = 0.0005, 200, 3
#: Lengths of the beginnings that stand for a word's stem.
STEMS = (5, 7)
CACHE_WORDS = 300_000
_CORE = re.compile(r"\w+(?:[^\w\s]+\w+)*")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def stretch_features(stretch: str) -> tuple[int, ...]:
    """Buckets of a stretch: its core, and the marks before and after it."""
    core = _CORE.search(stretch)
    if not core:
        return (_bucket("marks " + stretch),)
    marks, word = (stretch[: core.start()], stretch[core.end() :]), core[0].lower()
    stems = (_bucket(f"stem {word[:k]}") for k in STEMS if len(word) > k)
    return (_bucket("word " + word), *stems, *(_bucket(f"mark {k} {m}") for k, m in enumerate(marks) if m))


REPEATED = _bucket("repeated")


class Featurizer:
    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        stretches = text.split()
        distinct = set(stretches)
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen, found = self.seen, set()
        for s in distinct:
            if s not in seen:
                seen[s] = stretch_features(s)
            found.update(seen[s])
        if len(distinct) < len(stretches) and any(map(str.__eq__, stretches, stretches[1:])):
            found.add(REPEATED)
        return found


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by bucket and ordered thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, features: set[int]) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        get = self.weights.get
        score = sum(get(f, 0.0) for f in features) if len(features) < len(self.weights) else sum(w for f, w in self.weights.items() if f in features)
        return [1 / (1 + float(np.exp(np.clip(t - score, -50, 50)))) for t in self.thresholds]


def fit_ordinal(rows: Iterable[tuple[Iterable[int], int]], grades: int) -> OrdinalModel:
    """Proximal gradient steps with momentum on the cumulative-link likelihood, the same in whatever order the rows come."""
    rows = sorted(((np.unique(np.fromiter(fs, np.int32)), g) for fs, g in rows), key=lambda r: (r[1], r[0].tobytes()))
    if not rows:
        return OrdinalModel({}, (0.0,) * (grades - 1))
    texts = np.bincount(np.concatenate([fs for fs, _ in rows]), minlength=BUCKETS)
    column = np.full(BUCKETS, -1)
    used = np.flatnonzero(texts >= min(LEAST_TEXTS, len(rows)))
    column[used] = np.arange(len(used))
    index = [found[found >= 0] for found in (column[fs] for fs, _ in rows)]
    flat, sizes = np.concatenate(index), np.array([len(i) for i in index])
    owner = np.repeat(np.arange(len(rows)), sizes)
    grade = np.array([g for _, g in rows])
    n, k = len(rows), np.arange(1, grades)
    reached = (grade[:, None] >= k).astype(float)
    share = np.clip(reached.mean(axis=0), 0.5 / n, 1 - 0.5 / n)
    t = -np.log(share / (1 - share))
    #: A text's features weigh in together, so the step is scaled by each feature's own frequency.
    scale = 4.0 / (np.maximum(texts[used], 1) / n) / max(1.0, sizes.mean() ** 0.5)
    w = np.zeros(len(used))
    wv, tv = w.copy(), t.copy()
    for r in range(ROUNDS):
        score = np.bincount(owner, wv[flat], n)
        off = reached - 1 / (1 + np.exp(np.clip(tv - score[:, None], -50, 50)))
        slope = np.bincount(flat, off.sum(axis=1)[owner], len(used)) / n
        step = scale * 0.1
        new = wv + step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        nt = np.sort(tv - 0.3 * off.mean(axis=0))
        pull = r / (r + 3)
        wv, tv = new + pull * (new - w), nt + pull * (nt - t)
        w, t = new, nt
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return OrdinalModel(dict(zip(used[some].tolist(), w[some].tolist())), tuple(t.tolist()))


_featurizer: Featurizer | None = None


def _worker_featurizer() -> Featurizer:
    global _featurizer
    if _featurizer is None:
        _featurizer = Featurizer()
    return _featurizer


def fit_quality(docs: DataFrame, graded: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fits on at most sample_rows of the labelled texts of `graded` (id, grade from 0 to grades - 1)."""
    rated = graded.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{grade_col}`").cast("int").alias("grade")).where("grade is not null and _id is not null").distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    #: At most sample_rows ids with grades, so they can be broadcast; texts move nowhere.
    chosen = rated.orderBy(F.xxhash64(F.col("_id").cast("string"), "grade"), "_id", "grade").limit(sample_rows)
    #: An id can have any number of texts. They are read for their hashes first, and the smallest make the sample, copies once.
    hashed = texts.join(F.broadcast(chosen), "_id").select("text", "grade", F.xxhash64(F.col("_id").cast("string"), "grade", "text").alias("h"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample_rows).collect()]
    if not least:
        return fit_ordinal([], grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [np.array(sorted(_worker_featurizer()(t)), "<i4") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("grade"), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["h", "grade", "n", "features"])

    found = hashed.where(F.col("h") <= least[-1]).mapInArrow(run, "h long, grade int, n long, features binary")
    rows = materialize(found.groupBy("h").agg(F.first("grade").alias("grade"), F.first("n").alias("n"), F.first("features").alias("features")), "quality-sample")
    total, last = 0, least[0]
    for r in rows.select("h", "n").orderBy("h").collect():
        total += r.n
        if total > SAMPLE_FEATURES:
            break
        last = r.h
    got = rows.where(F.col("h") <= last).select("features", "grade").collect()
    discard(rows)
    return fit_ordinal([(np.frombuffer(bytes(r.features), "<i4"), r.grade) for r in got], grades)


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, expected_grade, and tail: array of P(grade >= k) for k = 1, 2, ..."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            tails = [model.tails(_worker_featurizer()(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([sum(t) for t in tails], pa.float64()), pa.array(tails, pa.list_(pa.float64()))], ["_id", "expected_grade", "tail"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, expected_grade double, tail array<double>").withColumnRenamed("_id", id_col)
