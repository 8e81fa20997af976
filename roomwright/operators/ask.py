"""Answers of models that the caller can reach: each question goes to the models in turn while quotas are exhausted."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import constants as K


def ask_models(questions: DataFrame, call: Callable[[str, str, bytes | None], str], models: Sequence[str], keep: Sequence[str], text_col: str = "question", picture_col: str | None = None) -> DataFrame:
    """The columns `keep`, answer, model and error of questions. call(model, text, picture) returns a model's answer or raises.

    An error that speaks of a quota moves on to the next model; any other ends the question, as does the last model. Then the
    answer is null and error tells why. The call must be one that every worker can make; a retried task asks again.
    """
    schema = StructType([*(questions.schema[c] for c in keep), *StructType.fromDDL("answer string, model string, error string")])
    shape = to_arrow_schema(schema)

    def one(text: str, picture: bytes | None) -> tuple[str | None, str | None, str | None]:
        error = None
        for model in models:
            try:
                return call(model, text, picture) or "", model, None
            except Exception as problem:  # noqa: BLE001  whatever a caller's client raises
                error = str(problem)
                if not any(sign in error for sign in K.QUOTA_SIGNS):
                    break
        return None, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            pictures = batch.column(picture_col).to_pylist() if picture_col else [None] * len(texts)
            said = [one(t, p) for t, p in zip(texts, pictures)]
            if said:
                new = [pa.array(c, pa.string()) for c in zip(*said)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], schema=shape)

    columns = [*keep, *(c for c in (text_col, picture_col) if c and c not in keep)]
    return questions.select(*columns).mapInArrow(run, schema)
