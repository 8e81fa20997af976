"""What the operators of this subpackage share: reading a table, scratch tables, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python operator turns into one output batch at most (a single longer text stays whole).
BATCH_BYTES = 4 << 20


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until df has no column like it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where that is unset, one machine (as in tests) takes a
    folder of the session, and a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="roomwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet into the shared folder and reads it back: the lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _scopes:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that materialize() wrote since each scope of scratch_scope() was entered.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that materialize() writes inside the scope when it ends; the caller takes what stays out of the list."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() made and that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, so that a batch of very long texts is not held decoded as a whole."""
    for batch in batches:
        rows = max(1, batch.num_rows)
        step = max(1, int(rows * size / max(size, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over batches of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column):
            yield work(batch)

    return df.mapInArrow(run, schema)
