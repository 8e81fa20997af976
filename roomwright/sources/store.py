"""Results as Parquet tables under one folder: floors, rooms, doors, adjacency; partitioned reads by drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("rooms", "doors", "adjacency")
BUCKETS = 64


def save(result: dict[str, DataFrame], folder: str, status: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Writes the tables of an engine's result, clustered by a hash of the drawing so that one drawing's rows are found in one
    part. status: drawing_id, status."""
    for name in TABLES:
        if name in result:
            part = F.pmod(F.xxhash64("drawing_id"), F.lit(buckets)).cast("int")
            result[name].withColumn("part", part).repartition("part").sortWithinPartitions("drawing_id").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/{name}")
    if status is not None:
        status.write.mode("overwrite").parquet(f"{folder}/floors")


def load(spark: SparkSession, folder: str, name: str, drawing_id=None, buckets: int = BUCKETS) -> DataFrame:
    """A table, or one drawing's rows of it (none if there is no such drawing); only that drawing's part is read."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}")
    if drawing_id is None:
        return rows.drop("part")
    value = F.lit(drawing_id).cast(rows.schema["drawing_id"].dataType)
    (part,) = spark.range(1).select(F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")).first()
    return rows.where((F.col("part") == part) & (F.col("drawing_id") == value)).drop("part")


def with_columns_of(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of an older schema with the columns they lack, as nulls: a migration that keeps the files as they are."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return rows.unionByName(empty, allowMissingColumns=True)
