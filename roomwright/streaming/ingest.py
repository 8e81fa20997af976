"""A folder of incoming drawings as a stream: each batch of new files goes through the current engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import from_dxf, payload, run_pipeline
from ..sources import dxf


def watch(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, once: bool = False, **knobs) -> StreamingQuery:
    """Starts a stream that appends status and payload of new .dxf files in inbox to the Parquet table outbox."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.dxf").load(inbox)
    files = files.select(F.input_file_name().alias("drawing_id"), F.col("value").alias("content"))

    def process(batch: DataFrame, number: int) -> None:
        table = dxf.entities(batch)
        rows = payload(run_pipeline(from_dxf(table), **knobs), batch).withColumn("batch", F.lit(number))
        rows.write.mode("append").parquet(outbox)

    stream = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
