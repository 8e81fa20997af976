"""What a label is looked up by is computed once per row, not once per word of the table."""

from pyspark.sql import functions as F

from roomwright import constants as K
from roomwright.functions import text


def _patterns(spark, label) -> int:
    plan = spark.range(1).select(F.col("id").cast("string").alias("raw")).select(label(F.col("raw")).alias("label"))
    return plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")


def test_patterns_run_once(spark):
    assert _patterns(spark, text.ocr_label) == 2
    assert _patterns(spark, text.room_label) <= 2


def test_labels_stay(spark):
    word = next(iter(K.OCR_LABELS))
    rows = spark.createDataFrame([(f"#{word.lower()}  2",), ("##",), ("",), (None,), ("wash  area",), ("zz",)], "raw string")
    found = rows.select(text.ocr_label(F.col("raw")).alias("o"), text.room_label(F.col("raw")).alias("r")).collect()
    assert found[1].o is None and found[2].o is None and found[3].o is None and found[3].r is None
    assert found[0].o == K.OCR_LABELS[word] and found[5].r == "Zz"
