"""Exact deduplication with DataFrame operations only.

Rows are grouped by a 128-bit content hash; the row with the smallest (or largest) id stays. Inside a group the
bytes are compared with those of the group's leading row, and rows that differ from it (hash collisions) are grouped
again by their bytes, so equal hashes alone never join two texts.

Defined results: a null text is an empty text; a null id takes part in its group but leads it only if all its ids are
null; a repeated id is counted as repeated rows, and every row that carries the kept id is reported as kept; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def content_hash(text: Column) -> Column:
    """The first 128 bits of the SHA-256 of the UTF-8 bytes."""
    return F.substring(F.sha2(text, 256), 1, 32)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id (id that stays), group_size, kept, text_sha256.

    keep: "min" or "max", which id of a group stays. hash_of: the grouping hash; a weak one only costs time.
    The texts are shuffled once, by their hash; of a hot group only the rows move, as its leading text is one row of the
    other side and adaptive execution splits the group. What follows works on ids and digests.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).select(
        "_id", "_text", F.sha2("_text", 256).alias("_sha"), hash_of(F.col("_text")).alias("_h")
    )
    leads = rows.groupBy("_h").agg(best("_id").alias("_lead"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    #: The id belongs to the join's key, so that a hot group's rows spread over all tasks.
    a, b = rows.alias("a"), leads.alias("b")
    lead_rows = a.join(b, (F.col("a._h") == F.col("b._h")) & F.col("a._id").eqNullSafe(F.col("b._lead"))).select("a._h", "a._text")
    #: Written, so that the next join's sides are plain exchanges, whose hot groups adaptive execution splits.
    lead_text = materialize(lead_rows.groupBy("_h").agg(F.min("_text").alias("_lead_text")), "exact-dedup-leads")
    other = F.when(F.col("_lead_text") != F.col("_text"), F.col("_text"))
    compared = materialize(
        rows.join(lead_text, "_h", "left").select("_id", "_h", "_sha", other.alias("_other")), "exact-dedup"
    )
    groups = compared.groupBy("_h", "_other").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    a, b = compared.alias("a"), groups.alias("b")
    return a.join(b, (F.col("a._h") == F.col("b._h")) & F.col("a._other").eqNullSafe(F.col("b._other"))).select(
        F.col("a._id").alias(id_col),
        F.col("b._keep").alias("keep_id"),
        F.col("b._n").alias("group_size"),
        F.col("a._id").eqNullSafe(F.col("b._keep")).alias("kept"),
        F.col("a._sha").alias("text_sha256"),
    )
