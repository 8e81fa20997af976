"""From documents to packed training sequences: language, exact and near copies, secrets, packing.

STAGES is applied in order; each stage's result is written as Parquet and reread as the next one's documents. All stages but
the last return the columns of documents.

Rows are told apart by doc_id and text: different texts of one doc_id, or without any, all take part, and of rows that agree
in both one goes on. Null and empty texts have no letters and go in the first stage. Further columns, of whatever names, go
along. Empty tables give empty results. What a stage writes for itself is deleted once its result is written, and that once
the next stage's is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomwright.llm.common import discard, free_name, materialize, quoted, read_table, scratch_scope
from roomwright.llm.exact_dedup import exact_dedup
from roomwright.llm.language_id import fit_profiles, predict_language
from roomwright.llm.packing import pack
from roomwright.llm.registry import is_held_out
from roomwright.llm.secret_scan import fit_ratios, labelled_samples, redact, secret_spans
from roomwright.llm.simhash import simhash_classes

#: A text whose letters follow no learned language has a cosine, and so a score, near 0 with every prototype.
LEAST_COSINE = 0.1
#: So may a text of few letters in a learned language have, so fewer letters than these are judged by no score.
LEAST_LETTERS = 30


def text_key() -> Column:
    """What tells rows of one doc_id (null too) apart: the digest of the text, a null text being empty."""
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id (null too) and text_key, as _key, occur together in keys; one row for each such pair."""
    row = F.struct(*map(quoted, docs.columns))
    a, b = docs.select(F.col("doc_id").alias("_id"), text_key().alias("_key"), row.alias("_row")).alias("a"), keys.select("doc_id", "_key").alias("b")
    found = a.join(b, (F.col("a._key") == F.col("b._key")) & F.col("a._id").eqNullSafe(F.col("b.doc_id")), "left_semi")
    return found.dropDuplicates(["_id", "_key"]).select("_row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in none of the learned languages go. Without labels nothing can be judged but letters; of
    fewer than LEAST_LETTERS letters, any language that is found counts."""
    profiles = fit_profiles(docs.where(F.coalesce(~is_held_out(), F.lit(False))))
    judged = predict_language(docs, profiles, extra=F.struct(*map(quoted, docs.columns)))
    short = F.regexp_count("extra.text", F.lit(r"\p{L}")) < LEAST_LETTERS
    if profiles.languages:
        kept = judged.where((F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_COSINE) | short))
    else:
        kept = judged.where(F.col("extra.text").rlike(r"\p{L}"))
    return kept.select("extra.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return only(docs, exact_dedup(docs, keep="max").where("kept").withColumnRenamed("text_sha256", "_key"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays; of several such texts, that of the smallest key."""
    leading = simhash_classes(docs, width=3, radius=3, key=text_key()).where("doc_id <=> component_id")
    first = leading.groupBy("class_fp").agg(F.first("doc_id").alias("doc_id"), F.min("key").alias("_key"))
    return only(docs, first)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay, and n_chars follows the text."""
    spans, text = free_name(docs, "_spans"), free_name(docs, "_text")
    found = secret_spans(docs, fit_ratios(labelled_samples(docs)), out_col=spans)
    clean = found.withColumn(text, redact(F.col("text"), F.col(spans)))
    length = F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col(text), "n_chars": length}
    return clean.select(*[new.get(c, quoted(c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the language, near-copy, secret and packing stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as made:
            after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.pop()  # the stage's result
        if before is not None:
            discard(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
